"""Connected components of a link table by smallest-label spreading with pointer jumping, all distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import materialise


def components(links: DataFrame, name: str = "labels") -> DataFrame:
    """``node``, ``label`` (smallest node reachable) for every node of ``links`` (``a``, ``b``, longs).

    Every round takes the smallest label among the neighbours and then the label's own label, so chains
    shorten by more than half and the rounds grow with the logarithm of the longest chain. Labels are
    written to the shared folder each round; only the count of changes reaches the driver.

    Repeated links and such in both directions count once; a link of a node to itself gives the node a row. Links with a null on either side must be
    taken out before: null is no node. No links: no rows.
    """
    both = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), name)
    labels = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"), name)
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("_near"))
        lower = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("label").alias("_old"), F.least("label", F.coalesce("_near", "label")).alias("_new"))
        jump = labels.select(F.col("node").alias("_at"), F.col("label").alias("_far"))
        fresh = lower.join(jump, F.col("_new") == F.col("_at"), "left").select("node", "_old", F.least("_new", F.coalesce("_far", "_new")).alias("label"))
        fresh = materialise(fresh, name)
        labels = fresh.select("node", "label")
        if fresh.filter("label <> _old").isEmpty():
            return labels
