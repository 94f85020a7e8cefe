"""Exact deduplication by a tree merge of sorted digest runs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import materialise

RUNS = 256
FAN_IN = 16


def tree_merge(digests: DataFrame, keep: str = "max", runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """The surviving identifier and the size of the group of each row of ``digests``.

    ``digests`` has ``_id`` (long), ``_key`` (binary digest) and ``_check`` (binary, an independent
    digest of the same bytes). Rows are dealt to ``runs`` runs by a hash of the identifier, so equal
    digests, however many, lie evenly in all runs. A run is reduced to one entry per digest by a
    sort-based aggregate; then, in rounds, ``fan_in`` neighbouring runs (log2 binomial rounds at once)
    exchange their entries, cut over all tasks by digest, and are merged, so that a task never gets
    more than ``fan_in`` entries of a digest. Each level keeps the smallest (or largest) identifier
    and verifies that all entries of a digest carry the same second digest; a difference is an error.
    The root's answers go down the same tree, again ``fan_in`` entries to a digest, to the rows.

    The digests are written once to the shared folder, so the texts are read and hashed once, and a
    lost executor costs no second pass over them.

    Returns ``_id``, ``_key``, ``_keep``, ``_size``, one row per input row. Empty input: no rows. A null
    ``_id`` never survives beside another; repeated rows count each and share their answer.
    """
    best = F.max if keep == "max" else F.min
    base = materialise(digests, "digests").withColumn("_run", F.pmod(F.xxhash64("_id"), F.lit(runs)).cast("long")).repartition("_run", "_key")

    def merged(rows: DataFrame, run, keep_col: str, size, low: str, high: str) -> DataFrame:
        return (
            rows.withColumn("_run", run)
            .groupBy("_run", "_key")
            .agg(best(keep_col).alias("_keep"), F.sum(size).alias("_size"), F.min(low).alias("_low"), F.max(high).alias("_high"))
            .withColumn("_keep", F.when(F.col("_low") == F.col("_high"), F.col("_keep")).otherwise(F.raise_error(F.lit("two texts share a digest"))))
        )

    levels = [merged(base, F.col("_run"), "_id", F.lit(1).cast("long"), "_check", "_check")]
    width = runs
    while width > 1:
        width = -(-width // fan_in)
        levels.append(merged(levels[-1], F.floor(F.col("_run") / fan_in), "_keep", F.col("_size"), "_low", "_high"))
    answer = levels[-1].select("_run", "_key", "_keep", "_size")
    for level in reversed(levels[:-1]):
        below = level.select(F.col("_run").alias("_own"), F.floor(F.col("_run") / fan_in).alias("_run"), "_key")
        answer = below.join(answer, ["_run", "_key"]).select(F.col("_own").alias("_run"), "_key", "_keep", "_size")
    return base.select("_run", "_key", "_id").join(answer, ["_run", "_key"]).select("_id", "_key", "_keep", "_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """Which row of each group of equal texts stays; texts are equal when their bytes are.

    Returns one row per input row: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.
    A null text counts as empty and so equals an empty one. Of equal texts the row with the largest
    identifier stays (``keep="min"``: the smallest); rows that repeat an identifier stay or go
    together; rows without identifier stay only among themselves. Texts may have any length; other
    columns of ``docs`` are not read. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    digests = docs.select(
        F.col(id_col).cast("long").alias("_id"),
        F.unhex(F.sha2(text, 256)).alias("_key"),
        F.unhex(F.concat(F.md5(text), F.lpad(F.hex(F.octet_length(text)), 16, "0"))).alias("_check"),
    )
    found = tree_merge(digests, keep, runs, fan_in)
    return found.select(
        F.col("_id").alias("doc_id"),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.lower(F.hex("_key")).alias("text_sha256"),
    )


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's query over all documents."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
