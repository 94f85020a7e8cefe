"""Ranking metrics per query, by category and overall, with the rules for empty lists as parameters."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KS = (1, 3, 5)


def metrics(golden: DataFrame, hits: DataFrame, ks: tuple[int, ...] = KS, empty: str = "zero") -> DataFrame:
    """One row per golden query (``query_id``, ``category``, ``expected`` array) with its metrics over ``hits`` (``query_id``, ``record_id``, ``rank``).

    Precision at k divides by what was returned, at most k. ``empty`` says what a query that expects nothing scores: ``zero``; ``match`` (1 if
    nothing came back, else 0); ``null``. A record that comes back twice counts once, at its first rank.

    Where a query expects more records than a row should hold, ``golden`` has ``expected_count`` in place of ``expected``, and ``hits`` say for themselves
    whether they are ``relevant``.
    """
    if "expected" in golden.columns:
        wanted = golden.select("query_id", F.explode(F.array_distinct("expected")).alias("record_id")).withColumn("rel", F.lit(1))
        one = hits.groupBy("query_id", "record_id").agg(F.min("rank").alias("rank"))
        marked = one.join(wanted, ["query_id", "record_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
        golden = golden.withColumn("expected_count", F.size(F.array_distinct("expected")))
    else:
        marked = hits.groupBy("query_id", "record_id").agg(F.min("rank").alias("rank"), F.max(F.coalesce("relevant", F.lit(False)).cast("int")).alias("rel"))
    counts = [F.count("*").alias("returned"), F.sum("rel").alias("found"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first")]
    for k in ks:
        counts += [F.count_if(F.col("rank") <= k).alias(f"n{k}"), F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0)).alias(f"r{k}")]
    whole = golden.join(marked.groupBy("query_id").agg(*counts), "query_id", "left").fillna(0, ["returned", "found", *[f"n{k}" for k in ks], *[f"r{k}" for k in ks]])
    size = F.col("expected_count")
    none = {"zero": F.lit(0.0), "match": F.when(F.col("returned") == 0, 1.0).otherwise(0.0), "null": F.lit(None).cast("double")}[empty]
    of = lambda value: F.when(size == 0, none).otherwise(value)
    part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = {"reciprocal_rank": of(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), "precision": of(part(F.col("found"), F.col("returned"))), "recall": of(part(F.col("found"), size)), "exact_match": ((F.col("found") == size) & (F.col("returned") == size)).cast("double")}
    for k in ks:
        out |= {f"hit_at_{k}": of((F.col(f"r{k}") > 0).cast("double")), f"precision_at_{k}": of(part(F.col(f"r{k}"), F.col(f"n{k}"))), f"recall_at_{k}": of(part(F.col(f"r{k}"), size))}
    return whole.select("query_id", "category", F.col("returned"), F.col("found"), *[v.alias(k) for k, v in out.items()])


def by_category(scores: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    """Means by category and, with category ``ALL``, over all queries."""
    means = [F.round(F.avg(n), digits).alias(n) for n in names]
    return scores.rollup("category").agg(F.grouping("category").alias("_all"), F.count("*").alias("queries"), *means).withColumn("category", F.when(F.col("_all") == 1, "ALL").otherwise(F.col("category"))).drop("_all")


def multi_intent_coverage(golden: DataFrame, hits: DataFrame) -> DataFrame:
    """Share of the expected records found, and whether all were, per query; missing and unexpected ones listed."""
    got = hits.groupBy("query_id").agg(F.collect_set("record_id").alias("got"))
    whole = golden.join(got, "query_id", "left").withColumn("got", F.coalesce("got", F.array().cast("array<string>")))
    found = F.size(F.array_intersect("expected", "got"))
    return whole.select(
        "query_id", F.when(F.size("expected") > 0, found / F.size("expected")).otherwise(0.0).alias("coverage"), (found == F.size(F.array_distinct("expected"))).alias("full_success"),
        F.array_sort(F.array_except("expected", "got")).alias("missing"), F.array_sort(F.array_except("got", "expected")).alias("unexpected"),
    )


def negative_passes(golden: DataFrame, summary: DataFrame) -> DataFrame:
    """Queries that expect nothing pass if they abstained without records."""
    return golden.filter(F.size("expected") == 0).join(summary.select("query_id", "abstained", "records"), "query_id", "left").select("query_id", (F.coalesce("abstained", F.lit(True)) & (F.coalesce("records", F.lit(0)) == 0)).alias("passed"))


def full_query_hit(golden: DataFrame, intents: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """Whether every intent of a query has one of its records in its first ``k``.

    Where intents and expected records are equal in number they belong together one by one, else each intent has the whole list.
    """
    counted = intents.select("query_id", "intent_index").join(intents.groupBy("query_id").agg(F.count("*").alias("n")), "query_id").join(golden.select("query_id", "expected"), "query_id")
    own = counted.withColumn("wanted", F.when(F.col("n") == F.size("expected"), F.array(F.element_at("expected", (F.col("intent_index") + 1).cast("int")))).otherwise(F.col("expected")))
    got = hits.filter(F.col("rank") <= k).groupBy("query_id", "intent_index").agg(F.collect_set("record_id").alias("got"))
    hit = F.coalesce(F.arrays_overlap("wanted", "got"), F.lit(False))
    return own.join(got, ["query_id", "intent_index"], "left").groupBy("query_id").agg(F.bool_and(hit).alias(f"full_hit_at_{k}"))


def exact_sets(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def as_percent(c: Column | str, digits: int = 2) -> Column:
    """A share as text, such as 66.67%."""
    share = F.col(c) if isinstance(c, str) else c
    return F.concat(F.format_string(f"%.{digits}f", share.cast("double") * 100), F.lit("%"))


class Report(NamedTuple):
    """What ``report`` returns: metrics per query, means by category as numbers and as percent texts, failed queries."""

    scores: DataFrame
    means: DataFrame
    percent: DataFrame
    failures: DataFrame


def report(golden: DataFrame, hits: DataFrame, ks: tuple[int, ...] = KS, empty: str = "match", digits: int = 2) -> Report:
    """The whole evaluation of one retriever's ``hits`` against ``golden`` in one batch.

    A query fails if an expected record is missing, or if it expects none and some came back; what was expected and what came, in order, is listed.
    """
    scores = metrics(golden, hits, ks, empty)
    names = [c for c in scores.columns if c not in ("query_id", "category", "returned", "found")]
    means = by_category(scores, names)
    one = hits.groupBy("query_id", "record_id").agg(F.min("rank").alias("rank"))
    came = one.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "record_id"))), lambda r: r["record_id"]).alias("got"))
    size = F.size(F.array_distinct("expected"))
    failed = ((size > 0) & (F.col("found") < size)) | ((size == 0) & (F.col("returned") > 0))
    failures = scores.select("query_id", "found", "returned").join(golden, "query_id").filter(failed).join(came, "query_id", "left")
    return Report(scores, means, means.select("category", "queries", *[as_percent(n, digits).alias(n) for n in names]), failures.select("query_id", "category", "expected", F.coalesce("got", F.array().cast("array<string>")).alias("got")))


def write_report(found: Report, path: str) -> None:
    """Write the parts of a report as JSON below ``path``."""
    for name, part in found._asdict().items():
        part.write.mode("overwrite").json(f"{path.rstrip('/')}/{name}")
