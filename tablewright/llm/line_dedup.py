"""Line deduplication by a suffix array over line identifiers, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.shared import materialise
from tablewright.sources.tables import spread

LEAST_LINES = 4
LEAST_WORDS = 20
RANK_BUCKET = 1 << 16
NO_ID = -(1 << 63)


def ranked(keys: DataFrame, group: list[str], by: str, bucket: Column, start: Column) -> DataFrame:
    """``keys`` with ``rank``: ``start`` plus the suffixes (``c``) of the keys before it in its group.

    The running sum is taken within buckets of the ordering key and over the buckets, so neither window
    holds more than a bucket's keys or a group's buckets, however many suffixes a group has.
    """
    keys = keys.withColumn("_bucket", bucket)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inner = keys.withColumn("_in", F.coalesce(F.sum("c").over(before(Window.partitionBy(*group, "_bucket").orderBy(by))), F.lit(0)))
    sums = keys.groupBy(*group, "_bucket").agg(F.sum("c").alias("_c"))
    outer = sums.withColumn("_out", F.coalesce(F.sum("_c").over(before(Window.partitionBy(*group).orderBy("_bucket"))), F.lit(0))).drop("_c")
    return inner.join(outer, [*group, "_bucket"]).withColumn("rank", start + F.col("_in") + F.col("_out")).drop("_bucket", "_in", "_out")


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per line: ``d`` and ``t`` (document), ``p`` (position from 0), ``lid`` (digest), ``w`` (words)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = spread(docs).select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(text).alias("t"), F.posexplode(F.split(text, "\n", -1)).alias("p", "line"))
    lines = rows.select("d", "t", F.col("p").cast("long").alias("p"), F.md5(F.col("line").cast("binary")).alias("lid"), F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("w"))
    return lines.dropDuplicates(["d", "t", "p"])


def suffix_levels(lines: DataFrame, depth: int, every: bool = False) -> list[tuple[int, DataFrame]]:
    """(h, suffixes) for h = 1, 2, 4 .. ``depth``, or with ``every`` 1, 2, 3 ..: the suffixes whose first h lines occur more than once.

    A suffix has its ``rank`` in the order of suffixes by their first h lines; equal ranks are an interval of
    common prefix h at least, of which ``first`` is the earliest suffix in (document, position) order. ``w``
    counts the words of the h lines. Doubling joins a suffix with the one h lines later; a suffix whose
    h lines are unique can't be part of a longer repeat and is discarded. With ``every``, a suffix is joined with
    the next one, so that their h lines overlap in all but the first and the last, and ``end`` has the words of the last.
    """
    place = F.struct("d", "t", "p")
    keys = lines.groupBy("lid").agg(F.count("*").alias("c"), F.min(place).alias("first")).filter("c > 1").withColumn("g", F.lit(0))
    keys = ranked(keys, ["g"], "lid", F.substring("lid", 1, 3), F.lit(0).cast("long")).select("lid", "rank", "first")
    end = [F.col("w").alias("end")] if every else []
    level = materialise(lines.join(keys, "lid").select("d", "t", "p", "w", *end, "rank", "first"), "suffixes")
    found, h = [(1, level)], 1
    while h < depth:
        by, end = (1, [F.col("w2").alias("end")]) if every else (h, [])
        ahead = level.select("d", "t", (F.col("p") - by).alias("p"), F.col("end" if every else "w").alias("w2"), F.col("rank").alias("r2"))
        pairs = level.drop("end").join(ahead, ["d", "t", "p"]).select("d", "t", "p", (F.col("w") + F.col("w2")).alias("w"), *end, F.col("rank").alias("r1"), "r2")
        keys = pairs.groupBy("r1", "r2").agg(F.count("*").alias("c"), F.min(place).alias("first")).filter("c > 1")
        keys = ranked(keys, ["r1"], "r2", F.floor(F.col("r2") / RANK_BUCKET), F.col("r1")).select("r1", "r2", "rank", "first")
        h += by
        level = materialise(pairs.join(keys, ["r1", "r2"]).select("d", "t", "p", "w", *(["end"] if every else []), "rank", "first"), "suffixes")
        found.append((h, level))
    return found


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_lines: int = LEAST_LINES, least_words: int = LEAST_WORDS, every_length: bool = True) -> DataFrame:
    """Delete the later copies of repeated runs of lines.

    Lines are parted by line feeds. A run of lines is a copy if it occurs earlier, in the order of
    identifier and position, in the same or another document. Copies of ``least_lines`` lines, and shorter copies with
    at least ``least_words`` words, are deleted; longer copies are unions of such ones, so sorting suffixes by their
    first ``least_lines`` lines settles the result. Suffixes are sorted by their first 1, 2, 3 .. lines, each length from the one before.
    Without ``every_length`` they are by 1, 2, 4 .. lines, ``least_lines`` must be a power of two, and a run of
    3 lines goes only if 2 of its lines have the words.

    Returns one row per row: ``doc_id``, ``n_lines``, ``n_removed``, ``n_runs`` (maximal deleted runs),
    ``longest_run``, ``text`` (the lines left, joined by line feeds). A null text is one empty line. Null
    identifiers come first in the order. Rows equal in identifier and text are one document and share
    the answer; of rows that share only the identifier, the smaller text hash is first. No column but
    the two is read; an empty table gives an empty result.
    """
    if least_lines & (least_lines - 1) and not every_length:
        raise ValueError("least_lines must be a power of two")
    lines = materialise(line_table(docs, id_col, text_col), "lines")
    gone = None
    for h, level in suffix_levels(lines, least_lines, every_length):
        later = level.filter(F.col("first") < F.struct("d", "t", "p"))
        if h < least_lines:
            later = later.filter(F.col("w") >= least_words)
        spots = later.select("d", "t", F.explode(F.sequence("p", F.col("p") + h - 1)).alias("p"))
        gone = spots if gone is None else gone.unionByName(spots)
    gone = gone.distinct()
    # islands of consecutive positions are the maximal runs
    island = gone.withColumn("_i", F.col("p") - F.row_number().over(Window.partitionBy("d", "t").orderBy("p")))
    runs = island.groupBy("d", "t", "_i").agg(F.count("*").alias("n"), F.collect_list("p").alias("ps"))
    per_doc = runs.groupBy("d", "t").agg(F.count("*").alias("n_runs"), F.max("n").alias("longest_run"), F.flatten(F.collect_list("ps")).alias("_gone"))

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("_text"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(text).alias("t"))
    joined = rows.join(per_doc, ["d", "t"], "left").withColumn("_lines", F.split("_text", "\n", -1))
    n = F.size("_lines").cast("long")
    left = F.array_except(F.sequence(F.lit(0).cast("long"), n - 1), F.col("_gone"))
    kept = F.array_join(F.transform(left, lambda i: F.element_at("_lines", (i + 1).cast("int"))), "\n")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return joined.select(
        "doc_id", n.alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"), zero("n_runs"), zero("longest_run"),
        F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(kept).alias("text"),
    )


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents with what line deduplication leaves of them."""
    found = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_lines", "n_removed", "n_runs", "longest_run", F.sha2("text", 256).alias("text_sha256"))


SQL = r"""
WITH docs AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), places AS (
  SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS p FROM docs
), windows AS (
  SELECT doc_id, p, h, array_to_string(ls[p:p + h - 1], chr(10)) AS s
  FROM places, (VALUES (1), (2), (3), (4)) v(h) WHERE p + h - 1 <= len(ls)
), marked AS (
  SELECT doc_id, p, h, len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) AS w,
         row_number() OVER (PARTITION BY h, s ORDER BY doc_id, p) AS k
  FROM windows
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + h)) AS p FROM marked WHERE k > 1 AND (h = 4 OR w >= 20)
), islands AS (
  SELECT doc_id, i, count(*) AS n FROM (SELECT doc_id, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i FROM gone) GROUP BY doc_id, i
), runs AS (
  SELECT doc_id, count(*) AS n_runs, max(n) AS longest_run, CAST(sum(n) AS BIGINT) AS n_removed FROM islands GROUP BY doc_id
), rest AS (
  SELECT doc_id, string_agg(ls[p], chr(10) ORDER BY p) AS text FROM places WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = places.doc_id AND g.p = places.p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs, coalesce(longest_run, 0) AS longest_run,
       sha256(coalesce(text, '')) AS text_sha256
FROM docs LEFT JOIN runs USING (doc_id) LEFT JOIN rest USING (doc_id)
"""
