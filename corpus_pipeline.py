"""The training-data pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import bpe, decontaminate, exact_dedup, jaccard_join, langid
from tablewright.llm.shared import materialise, small

TOKENS = ("n_tokens", "ids", "ids_sha256", "decoded_sha256", "decoded")
"""Columns that the last stage makes, the last of them for itself alone."""
LEAST_SCORE = 0.5
"""Probability of the predicted language below which a document is rejected."""


def without(docs: DataFrame, gone: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """``docs`` but for the rows whose doc_id is in what ``gone`` returns for them.

    Where doc_id is null or repeated, rows are numbered in its order and judged by their number, each on its own.
    """
    own = keyed(docs)
    if not docs.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1").isEmpty():
        own = own.orderBy(F.asc_nulls_last("_key"), "_sha").withColumn("_key", F.monotonically_increasing_id())
        own = materialise(own, "numbered")
    found = gone(own.select(F.col("_key").alias("doc_id"), F.col("_row.text").alias("text"))).select(F.col("doc_id").alias("_key")).distinct()
    return own.join(small(found, name), "_key", "left_anti").select("_row.*")


def keyed(docs: DataFrame) -> DataFrame:
    """The whole row as ``_row``, so that no name can clash, its doc_id as ``_key`` and its text's digest as ``_sha``."""
    return docs.select(F.struct(*columns(docs)).alias("_row"), F.col("doc_id").alias("_key"), digest().alias("_sha"))


def columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def digest() -> Column:
    return F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``docs`` has it, whatever its case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; those without letters or of an unsure language go.

    Null and empty texts have no letters and go; very long ones are read whole. Repeated rows share their fate. All columns are kept,
    whatever their names. An empty table gives an empty one.
    """
    model = langid.fit(docs.filter(~langid.held_out("doc_id", 4, 2)))
    told, sure = unused(docs, "_lang", "_sure")
    found = langid.predict(docs, model, carry=True, names=(told, sure))
    return found.filter((F.col(told) != langid.UNKNOWN) & (F.col(sure) >= LEAST_SCORE)).select(*columns(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts, that of the largest doc_id; of rows equal in both, one."""
    found = materialise(exact_dedup.exact_dedup(docs).select(F.col("doc_id").alias("_id"), "kept", F.col("text_sha256").alias("_digest")), "kept")
    gone = small(found.filter("NOT kept").select("_id", "_digest").distinct(), "copies", most=100_000)
    own = keyed(docs)
    rest = own.join(gone, (F.col("_sha") == F.col("_digest")) & F.col("_key").eqNullSafe(F.col("_id")), "left_anti")
    twice = small(found.filter("kept").groupBy("_id").count().filter("count > 1").select("_id"), "twice")
    if not twice.isEmpty():
        again = F.col("_key").eqNullSafe(F.col("_id"))
        rest = rest.join(twice, again, "left_anti").unionByName(rest.join(twice, again, "left_semi").dropDuplicates(["_key", "_sha"]))
    return rest.select("_row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar ones, that of the smallest doc_id.

    Texts without words, null ones too, are linked with nothing and stay. Rows with a null or repeated doc_id are judged each on its own, null
    last. Texts are read whole. All columns are kept; an empty table gives an empty one.
    """
    return without(docs, lambda own: jaccard_join.jaccard_components(own).filter("doc_id <> component_id"), "similar")


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay; without benchmark items all stay. Rows with a null or repeated doc_id are judged each on its own.
    Texts are read whole. All columns are kept; an empty table gives an empty one.
    """
    return without(docs, lambda own: decontaminate.contamination(own, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "leaks")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ``n_tokens``, ``ids`` (binary, little-endian unsigned 32-bit), ``ids_sha256`` and ``decoded_sha256``.

    Null and empty texts have no ids; very long ones are encoded whole; repeated rows alike. All columns are kept: one that has the name of a
    new column as ``<name>_own``. An empty table gives an empty one.
    """
    renamed = dict(zip(TOKENS, unused(docs, *[f"{c}_own" for c in TOKENS]), strict=True))
    own = docs.select(*[F.col(f"`{c}`").alias(renamed.get(c.lower(), c)) for c in docs.columns])
    coded = bpe.bpe_encode(own, *bpe.production(), carry=True, digest=True)
    whole = coded.withColumns({"ids_sha256": F.sha2("ids", 256), "decoded_sha256": F.lower(F.hex("decoded"))}).drop("decoded")
    kept = [c for c in docs.columns if c.lower() == "decoded"]
    return whole.withColumnsRenamed({renamed["decoded"]: c for c in kept})


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("ngram_jaccard_join", near),
    ("benchmark_decontamination", clean_of_benchmarks),
    ("byte_bpe", tokens),
]

ORACLE_SQL = None
"""Neither a learned classifier nor BPE can be put in SQL; the tests hold the stages against brute force."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
