"""Tables of record vectors with their metadata, written and read as Parquet."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA = ("record_id", "page", "table_id", "item", "section", "subsection", "parameter", "sub_parameter", "side", "values")


def encoded(texts: DataFrame, encode: Callable[[list[str]], np.ndarray], text: str = "text") -> DataFrame:
    """``texts`` with ``embedding``: what ``encode`` gives for each batch of texts, on the executors; a null text counts as empty."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            vectors = np.asarray(encode(rows[text].fillna("").tolist()), np.float32) if len(rows) else []
            yield rows.assign(embedding=[list(map(float, v)) for v in vectors])

    return texts.mapInPandas(work, f"{kinds}, embedding array<float>")


def write_vectors(records: DataFrame, vectors: DataFrame, path: str) -> None:
    """Write the vectors (``record_id``, ``embedding``) of ``records`` with ``vector_id``, the record's place ``ord``, and its metadata.

    The table is the index: search reads it whole, so no second file can go out of step with it. What is there is replaced.
    """
    own = [c for c in METADATA if c in records.columns]
    records.select(F.col("ord").alias("vector_id"), *own).join(vectors.select("record_id", "embedding"), "record_id").write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``write_vectors`` wrote; a missing one raises Spark's own error."""
    return spark.read.parquet(path)
