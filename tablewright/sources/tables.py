"""Parquet tables of one data directory, read by Spark alone so that any file system works."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table ``name`` of ``directory``; columns and filters are pruned by the scan."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share, or where none is set below the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/tablewright-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut", group_rows: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: several branches can follow without planning or computing it anew.

    With ``group_rows``, a row group has so many rows at most. A task holds a row group when it writes and a batch of one when it reads,
    and Parquet counts bytes only after 100 rows, so rows of megabytes must be bounded by their number.
    """
    path = shared_path(df.sparkSession, name)
    written = df.write.option("parquet.block.row.count.limit", group_rows) if group_rows else df.write
    written.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_BYTES = 4 << 20
"""Bytes of rows that go to a Python worker at once, about; 10,000 rows of any length would be Spark's own measure."""
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession) -> None:
    """Bound the bytes of the session's Arrow batches, unless it has a tighter bound."""
    now = spark.conf.get(_BATCH_CONF).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


SPREAD_BYTES = 32 << 20
"""Estimated bytes of a table that one task would read, on a cluster of any size."""


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if it is small: one task would read a small file's only row group and do all that follows alone.

    Larger inputs, by the optimizer's estimate, have row groups enough and are left where they are.
    """
    spark = df.sparkSession
    small = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= SPREAD_BYTES
    return df.repartition(spark.sparkContext.defaultParallelism) if small else df
