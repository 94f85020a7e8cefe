"""What the operators share: the cluster's shared folder, Arrow batches as byte arrays, word hashes."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.sources.tables import bounded, spread

CHUNK_BYTES = 2 << 20
"""Bytes of text handled at once; a longer text is a chunk of its own."""

_MASK = (1 << 64) - 1


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, the folder that driver and executors share.

    Where the cluster names none (tests), the warehouse folder serves.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/tablewright-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df`` by a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _text) of every row; a null text counts as empty, other columns are left behind."""
    bounded(df.sparkSession)
    return spread(df).select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))


def carried(df: DataFrame, text_col: str) -> DataFrame:
    """The whole row as ``_id``, for operators that pass rows through; ``_text`` beside it only where the column is no string.

    ``chunks`` reads the text of such rows from the row itself, so it goes to Python once.
    """
    bounded(df.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_id")
    df = spread(df)
    return df.select(row) if df.schema[text_col].dataType == T.StringType() else df.select(row, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))


def released(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work``, after which the worker gives back the memory that it holds free, as it may idle beside other stages' workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        release()

    return run


def release() -> None:
    """Give free memory of this process back to the system."""
    _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def opened(df: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """The carried row's columns and ``columns``, which win where names clash."""
    own = [f.name for f in df.schema[row].dataType.fields if f.name not in columns]
    return df.select(*[F.col(row)[c].alias(c) for c in own], *columns)


BROADCAST_ROWS = 500_000
"""Rows of an identifier, or a key and a count, that may be broadcast: 16 MB at most."""


def small(df: DataFrame, name: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` written once, and marked for broadcast if its counted rows allow it; beyond, joins shuffle."""
    written = materialise(df, name)
    return F.broadcast(written) if written.count() <= most else written


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary array and the offset of each value, nulls as empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, marks, data = column.buffers()
    if len(column) == 0 or marks is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(marks, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], most: int = CHUNK_BYTES, text: str = "") -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, bytes, offsets) of (_id, _text) batches, or of carried rows with the column ``text``, cut between rows at about ``most`` bytes."""
    for batch in batches:
        data, offsets = buffers(batch.column(1) if batch.num_columns > 1 else batch.column(0).field(batch.column(0).type.get_field_index(text)))
        at, rows = 0, batch.num_rows
        while at < rows:
            to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
            to = min(rows, max(to, at + 1))
            yield batch.column(0).slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (a public finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SYMBOL = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SYMBOL_LOWER = _SYMBOL[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each byte span, from one prefix sum of a polynomial modulo 2^64."""
    n = len(data)
    up, down = _powers_to(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_SYMBOL_LOWER if lower else _SYMBOL)[data] * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(_INVERSE))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes other than 09-0D and 20 hex in each row: row number, start, end."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~_SPACE[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    cuts = offsets[1:-1]
    before[cuts[cuts < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    after[cuts[cuts > 0] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return np.searchsorted(offsets, starts, side="right") - 1, starts, ends


SHINGLE_WORDS = 5


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``width`` words, in order; a row of fewer words gives its whole sequence once."""
    rows = len(offsets) - 1
    row, starts, ends = words(data, offsets)
    hashed = span_hashes(data, starts, ends)
    count = np.bincount(row, minlength=rows)
    total = np.zeros(len(hashed), np.uint64)
    # a window starting at i takes words i .. i + size - 1 of its row
    first = np.concatenate([[0], np.cumsum(count)])
    size = np.minimum(count, width)
    keep = np.arange(len(hashed)) <= (first[1:] - size)[row] if len(hashed) else np.zeros(0, bool)
    at, of = np.flatnonzero(keep), row[keep]
    for k in range(width):
        step = np.uint64(((2 * k + 3) * _BASE | 1) & _MASK)
        there = at[size[of] > k] if k else at
        total[there] += mix(hashed[there + k] + np.uint64(k + 1)) * step
    return of, mix(total[at] + size[of].astype(np.uint64))
