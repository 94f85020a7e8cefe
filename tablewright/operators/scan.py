"""Segmented prefix scans: each block of a segment is scanned on its own, and the states of the blocks before it are handed in."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.sources.tables import cut

BLOCK_ROWS = 1 << 16
"""Positions of a block."""


@dataclass(frozen=True)
class State:
    """A running value over the rows of a segment, the row itself included.

    ``kind`` names the associative operation: ``last`` (the last value that is not null), ``sum``, ``xor``
    (integers; null counts as 0). ``value`` is the row's own contribution.
    """

    name: str
    kind: str
    value: Column


def block_of(position: Column, rows: int = BLOCK_ROWS) -> Column:
    """The block of a position counted from 0; positions that are unique give blocks of at most ``rows`` rows."""
    return F.floor(position / F.lit(rows)).cast("long")


def range_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "_block") -> DataFrame:
    """``df`` written once in ranges of ``keys`` and ``order``, with the range's number as ``name``: blocks of any segment, however its positions lie.

    A segment that holds most rows lies in as many ranges as its rows need. Rows that tie in all of ``order`` share a range.
    """
    ranged = df.repartitionByRange(*[F.col(f"`{c}`") for c in keys], *[F.col(f"`{c}`") for c in order])
    return cut(ranged.withColumn(name, F.spark_partition_id().cast("long")), "ranges")


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], states: Sequence[State], block: Column) -> DataFrame:
    """``df`` with the running value of each of ``states`` within each segment (``keys``) in ``order``.

    ``block`` cuts a segment into runs that follow each other in ``order``, and must not decrease along it. A task holds a block,
    never a segment, so a segment of any length is scanned by many tasks: (1) every block is reduced to its states, (2) the
    states of the blocks before each block are combined in block order, one row a block, (3) they are joined back and each
    row continues from them. Rows whose order ties within a block follow each other in no set order.

    Null keys are a segment of their own; nulls come first in the order. An empty table gives an empty result. Columns of
    ``df`` that have the name of a state are replaced; names that begin with ``_scan`` must not occur in it.
    """
    hidden = [f"_scan{k}" for k in range(len(states))]
    left = [c for c in df.columns if c not in {s.name for s in states}]
    base = df.select(
        *[F.col(f"`{c}`") for c in left],
        F.struct(*[F.col(f"`{k}`") for k in keys], F.lit(0).alias("_scan_none")).alias("_scan_key"),
        F.struct(*[F.col(f"`{c}`") for c in order]).alias("_scan_at"),
        block.alias("_scan_block"),
        *[s.value.alias(h) for s, h in zip(states, hidden, strict=True)],
    )

    def reduced(kind: str, name: str) -> Column:
        if kind == "last":
            return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("_scan_at")))
        return F.sum(name) if kind == "sum" else F.bit_xor(name)

    def over(kind: str, name: str, window) -> Column:
        one = F.last(name, ignorenulls=True) if kind == "last" else F.sum(name) if kind == "sum" else F.bit_xor(name)
        return one.over(window)

    def joined(kind: str, before: Column, own: Column) -> Column:
        if kind == "last":
            return F.coalesce(own, before)
        before, own = F.coalesce(before, F.lit(0)), F.coalesce(own, F.lit(0))
        return before + own if kind == "sum" else before.bitwiseXOR(own)

    kinds = [s.kind for s in states]
    parts = base.groupBy("_scan_key", "_scan_block").agg(*[reduced(k, h).alias(h) for k, h in zip(kinds, hidden, strict=True)])
    earlier = Window.partitionBy("_scan_key").orderBy("_scan_block").rowsBetween(Window.unboundedPreceding, -1)
    handed = parts.select("_scan_key", "_scan_block", *[over(k, h, earlier).alias(f"{h}b") for k, h in zip(kinds, hidden, strict=True)])
    inside = Window.partitionBy("_scan_key", "_scan_block").orderBy("_scan_at").rowsBetween(Window.unboundedPreceding, 0)
    own = base.join(handed, ["_scan_key", "_scan_block"]).withColumns({f"{h}o": over(k, h, inside) for k, h in zip(kinds, hidden, strict=True)})
    return own.select(
        *[F.col(f"`{c}`") for c in left],
        *[joined(s.kind, F.col(f"{h}b"), F.col(f"{h}o")).alias(s.name) for s, h in zip(states, hidden, strict=True)],
    )
