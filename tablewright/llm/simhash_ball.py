"""SimHash near-duplicates by meet-in-the-middle ball hashing: variants within half the radius meet in shards."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.components import components
from tablewright.llm.shared import _LOWER, chunks, materialise, released, whole_texts, words

RADIUS = 4
SHINGLE_WORDS = 4
SEED = 42
BITS = 64
SHARD_VARIANTS = 1 << 22
"""Variants that a shard makes, about; the number of shards follows from it and the counted fingerprints."""
LEAST_SHARD_BITS = 6
LONG_SPAN = 512
"""Bytes beyond which a shingle is hashed alone."""
BLOCK = 1 << 18
"""Shingles whose bits are counted at once."""

# The primes of XXH64.
P1 = 0x9E3779B185EBCA87
P2 = 0xC2B2AE3D27D4EB4F
P3 = 0x165667B19E3779F9
P4 = 0x85EBCA77C2B2AE63
P5 = 0x27D4EB2F165667C5

_MASK = (1 << 64) - 1
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
"""The eight bits of a byte as eight byte-wide counters."""


def _u(x: int) -> np.uint64:
    return np.uint64(x & _MASK)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * _u(P2), 31) * _u(P1)


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of each byte span; spans of one length are hashed together, lane by lane."""
    out = np.zeros(len(starts), np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at8 = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    at4 = np.ndarray((len(data) + 1,), "<u4", padded, strides=(1,))
    size = ends - starts
    order = np.argsort(size, kind="stable")
    lengths, firsts = np.unique(size[order], return_index=True)
    for n, one, last in zip(lengths.tolist(), firsts, [*firsts[1:], len(order)], strict=True):
        rows = order[one:last]
        at = starts[rows]
        if n > LONG_SPAN:
            out[rows] = [xxhash.xxh64_intdigest(data[a : a + n].tobytes(), seed) for a in at.tolist()]
            continue
        k = 0
        if n >= 32:
            acc = [np.full(len(at), _u(seed + x), np.uint64) for x in (P1 + P2, P2, 0, -P1)]
            while k + 32 <= n:
                acc = [_round(v, at8[at + (k + 8 * i)]) for i, v in enumerate(acc)]
                k += 32
            h = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
            for v in acc:
                h = (h ^ _round(np.zeros_like(v), v)) * _u(P1) + _u(P4)
        else:
            h = np.full(len(at), _u(seed + P5), np.uint64)
        h = h + _u(n)
        while k + 8 <= n:
            h = _turn(h ^ _round(np.zeros_like(h), at8[at + k]), 27) * _u(P1) + _u(P4)
            k += 8
        if k + 4 <= n:
            h = _turn(h ^ at4[at + k].astype(np.uint64) * _u(P1), 23) * _u(P2) + _u(P3)
            k += 4
        while k < n:
            h = _turn(h ^ data[at + k].astype(np.uint64) * _u(P5), 11) * _u(P1)
            k += 1
        h = (h ^ (h >> np.uint64(33))) * _u(P2)
        h = (h ^ (h >> np.uint64(29))) * _u(P3)
        out[rows] = h ^ (h >> np.uint64(32))
    return out


def joined_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words in lower case with one blank after each, and of each word its row, start and end there."""
    row, starts, ends = words(data, offsets)
    if not len(row):
        return np.zeros(0, np.uint8), row, starts, ends
    size = ends - starts
    new = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    flat = np.full(int(new[-1] + size[-1] + 1), 32, np.uint8)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    flat[np.repeat(new, size) + inside] = _LOWER[data[np.repeat(starts, size) + inside]]
    return flat, row, new, new + size


def fingerprints(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """The SimHash of each row: a bit is set if more than half of the row's shingle hashes have it; a row without words gives 0."""
    rows = len(offsets) - 1
    flat, row, starts, ends = joined_words(data, offsets)
    counts, totals = np.zeros((rows, BITS), np.int64), np.zeros(rows, np.int64)
    if len(row):
        of_row = np.bincount(row, minlength=rows)
        first = np.concatenate([[0], np.cumsum(of_row)])
        size = np.minimum(of_row, width)
        at = np.flatnonzero(np.arange(len(row)) <= (first[1:] - size)[row])
        for a in range(0, len(at), BLOCK):
            part = at[a : a + BLOCK]
            of = row[part]
            hashed = xxh64(flat, starts[part], ends[part + size[of] - 1], seed)
            lanes = _LANES[hashed.astype("<u8").view(np.uint8)].reshape(-1, 8)
            new = np.flatnonzero(np.diff(of, prepend=-1))
            since = np.arange(len(of)) - np.repeat(new, np.diff(np.append(new, len(of))))
            cuts = np.flatnonzero(since % 255 == 0)  # a byte-wide counter holds 255
            sums = np.add.reduceat(lanes, cuts, axis=0).view(np.uint8).reshape(len(cuts), BITS)
            np.add.at(counts, of[cuts], sums)
            totals += np.bincount(of, minlength=rows)
    bits = (2 * counts > totals[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def ball(radius: int) -> np.ndarray:
    """All masks of at most ``radius`` bits."""
    return np.array([sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(BITS), n)], np.uint64)


def folded(x: np.ndarray, bits: int) -> np.ndarray:
    """The exclusive or of all runs of ``bits`` bits: linear, so a variant's shard is its fingerprint's xor its mask's."""
    out, low = np.zeros_like(x), np.uint64((1 << bits) - 1)
    for by in range(0, BITS, bits):
        out ^= (x >> np.uint64(by)) & low
    return out


def fold_sql(column: str, bits: int) -> F.Column:
    out = F.lit(0).cast("long")
    for by in range(0, BITS, bits):
        out = out.bitwiseXOR(F.shiftrightunsigned(F.col(column), by).bitwiseAND(F.lit((1 << bits) - 1)))
    return out


def met(found: np.ndarray, shard: int, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the distinct fingerprints of a shard, each with the smallest one that it is linked with by variants of this shard.

    All variants within ``radius`` that fall into the shard are sorted; fingerprints of one variant collide. A colliding
    pair is verified by its differing bits. Two neighbours in the sorted variants stand for their run, as all fingerprints
    of one variant differ in 2 ``radius`` bits at most, so a run costs its length, not its square.
    """
    masks = ball(radius)
    need = folded(masks, bits)
    own = folded(found, bits)
    by_need, by_own = np.argsort(need, kind="stable"), np.argsort(own, kind="stable")
    variants, makers = [], []
    for t in np.unique(own).tolist():
        lo, hi = np.searchsorted(need[by_need], [np.uint64(t ^ shard), np.uint64((t ^ shard) + 1)])
        a, b = np.searchsorted(own[by_own], [np.uint64(t), np.uint64(t + 1)])
        who = by_own[a:b]
        variants.append((found[who][:, None] ^ masks[by_need[lo:hi]][None, :]).ravel())
        makers.append(np.repeat(who.astype(np.int32), hi - lo))
    made, who = np.concatenate(variants), np.concatenate(makers)
    order = np.argsort(made)
    same = np.flatnonzero(made[order][1:] == made[order][:-1])
    x, y = who[order[same]].astype(np.int64), who[order[same + 1]].astype(np.int64)
    pairs = np.unique(np.minimum(x, y) * len(found) + np.maximum(x, y))
    x, y = pairs // len(found), pairs % len(found)
    near = np.bitwise_count(found[x] ^ found[y]) <= 2 * radius
    x, y = x[near], y[near]
    label = np.arange(len(found))
    while True:  # the smallest label spreads over the pairs, and labels take their own label
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    linked = np.flatnonzero(label != np.arange(len(found)))
    return found[linked], found[label[linked]]


def links(prints: DataFrame, radius: int = RADIUS, shard_variants: int = SHARD_VARIANTS) -> DataFrame:
    """``a``, ``b``: links between distinct fingerprints (``fp``, long) that connect all that differ in ``radius`` bits at most.

    Every fingerprint has all variants within half the radius, which must be even; two fingerprints within the radius
    share one. Variants are dealt to shards by a fold of their bits; as the fold is linear, a fingerprint itself goes to each
    shard that its variants fall into, once, and the shard makes its variants there: the bytes that travel are those
    of some dozens of fingerprints instead of 2081 variants. The number of shards follows from the counted fingerprints.
    Links between fingerprints of one component of a shard are given as links to its smallest. Empty input: no rows.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    half = radius // 2
    masks = ball(half)
    bits = max(LEAST_SHARD_BITS, math.ceil(math.log2(max(1, prints.count() * len(masks) / shard_variants))))
    steps = sorted(set(folded(masks, bits).tolist()))
    dealt = prints.select("fp", F.explode(F.lit(np.array(steps, np.int64).tolist())).alias("_step"), fold_sql("fp", bits).alias("_own"))
    dealt = dealt.select(F.col("_own").bitwiseXOR(F.col("_step")).alias("shard"), "fp")

    def collide(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        found = np.sort(rows.column("fp").to_numpy().view(np.uint64))
        a, b = met(found, key[0].as_py(), bits, half)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt.groupBy("shard").applyInArrow(collide, "a long, b long")


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint's 64 bits as a long) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, offsets in chunks(batches):
            yield pa.record_batch({"doc_id": ids, "fp": fingerprints(data, offsets, width).view(np.int64)})

    return whole_texts(docs, id_col, text_col).mapInArrow(released(work), "doc_id long, fp long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, width: int = SHINGLE_WORDS, shard_variants: int = SHARD_VARIANTS) -> DataFrame:
    """Every row's SimHash fingerprint and the component of rows that links of at most ``radius`` differing bits reach.

    Texts are lower-cased (A-Z), cut into words at 09-0D and 20 hex and into shingles of ``width`` words, repeats included;
    fewer words are one shingle, none give fingerprint zero, which links like any other. ``radius`` must be even.
    Equal fingerprints are one node, so groups of copies, however large, cost one row in the search. Exact: no link is lost.

    Returns ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` (smallest doc_id of the component). A null text
    counts as empty. A null doc_id keeps its row and its links, and is never the smallest unless its component has no other.
    Repeated rows each keep a row. Other columns are not read; an empty table gives an empty result.
    """
    own = materialise(simhash(docs, id_col, text_col, width), "simhash")
    prints = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    labels = components(links(prints.select("fp"), radius, shard_variants), "balls")
    grouped = prints.join(labels, prints["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    least = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    answer = grouped.join(least, "label").select("fp", "component_id")
    return own.join(answer, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_simhash(spark, sf_dir: str) -> DataFrame:
    """The contract's query over all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
