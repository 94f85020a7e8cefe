"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import chunks, released, shingles, whole_texts

THRESHOLD = 75
"""Per cent of an item's shingles that a document must hold."""
BLOCK_SHINGLES = 2_000_000
"""Shingles of the items broadcast at once, about 16 MB; more items are searched in several passes of this size."""
SMALL = 4
"""log2 of the shingles up to which an item counts as small."""
BINS, SMALL_BINS = 7, 16
"""log2 of the bins of a signature, and of a small item's: it has few shingles, so each needs a bin of its own."""
NONE = np.uint64((1 << 64) - 1)


class Index:
    """Signatures of one block of items, by size partition.

    Partition p holds the items of 2^(p-1) < n <= 2^p distinct shingles. Its domain on the document side
    is every window of 2^(p+1) shingles at a stride of 2^p, so a passage as long as an item lies in one
    window and the containment of the item in a long document becomes a containment in a set of like
    size. A signature is a one-permutation MinHash: the smallest hash of each of 2^BINS bins, at most 128
    numbers however long the item. An item with three quarters of its shingles in a window has some ten entries
    or more in common with it (with the window's Jaccard similarity of 0.17 at worst, 0.17 x 128); one is enough for a candidate,
    so about one passage in 10^8 is missed. ``contamination`` verifies candidates exactly.
    """

    def __init__(self, items: list[tuple[int | None, np.ndarray]]):
        self.items = [(item, own) for item, own in items if len(own)]
        parts: dict[int, list[int]] = {}
        for k, (_, own) in enumerate(self.items):
            parts.setdefault(max(0, int(len(own) - 1).bit_length()), []).append(k)
        self.parts = []
        for p, ks in sorted(parts.items()):
            signatures = [minima(self.items[k][1], self.bins(p)) for k in ks]
            hashes, owner = np.concatenate(signatures), np.repeat(np.array(ks, np.int64), [len(x) for x in signatures])
            order = np.argsort(hashes, kind="stable")
            hashes, owner = hashes[order], owner[order]
            marks = np.zeros(1 << 22, bool)
            marks[(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
            self.parts.append((p, marks, hashes, owner))

    @staticmethod
    def bins(p: int) -> int:
        return SMALL_BINS if p <= SMALL else BINS

    def candidates(self, row: np.ndarray, hashes: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Unique (row, item number) pairs with a common signature entry; rows' shingles lie at first .. first + count.

        A shingle that is an entry of some item is one of a window too if it is the smallest of its bin there. A window is two
        neighbouring blocks, so the smallest of each block and bin are found once, by one sort of the rows that have such shingles.
        """
        pairs = [np.zeros((0, 2), np.int64)]
        place = (hashes & np.uint64((1 << 22) - 1)).astype(np.int64)
        for p, marks, known, owner in self.parts:
            at = np.flatnonzero(marks[place])
            left = np.searchsorted(known, hashes[at], side="left")
            right = np.searchsorted(known, hashes[at], side="right")
            at, left, right = at[right > left], left[right > left], right[right > left]
            if not len(at):
                continue
            width, bits = 1 << p, self.bins(p)
            met = np.zeros(len(first), bool)
            met[row[at]] = True
            base = np.cumsum(count // width + 2) - count // width  # a free number between the blocks of two rows
            key = lambda q: (base[row[q]] + (q - first[row[q]]) // width << bits) | (hashes[q] >> np.uint64(64 - bits)).astype(np.int64)  # noqa: E731, B023
            inside = np.flatnonzero(met[row])
            keys = key(inside)
            order = np.lexsort((hashes[inside], keys))
            keys = keys[order]
            edge = np.concatenate([[True], keys[1:] != keys[:-1]])
            keys, least = keys[edge], hashes[inside][order][edge]

            def smallest(of: np.ndarray, keys=keys, least=least) -> np.ndarray:
                spot = np.minimum(np.searchsorted(keys, of), len(keys) - 1)
                return np.where(keys[spot] == of, least[spot], NONE)

            own, here = hashes[at], key(at)
            ok = (own <= smallest(here)) & ((own <= smallest(here + (1 << bits))) | (own <= smallest(here - (1 << bits))))
            at, left, size = at[ok], left[ok], (right - left)[ok]
            rows = np.repeat(row[at], size)
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            pairs.append(np.column_stack([rows, owner[np.repeat(left, size) + inner]]))
        return np.unique(np.concatenate(pairs), axis=0)

    def search(self, data: np.ndarray, offsets: np.ndarray, threshold: int) -> Iterator[tuple[int, int | None, int, int]]:
        """(row, item id, shingles of the item, shared shingles) of every verified pair."""
        row, hashes = shingles(data, offsets)
        count = np.bincount(row, minlength=len(offsets) - 1)
        first = np.cumsum(count) - count
        last, held = -1, None
        for r, k in self.candidates(row, hashes, first, count).tolist():
            if r != last:
                last, held = r, np.unique(hashes[first[r] : first[r] + count[r]])
            item, own = self.items[k]
            spot = np.minimum(np.searchsorted(held, own), len(held) - 1)
            shared = int((held[spot] == own).sum())
            if 100 * shared >= threshold * len(own):
                yield r, item, len(own), shared


def minima(hashes: np.ndarray, bins: int) -> np.ndarray:
    """The smallest hash of each of 2^bins bins by the leading bits; ``hashes`` are sorted."""
    lead = hashes >> np.uint64(64 - bins)
    return hashes[np.concatenate([[True], lead[1:] != lead[:-1]])] if len(hashes) else hashes


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: int = THRESHOLD, block: int = BLOCK_SHINGLES) -> DataFrame:
    """Pairs of a document and an item of which it holds ``threshold`` per cent of the distinct 5-word shingles.

    Words are runs other than white space, A-Z in lower case; an item of fewer than five words is one
    shingle, its whole sequence, and matches only documents that are that sequence. Returns ``doc_id``,
    ``item_id``, ``item_shingles``, ``shared``, ``containment``, one row per pair and per repeated row;
    documents and items without words (null or empty) never match; rows without identifier match with a null
    one. Equal items each match, and ties need no order. Whole documents of any length are
    searched in place, without a shuffle, in memory that grows with the longest document: the items are broadcast in blocks of about
    ``block`` shingles, counted first, and each block is one pass. Other columns stay out; empty tables give an empty result.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, item_shingles long, shared long, containment double"

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, offsets in chunks(batches):
            row, hashes = shingles(data, offsets)
            cut = np.searchsorted(row, np.arange(len(ids) + 1))
            own = [np.unique(hashes[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
            yield pa.record_batch([ids, pa.array([len(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], names=["item_id", "n", "set"])

    known = whole_texts(items, item_col, item_text_col).mapInArrow(sets, "item_id long, n long, set binary").persist()
    blocks = max(1, -(-int(known.agg(F.sum("n")).first()[0] or 0) // block))
    found = None
    for k in range(blocks):
        rows = known.filter(F.pmod(F.xxhash64("item_id", "set"), F.lit(blocks)) == k).select("item_id", "set").collect()
        shared = spark.sparkContext.broadcast([(r["item_id"], bytes(r["set"])) for r in rows])

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index([(i, np.frombuffer(s, np.uint64)) for i, s in shared.value])
            for ids, data, offsets in chunks(batches):
                hits = list(index.search(data, offsets, threshold))
                if hits:
                    at, item, n, both = (list(x) for x in zip(*hits, strict=True))
                    n, both = np.array(n, np.int64), np.array(both, np.int64)
                    yield pa.record_batch([ids.take(pa.array(at)), pa.array(item, pa.int64()), pa.array(n), pa.array(both), pa.array(both / n)], names=["doc_id", "item_id", "item_shingles", "shared", "containment"])

        one = whole_texts(docs, id_col, text_col).mapInArrow(released(work), schema)
        found = one if found is None else found.unionByName(one)
    known.unpersist()
    return found


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """All contaminated documents with the benchmark items they hold."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return contamination(read("documents"), read("benchmark"))


SQL = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark
), places AS (
  SELECT side, id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM words WHERE len(w) > 0
), sets AS (
  SELECT DISTINCT side, id, list_aggregate(w[p:least(p + 4, len(w))], 'string_agg', ' ') AS s FROM places
), sizes AS (
  SELECT id AS item_id, count(*) AS item_shingles FROM sets WHERE side = 'b' GROUP BY id
), both_sides AS (
  SELECT d.id AS doc_id, b.id AS item_id, count(*) AS shared
  FROM sets d JOIN sets b ON d.s = b.s AND d.side = 'd' AND b.side = 'b' GROUP BY d.id, b.id
)
SELECT doc_id, item_id, item_shingles, shared, shared / item_shingles AS containment
FROM both_sides JOIN sizes USING (item_id) WHERE 100 * shared >= 75 * item_shingles
"""
