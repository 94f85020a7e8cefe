"""Language-model scoring with an n-gram trie in Elias-Fano coded, memory-mapped shards."""

from __future__ import annotations

import mmap
import os
import struct
import tempfile
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.elias_fano import EliasFano, search
from tablewright.llm.langid import held_out
from tablewright.llm.shared import chunks, mix, released, shared_dir, span_hashes, whole_texts, words

SHARD_TEXT = 8 << 20
"""Bytes of training text whose n-grams make one shard, on average; the number of shards follows the corpus."""
ORDER = 3
"""Words of the longest n-grams; 2 or more."""
STRENGTH = 200.0
"""Pseudo-count of the unigram distribution in each word's context (Dirichlet smoothing)."""
DEEP_STRENGTH = 20.0
"""Pseudo-count of the shorter context's distribution in each longer context."""
SPLIT = 16
"""Parts of a word's successors; they lie in different shards, so no word's successors fill one."""
CONTEXT_BITS = 48
SUCCESSOR_BITS = 32
DEEP_BITS = 24
"""Bits kept of the hash of a context's part, a pair's successor and a longer n-gram's. What a false match adds to a probability is 2^-bits at most on average, as the probabilities of a context's successors sum to 1."""
COUNT_TEXT = 4 << 20
"""Bytes of text whose n-grams are counted at once, about."""
END = np.uint64(0x0E0D0E0D0E0D0E0D)
MAGIC = b"EFNGRAM3"

# Counts are quantised downwards to 8 bits: 1 to 64 exactly, then geometrically up to 10^13.
RATIO = 1.145
LEVELS = np.concatenate([np.arange(1, 65), 64 * np.exp(np.arange(1, 193) * np.log(RATIO))])


# Smoothed probabilities are quantised downwards to 8 bits: 0, then 10^-9 to 1 in equal ratios.
PROBABILITIES = np.concatenate([[0.0], np.geomspace(1e-9, 1, 255)])


def quantised(counts: np.ndarray) -> np.ndarray:
    """Codes of counts of 1 and more: the largest level that is not above the count."""
    return (np.searchsorted(LEVELS, counts, side="right") - 1).astype(np.uint8)


def at_most(seen: np.ndarray) -> np.ndarray:
    """What a count that was quantised to ``seen`` can have been at most; 0 stays."""
    return np.where(seen < 64, seen, seen * RATIO)


def quantised_probability(p: np.ndarray) -> np.ndarray:
    """Codes of probabilities: the largest level that is not above."""
    return (np.searchsorted(PROBABILITIES, p, side="right") - 1).astype(np.uint8)


def narrow(values: np.ndarray) -> bytes:
    """Numbers below 2^32, one byte each; those of 255 and more have 255 and stand behind, four bytes each."""
    return np.minimum(values, 255).astype(np.uint8).tobytes() + values[values >= 255].astype("<u4").tobytes()


def widened(raw: pa.Buffer, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<u4", offset=n) if len(raw) > n else 0
    return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the words of each row, A-Z in lower case, and of its end, in order."""
    rows = len(offsets) - 1
    row, starts, ends = words(data, offsets)
    hashed = span_hashes(data, starts, ends)
    count = np.bincount(row, minlength=rows)
    out = np.full(len(row) + rows, END, np.uint64)
    out[np.arange(len(row)) + row] = hashed
    return np.repeat(np.arange(rows), count + 1), out


def pairs_of(row: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Positions of the tokens that have another before them in their row."""
    return np.flatnonzero(row[1:] == row[:-1]) + 1


def context(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The hash of the part of a context that holds a successor."""
    return mix(before + (after >> np.uint64(60)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SPLIT)) >> np.uint64(64 - CONTEXT_BITS)


def low_part(after: np.ndarray) -> np.ndarray:
    return after & np.uint64((1 << SUCCESSOR_BITS) - 1)


def deep_part(after: np.ndarray) -> np.ndarray:
    return after & np.uint64((1 << DEEP_BITS) - 1)


def shard_of(hashed: np.ndarray, shards: int, bits: int = 64) -> np.ndarray:
    return ((hashed >> np.uint64(bits - 32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def little(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bytes of each number."""
    return np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def unpacked(raw: np.ndarray, width: int) -> np.ndarray:
    """The numbers whose low bytes ``little`` took."""
    wide = np.zeros((len(raw) // width, 8), np.uint8)
    wide[:, :width] = raw.reshape(-1, width)
    return wide.view("<u8").reshape(-1).astype(np.uint64)


def gathered(batches: Iterator[pa.RecordBatch], least: int = COUNT_TEXT) -> Iterator[pa.RecordBatch]:
    """The batches joined until they have ``least`` bytes, so that more n-grams are counted where they are met."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= least:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def counted(first: np.ndarray, second: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct pairs with their summed counts, and for each given pair the index of its own."""
    order = np.lexsort((second, first))
    first, second, count = first[order], second[order], count[order]
    edge = np.ones(len(first), bool)
    edge[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    at = np.flatnonzero(edge)
    own = np.empty(len(order), np.int64)
    own[order] = np.cumsum(edge) - 1
    return first[at], second[at], np.add.reduceat(count, at) if len(at) else count, own


def deeper(parent: np.ndarray, after: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One level further: sorted distinct (parent's index, successor) with their summed counts, and each given one's own index."""
    key = parent.astype(np.uint64) << np.uint64(DEEP_BITS) | deep_part(after)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    edge = np.ones(len(key), bool)
    edge[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(edge)
    own = np.empty(len(order), np.int64)
    own[order] = np.cumsum(edge) - 1
    return (key[at] >> np.uint64(DEEP_BITS)).astype(np.int64), deep_part(key[at]), np.add.reduceat(count, at) if len(at) else count, own


def padded(values: np.ndarray) -> bytes:
    raw = values.tobytes()
    return raw + bytes(-len(raw) % 8)


def shard_bytes(word: np.ndarray, count: np.ndarray, ctx: np.ndarray, successor: np.ndarray, together: np.ndarray, deep: list[tuple[np.ndarray, np.ndarray, np.ndarray]], strength: float) -> bytes:
    """One shard: words with exact counts; contexts of one word, pointers to their successors, successors, quantised
    counts; then for each level below pointers from the level above, successors and quantised smoothed probabilities.

    Counts of words are stored as the differences of a monotone sequence and pointers as one. A level below belongs to
    the entries of the level above by their rank: an entry's successors are those between its pointer and the next,
    in rising order of their bits of hash. Their probabilities are c / (c of the context + ``strength``). A level that
    has another one below keeps quantised counts too, from which that one's contexts get their weights.
    """
    base = (int(word[0]) if len(word) else 0, int(ctx[0]) if len(ctx) else 0)
    edge = np.ones(len(ctx), bool)
    edge[1:] = ctx[1:] != ctx[:-1]
    parts = [
        EliasFano.build(word - np.uint64(base[0])).to_bytes(),
        EliasFano.build(np.concatenate([[0], np.cumsum(count)])).to_bytes(),
        EliasFano.build(ctx[edge] - np.uint64(base[1])).to_bytes(),
        EliasFano.build(np.append(np.flatnonzero(edge), len(ctx))).to_bytes(),
        padded(successor.astype(np.uint32)),
        padded(quantised(together)),
    ]
    above = together
    for parent, after, both in deep:
        parts += [
            EliasFano.build(np.searchsorted(parent, np.arange(len(above) + 1))).to_bytes(),
            padded(after.astype(np.uint16)),
            padded((after >> np.uint64(16)).astype(np.uint8)),
            padded(quantised_probability(both / (above[parent] + strength))),
            padded(quantised(both)) if deep[-1][0] is not parent else b"",
        ]
        above = both
    head = struct.pack("<6Q", *base, int(count.sum()), len(word), len(deep), struct.unpack("<Q", struct.pack("<d", strength))[0])
    return MAGIC + head + b"".join(parts)


class Shard:
    """A mapped shard; nothing is copied but the few pages that searches touch."""

    def __init__(self, raw: memoryview):
        if bytes(raw[:8]) != MAGIC:
            raise ValueError("not a shard of an n-gram model")
        self.word_base, self.context_base, self.total, self.distinct, levels, self.strength = struct.unpack_from("<5Qd", raw, 8)
        self.at = 56
        take = lambda kind, n: self._take(raw, kind, n)
        self.words, self.at = EliasFano.read(raw, self.at)
        self.counts, self.at = EliasFano.read(raw, self.at)
        self.contexts, self.at = EliasFano.read(raw, self.at)
        self.pointers, self.at = EliasFano.read(raw, self.at)
        n = int(self.pointers.get(np.array([self.pointers.n - 1]))[0])
        self.successors, self.codes = take(np.uint32, n), take(np.uint8, n)
        self.deep = []
        for k in range(levels):
            pointers, self.at = EliasFano.read(raw, self.at)
            n = int(pointers.get(np.array([pointers.n - 1]))[0])
            self.deep.append((pointers, take(np.uint16, n), take(np.uint8, n), take(np.uint8, n), take(np.uint8, n) if k + 1 < levels else None))

    def _take(self, raw: memoryview, kind: type, n: int) -> np.ndarray:
        values = np.frombuffer(raw, kind, n, self.at)
        self.at += values.nbytes + -values.nbytes % 8
        return values

    def count(self, hashed: np.ndarray) -> np.ndarray:
        """Exact training counts of words; 0 if unknown."""
        out = np.zeros(len(hashed), np.int64)
        ok = np.flatnonzero(hashed >= np.uint64(self.word_base))
        at = self.words.find(hashed[ok] - np.uint64(self.word_base))
        ok, at = ok[at >= 0], at[at >= 0]
        out[ok] = (self.counts.get(at + 1) - self.counts.get(at)).astype(np.int64)
        return out

    def _find(self, pointers: EliasFano, rank: np.ndarray, value, want: np.ndarray) -> np.ndarray:
        """Index of ``want`` among the successors of the contexts ``rank``, else -1."""
        lo, hi = pointers.get(rank).astype(np.int64), pointers.get(rank + 1).astype(np.int64)
        at = search(value, lo, hi, want)
        hit = np.flatnonzero(at < hi)
        hit = hit[value(at[hit]) == want[hit]]
        out = np.full(len(rank), -1, np.int64)
        out[hit] = at[hit]
        return out

    def pair(self, ctx: np.ndarray, successor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair in its level (-1 if unseen) and its quantised count (0)."""
        rank, seen = np.full(len(ctx), -1, np.int64), np.zeros(len(ctx))
        ok = np.flatnonzero(ctx >= np.uint64(self.context_base))
        own = self.contexts.find(ctx[ok] - np.uint64(self.context_base))
        ok, own = ok[own >= 0], own[own >= 0]
        rank[ok] = self._find(self.pointers, own, lambda i: self.successors[i], successor[ok].astype(np.uint32))
        hit = rank >= 0
        seen[hit] = LEVELS[self.codes[rank[hit]]]
        return rank, seen

    def below(self, level: int, parent: np.ndarray, successor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rank, smoothed probability and, where another level follows, quantised count of the successors of ``parent``."""
        pointers, low, high, codes, counts = self.deep[level]
        rank = self._find(pointers, parent, lambda i: low[i] | high[i].astype(np.uint32) << np.uint32(16), successor.astype(np.uint32))
        p, seen, hit = np.zeros(len(rank)), np.zeros(len(rank)), rank >= 0
        p[hit] = PROBABILITIES[codes[rank[hit]]]
        if counts is not None:
            seen[hit] = LEVELS[counts[rank[hit]]]
        return rank, p, seen


def mapped(uri: str) -> memoryview:
    """The bytes of a shared file, mapped. A file that isn't on a mounted path is first copied to the worker's disk and unlinked at once, so it goes with the worker."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        with open(unquote(parts.path), "rb") as f:
            return memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    handle, local = tempfile.mkstemp()
    with os.fdopen(handle, "w+b") as f, system.open_input_stream(path) as source:
        os.unlink(local)
        while block := source.read(1 << 22):
            f.write(block)
        f.flush()
        return memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


class Model:
    """All shards; words and contexts are found in the shard of their hash."""

    def __init__(self, shards: list[memoryview | bytes]):
        self.shards = [Shard(memoryview(s)) for s in shards]
        self.by_word = sorted((s for s in self.shards if s.words.n), key=lambda s: s.word_base)
        self.by_context = sorted((s for s in self.shards if s.contexts.n), key=lambda s: s.context_base)
        self.total = sum(s.total for s in self.shards)
        self.distinct = sum(s.distinct for s in self.shards)
        self.levels = max((len(s.deep) for s in self.shards), default=0)

    @staticmethod
    def _dealt(shards: list[Shard], base: str, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(keys, kind="stable")
        cut = np.append(np.searchsorted(keys[order], np.array([getattr(s, base) for s in shards], np.uint64)), len(keys))
        for number, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
            if b > a:
                yield number, order[a:b]

    def count(self, hashed: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashed), np.int64)
        for number, at in self._dealt(self.by_word, "word_base", hashed):
            out[at] = self.by_word[number].count(hashed[at])
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray, strength: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, known tokens, base score and model score of each row, in log10.

        Counts and probabilities are rounded down, and a context's weight of the shorter one is taken from the largest count that it can have had, so in every
        context the probabilities of all words and one unknown sum to 1 at most.
        """
        rows = len(offsets) - 1
        row, hashed = tokens(data, offsets)
        distinct, place = np.unique(hashed, return_inverse=True)
        count = self.count(distinct)[place]
        unigram = (count + 1) / (self.total + self.distinct + 1)
        p = unigram.copy()
        # the entry that ends at each token: its shard, its rank in its level (-1 if unseen) and its count
        home, rank, seen = np.zeros(len(row), np.int32), np.full(len(row), -1, np.int64), np.zeros(len(row))
        at = pairs_of(row, hashed)
        at = at[(count[at] > 0) & (count[at - 1] > 0)]
        ctx, successor = context(hashed[at - 1], hashed[at]), low_part(hashed[at])
        for number, own in self._dealt(self.by_context, "context_base", ctx):
            there = at[own]
            home[there] = number
            rank[there], seen[there] = self.by_context[number].pair(ctx[own], successor[own])
        after = pairs_of(row, hashed)
        p[after] = (seen[after] + strength * unigram[after]) / (count[after - 1] + strength)
        for level in range(self.levels):
            # a longer entry is sought among the successors of the one that ends a token earlier
            at = after[rank[after - 1] >= 0]
            found, part, more = np.full(len(row), -1, np.int64), np.zeros(len(row)), np.zeros(len(row))
            parent, shard = rank[at - 1], home[at - 1]
            order = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[order], np.arange(len(self.by_context) + 1))
            for number, (a, b) in enumerate(zip(cut, cut[1:], strict=False)):
                if b > a:
                    own = order[a:b]
                    found[at[own]], part[at[own]], more[at[own]] = self.by_context[number].below(level, parent[own], deep_part(hashed[at[own]]))
            deep = self.by_context[0].strength if self.by_context else 0.0
            p[at] = part[at] + deep / (at_most(seen[at - 1]) + deep) * p[at]
            moved = np.zeros(len(row), np.int32)
            moved[at] = shard
            home, rank, seen = moved, found, more
        total = lambda x: np.bincount(row, weights=x, minlength=rows)
        return np.bincount(row, minlength=rows), total(count > 0).astype(np.int64), total(np.log10(unigram)), total(np.log10(p))


@lru_cache(maxsize=1)
def load(paths: tuple[str, ...]) -> Model:
    """The model of one worker: its shards mapped, once."""
    return Model([mapped(p) for p in paths])


def build(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shard_text: int = SHARD_TEXT, order: int = ORDER, deep_strength: float = DEEP_STRENGTH) -> list[str]:
    """Count all n-grams of up to ``order`` words of ``docs`` and write the model's shards below ``path``; returns their URIs.

    A chunk of documents sends each shard its distinct n-grams with counts, so a frequent one costs a shard
    one entry per chunk. An n-gram is in the shard of its first two words, so all levels below the words are one
    trie there. Counts are over all rows and whole texts; the shards' number and bytes grow with the
    corpus. Spark's writer commits the shards (each the one row of a text file), so lost tasks can be run again.
    A null or empty text counts its end alone, repeated rows count each, very long texts are counted whole and other columns are not read.
    An empty table gives a model that knows nothing.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = docs.sparkSession
    rows = whole_texts(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("_text") + 1)).first()[0] or 0
    shards = max(1, -(-size // shard_text))
    names = ["w", "n", "c", "r", "s", "b"] + [f"{x}{k}" for k in range(order - 2) for x in "rsb"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in chunks(gathered(batches), 2 * COUNT_TEXT):
            row, hashed = tokens(data, offsets)
            word, count = np.unique(hashed, return_counts=True)
            at = pairs_of(row, hashed)
            ctx, successor, both, own = counted(context(hashed[at - 1], hashed[at]), low_part(hashed[at]), np.ones(len(at), np.int64))
            deep, above = [], len(ctx)
            for k in range(1, order - 1):
                # n-grams that go on k tokens after their pair; ``own`` is the entry of the level above
                to = at + k
                longer = np.flatnonzero(to < len(row))
                longer = longer[row[to[longer]] == row[at[longer]]]
                parent, after, sums, mine = deeper(own[longer], hashed[to[longer]], np.ones(len(longer), np.int64))
                deep.append((np.searchsorted(parent, np.arange(above + 1)), after, sums))
                own, above = np.full(len(at), -1, np.int64), len(parent)
                own[longer] = mine
            cut_w = np.searchsorted(shard_of(word, shards), np.arange(shards + 1))
            cut_c = np.searchsorted(shard_of(ctx, shards, CONTEXT_BITS), np.arange(shards + 1))
            deep = [(pointers, little(after, 3), sums) for pointers, after, sums in deep]
            out = []
            for s in range(shards):
                a, b, c, d = cut_w[s], cut_w[s + 1], cut_c[s], cut_c[s + 1]
                if b > a or d > c:
                    starts = np.flatnonzero(np.concatenate([[True], ctx[c + 1 : d] != ctx[c : d - 1]])) if d > c else np.zeros(0, np.int64)
                    parts = [s, word[a:b].tobytes(), narrow(count[a:b]), little(ctx[c:d][starts], 6).tobytes(), narrow(np.diff(np.append(starts, d - c))), successor[c:d].astype(np.uint32).tobytes(), narrow(both[c:d])]
                    for pointers, after, sums in deep:
                        runs = np.diff(pointers[c : d + 1])
                        c, d = pointers[c], pointers[d]
                        parts += [narrow(runs), after[c:d].tobytes(), narrow(sums[c:d])]
                    out.append(parts)
            yield pa.record_batch([pa.array([o[k] for o in out], pa.binary() if k else pa.int64()) for k in range(len(names) + 1)], names=["shard", *names])

    def make(table: pa.Table) -> pa.Table:
        def gather(name: str, kind: type) -> np.ndarray:
            return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(name)])

        def numbers(name: str, of: str, width: int) -> np.ndarray:
            return np.concatenate([widened(x.as_buffer(), len(y.as_buffer()) // width) for x, y in zip(table.column(name), table.column(of), strict=True)])

        word, _, count, _ = counted(w := gather("w", np.uint64), np.zeros(len(w), np.uint8), numbers("n", "w", 8))
        ctx = np.repeat(unpacked(gather("c", np.uint8), 6), numbers("r", "c", 6))
        ctx, successor, both, own = counted(ctx, gather("s", np.uint32).astype(np.uint64), numbers("b", "s", 4))
        deep, above, width = [], "s", 4
        for k in range(order - 2):
            parent, after, sums, own = deeper(np.repeat(own, numbers(f"r{k}", above, width)), unpacked(gather(f"s{k}", np.uint8), 3), numbers(f"b{k}", f"s{k}", 3))
            deep.append((parent, after, sums))
            above, width = f"s{k}", 3
        return pa.table({"shard": pa.array([shard_bytes(word, count, ctx, successor, both, deep, deep_strength)], pa.binary())})

    sent = rows.mapInArrow(released(emit), ", ".join(["shard long"] + [f"{n} binary" for n in names]))
    made = sent.groupBy("shard").applyInArrow(make, "shard binary").select(F.col("shard").cast("string").alias("value"))
    made.write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path")
    return sorted(r["path"] for r in found.collect())


def lm_score(docs: DataFrame, shards: list[str], id_col: str = "doc_id", text_col: str = "text", strength: float = STRENGTH) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of every whole text.

    A text's tokens are its words and one end, which null and empty texts have too. ``base_score`` sums log10 of
    the add-one unigram probabilities; ``score`` is the log10 probability under the model of the shards' order: in each
    context a Dirichlet mixture of its counts and the next shorter context's distribution, down to the unigram. Without shards all counts are 0. Rows stand alone,
    repeated ones too; only the two columns are read; an empty table gives an empty result.
    """
    paths = tuple(shards)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(paths)
        for ids, data, offsets in chunks(batches):
            n, known, base, score = model.score(data, offsets, strength)
            yield pa.record_batch([ids, pa.array(n.astype(np.int64)), pa.array(known), pa.array(np.full(len(ids), model.total, np.int64)), pa.array(base), pa.array(score)], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return whole_texts(docs, id_col, text_col).mapInArrow(work, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: learn from six folds, score every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shards = build(docs.filter(~held_out("doc_id", 7, 2)), shared_dir(spark, "ngrams"))
    return lm_score(docs, shards).select("doc_id", held_out("doc_id", 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
