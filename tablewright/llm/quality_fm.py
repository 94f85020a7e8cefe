"""Quality classifier: a factorisation machine over hashed words and structure statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.langid import held_out
from tablewright.llm.shared import chunks, span_hashes, whole_texts, words

BITS = 16
FACTORS = 8
MOST_ROWS = 8_000
"""Bound of the training sample: about so many labelled rows, chosen by a hash of the identifier."""
CUT = 0.3
CHUNK = 1 << 20

STATISTICS = (
    "log_bytes", "log_words", "log_lines", "mean_word_bytes", "mean_line_bytes", "upper_share", "digit_share",
    "symbol_share", "space_share", "high_share", "bar_words", "mark_words", "stop_words", "distinct_words", "most_frequent", "upper_words", "words_per_stop", "doubled_words",
)
WORD_BUCKETS = 1 << BITS
FEATURES = WORD_BUCKETS + len(STATISTICS)

_UPPER, _DIGIT, _SYMBOL, _HIGH, _STOP, _LINE, _SPACES = (np.zeros(256, bool) for _ in range(7))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_SYMBOL[[33, *range(35, 39), 42, 43, *range(60, 63), 64, *range(91, 97), *range(123, 127)]] = True
_HIGH[128:] = True
_STOP[[33, 46, 63]] = True
_LINE[10] = True
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of hashed words, sorted by row, and the (rows, statistics) matrix.

    A word's value is log(1 + count), scaled so that a row's values have length one.
    """
    rows = len(offsets) - 1
    row, starts, ends = words(data, offsets)
    hashed = span_hashes(data, starts, ends, lower=False)
    count = np.bincount(row, minlength=rows).astype(float)
    key, n = np.unique(row << BITS | (hashed >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    of, bucket = key >> BITS, key & (WORD_BUCKETS - 1)
    value = np.log1p(n)
    value /= np.sqrt(np.bincount(of, weights=value * value, minlength=rows))[of]

    size = np.diff(offsets).astype(float)
    sums = np.zeros(len(data) + 1, np.int64)

    def total(mask: np.ndarray) -> np.ndarray:
        np.cumsum(mask[data], out=sums[1:])
        return np.diff(sums[offsets]).astype(float)

    some, some_words = np.maximum(size, 1), np.maximum(count, 1)
    lines = total(_LINE) + 1
    in_word = lambda mask: np.bincount(row, weights=mask, minlength=rows)
    ends_with = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    starts_with = data[starts] if len(starts) else np.zeros(0, np.uint8)
    np.cumsum(_UPPER[data], out=sums[1:])
    uppers = sums[ends] - sums[starts]
    stops = in_word(_STOP[ends_with])
    doubled = np.zeros(len(row), bool)
    doubled[1:] = (hashed[1:] == hashed[:-1]) & (row[1:] == row[:-1])
    most = np.zeros(rows)
    np.maximum.at(most, of, n)
    stats = np.column_stack([
        np.log1p(size), np.log1p(count), np.log1p(lines), in_word(ends - starts) / some_words, np.log1p(size / lines), total(_UPPER) / some, total(_DIGIT) / some,
        total(_SYMBOL) / some, total(_SPACES) / some, total(_HIGH) / some, in_word((ends - starts == 1) & (starts_with == 124)) / some_words, in_word(_SYMBOL[ends_with]) / some_words,
        stops / some_words, np.bincount(of, minlength=rows) / some_words, most / some_words, in_word((uppers > 1) & (2 * uppers > ends - starts)) / some_words, np.log1p(count / (stops + 1)), in_word(doubled) / some_words,
    ])
    return of, bucket, value, stats


@dataclass
class Machine:
    """Weights ``w``, factors ``v`` of every feature, bias ``b``; statistics are standardised by ``mean`` and ``scale``."""

    b: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def standardised(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4) / math.sqrt(stats.shape[1])

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row, in time linear in its features.

        The sum over pairs of <v_i, v_j> x_i x_j is half of (sum v x)^2 - sum (v x)^2, summed over the factors.
        """
        rows = len(offsets) - 1
        of, bucket, value, stats = features(data, offsets)
        x = self.standardised(stats)
        plain = np.bincount(of, weights=self.w[bucket] * value, minlength=rows) + x @ self.w[WORD_BUCKETS:]
        pairs = np.zeros(rows)
        for f in range(self.v.shape[1]):
            own = self.v[:, f]
            vx, dense = own[bucket] * value, x * own[WORD_BUCKETS:]
            sums = np.bincount(of, weights=vx, minlength=rows) + dense.sum(axis=1)
            pairs += sums * sums - np.bincount(of, weights=vx * vx, minlength=rows) - (dense * dense).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(self.b + plain + pairs / 2, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, rate: float = 0.1, decay: float = 2e-3, seed: int = 5) -> Machine:
    """Adagrad on the logistic loss over (buckets, values, statistics) rows."""
    stats = np.array([r[2] for r in rows])
    rng = np.random.default_rng(seed)
    prior = float(np.clip(labels.mean(), 0.02, 0.98))
    own = Machine(math.log(prior / (1 - prior)), np.zeros(FEATURES), rng.normal(0, 0.02, (FEATURES, FACTORS)), stats.mean(axis=0), stats.std(axis=0) + 1e-6)
    dense = own.standardised(stats)
    tail = np.arange(WORD_BUCKETS, FEATURES)
    parts = [(np.concatenate([bucket, tail]), np.concatenate([value, dense[k]])) for k, (bucket, value, _) in enumerate(rows)]
    gw, gv, gb = np.full(FEATURES, 1e-2), np.full((FEATURES, FACTORS), 1e-2), 1e-2
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, x = parts[k]
            v = own.v[at]
            vx = v * x[:, None]
            sums = vx.sum(axis=0)
            z = own.b + own.w[at] @ x + 0.5 * float((sums * sums).sum() - (vx * vx).sum())
            g = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - labels[k]
            dw = g * x + decay * own.w[at]
            dv = g * (x[:, None] * sums - vx * x[:, None]) + decay * v
            gb += g * g
            gw[at] += dw * dw
            gv[at] += dv * dv
            own.b -= rate * g / math.sqrt(gb)
            own.w[at] -= rate * dw / np.sqrt(gw[at])
            own.v[at] -= rate * dv / np.sqrt(gv[at])
    return own


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = MOST_ROWS) -> Machine | None:
    """Learn from about ``most_rows`` labelled documents; None if there are none.

    Labels that are null or not 0 or 1 are left out; a document with several labels counts with each distinct one. The
    sample's labels, at most about ``most_rows`` rows, are broadcast to the texts; only the sample's
    sparse features reach the driver.
    """
    marked = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("long").alias("_y")).filter("_id IS NOT NULL AND _y IN (0, 1)").distinct()
    count = marked.count()
    if not count:
        return None
    draw = F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    picked = marked.filter(draw < most_rows / count)
    # rows that repeat an identifier, however many, give one text each sample row
    found = whole_texts(docs, id_col, text_col).join(F.broadcast(picked), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, data, offsets in chunks(batches, CHUNK):
            of, bucket, value, stats = features(data, offsets)
            cut = np.searchsorted(of, np.arange(len(key) + 1))
            yield pa.record_batch(
                [key, pa.array([bucket[a:b].astype(np.uint16).tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()), pa.array([value[a:b].astype(np.float32).tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()), pa.array([s.tobytes() for s in stats], pa.binary())],
                names=["key", "bucket", "value", "stats"],
            )

    sample = found.select(F.struct("_id", "_y").alias("_id"), "_text").mapInArrow(work, "key struct<_id:long,_y:long>, bucket binary, value binary, stats binary").collect()
    if not sample:
        return None
    sample.sort(key=lambda r: (r["key"]["_id"], r["key"]["_y"]))
    rows = [(np.frombuffer(r["bucket"], np.uint16).astype(np.int64), np.frombuffer(r["value"], np.float32).astype(float), np.frombuffer(r["stats"], float)) for r in sample]
    return train(rows, np.array([r["key"]["_y"] for r in sample], float))


def score(docs: DataFrame, machine: Machine | None, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1, higher: good likelier) and ``predicted`` (1 from ``cut`` on) of every whole text.

    Null and empty texts are scored by their statistics; with nothing learned every score is 0.5. Each row
    stands alone, repeated ones too; no column but the identifier and the text is read; an empty table
    gives an empty result. There is no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for ids, data, offsets in chunks(batches, CHUNK):
            found = own.score(data, offsets) if own else np.full(len(ids), 0.5)
            yield pa.record_batch([ids, pa.array(found), pa.array((found >= cut).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return whole_texts(docs, id_col, text_col).mapInArrow(work, "doc_id long, score double, predicted int")


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """The contract's query: learn from four folds' labels, score every document."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    machine = fit(read("documents"), read("labels").filter(~held_out("doc_id", 5, 0)))
    return score(read("documents"), machine).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")
