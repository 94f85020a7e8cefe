"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams, trained by FTRL."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.shared import bounded, carried, chunks, mix, opened, release, released, whole_texts
from tablewright.sources.tables import spread

BITS = 16
ORDERS = (1, 2, 3)
PER_LANGUAGE = 1500
"""Bound of the training sample: about so many documents of each language, chosen by a hash of the identifier."""
CHUNK = 1 << 18
UNKNOWN = "und"
SCALE = 30.0
_LETTER = regex.compile(r"\p{L}")


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each character n-gram of each text in lower case, for every order in turn."""
    low = [t.lower() for t in texts]
    sizes = np.array([len(t) for t in low], np.int64)
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(low)), sizes)
    rows, buckets = [], []
    code = np.zeros(len(points), np.uint64)
    for k in range(max(ORDERS)):
        if k >= len(points):
            break
        code = mix(code[: len(points) - k] + points[k:] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1))
        if k + 1 in ORDERS:
            whole = row[: len(points) - k] == row[k:]
            rows.append(row[: len(points) - k][whole])
            buckets.append((code[whole] >> np.uint64(64 - BITS)).astype(np.int64))
    none = np.zeros(0, np.int64)
    return (np.concatenate(rows), np.concatenate(buckets)) if rows else (none, none)


def texts_of(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    raw, marks = data.tobytes(), offsets.tolist()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(marks, marks[1:], strict=False)]


def sparse_rows(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets and their counts, for each text."""
    row, bucket = grams(texts)
    key, count = np.unique(row << BITS | bucket, return_counts=True)
    cut = np.searchsorted(key, np.arange(len(texts) + 1) << BITS)
    return [(key[a:b] & ((1 << BITS) - 1), count[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


@dataclass
class Model:
    """``weights`` (bucket, language) with the document frequencies folded in; ``bias``; ``temperature``."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """Calibrated probability of each language for each text, in one pass over the n-grams."""
        row, bucket = grams(texts)
        total = np.bincount(row, minlength=len(texts)).astype(np.float64)
        logits = np.empty((len(texts), len(self.languages)))
        for c in range(len(self.languages)):
            logits[:, c] = np.bincount(row, weights=self.weights[c][bucket], minlength=len(texts))
        logits = (logits * (SCALE / np.maximum(total, 1))[:, None] + self.bias) / self.temperature
        logits -= logits.max(axis=1, keepdims=True)
        e = np.exp(logits)
        return e / e.sum(axis=1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, idf: np.ndarray, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """Follow-the-regularised-leader with elastic net; returns weights, bias and the temperature fitted on a tenth held back."""
    order = np.random.default_rng(seed).permutation(len(rows))
    back = order[: len(rows) // 10] if len(rows) >= 50 else order[:0]
    train = order[len(back) :]
    z, n = np.zeros((len(idf) + 1, classes)), np.zeros((len(idf) + 1, classes))

    def now(at: np.ndarray) -> np.ndarray:
        own, rate = z[at], (beta + np.sqrt(n[at])) / alpha + l2
        return np.where(np.abs(own) > l1, -(own - np.sign(own) * l1) / rate, 0.0)

    def feature(k: int) -> tuple[np.ndarray, np.ndarray]:
        bucket, count = rows[k]
        return np.append(bucket.astype(np.int64), len(idf)), np.append(count * idf[bucket] * (SCALE / max(count.sum(), 1)), 1.0)

    for _ in range(epochs):
        for k in train:
            at, x = feature(k)
            w = now(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[labels[k]] -= 1
            g = x[:, None] * p
            old = n[at]
            n[at] = old + g * g
            z[at] += g - (np.sqrt(n[at]) - np.sqrt(old)) / alpha * w
    weights = now(np.arange(len(idf) + 1))
    temperature = 1.0
    if len(back):
        scores = np.array([x @ weights[at] for at, x in map(feature, back)])

        def loss(t: float) -> float:
            s = scores / t
            s = s - s.max(axis=1, keepdims=True)
            return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(back)), labels[back]]).mean())

        temperature = min(np.geomspace(0.25, 8, 41), key=loss)
    return weights[:-1], weights[-1], float(temperature)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """Learn from the rows with a label and a text; None if there are none.

    Document frequencies come from all these rows; the weights from about ``per_language`` rows of each
    label. What reaches the driver grows with the number of labels alone: one count per bucket, the labels' counts
    and the sample's n-gram counts; every label is learned. Rows of null text or label teach nothing, empty texts only
    their label's share; a repeated row counts as often as it occurs, though one identifier is drawn as a whole or not
    at all; texts are read whole, and other columns are not read. The temperature is fitted on a tenth of the sample, which the weights
    do not see, if the sample has 50 rows or more; with fewer it stays 1, and probabilities are not calibrated.
    """
    rows = spread(docs).select(F.col(label_col).cast("string").alias("_label"), F.col(text_col).cast("string").alias("_text"), F.xxhash64(F.col(id_col), F.lit("sample")).alias("_draw")).filter("_label IS NOT NULL AND _text IS NOT NULL")
    bounded(docs.sparkSession)
    counts = {r["_label"]: r["count"] for r in rows.groupBy("_label").count().collect()}
    if not counts:
        return None
    languages = sorted(counts)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total, seen = np.zeros(1 << BITS, np.int64), 0, np.zeros(1 << BITS, bool)
        for ids, data, offsets in chunks(batches, CHUNK):
            row, bucket = grams(texts_of(data, offsets))
            order = np.argsort(row, kind="stable")
            row, bucket = row[order], bucket[order]
            cut = np.searchsorted(row, np.arange(len(ids) + 1))
            total += len(ids)
            for a, b in zip(cut, cut[1:], strict=False):
                seen[bucket[a:b]] = True
                hit = np.flatnonzero(seen)
                df[hit] += 1
                seen[hit] = False
        hit = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.append(hit, -1)), pa.array(np.append(df[hit], total))], names=["bucket", "df"])

    sums = rows.select(F.lit(0).cast("long").alias("_id"), "_text").mapInArrow(released(frequencies), "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df"))
    idf, total = np.zeros(1 << BITS), 0
    for r in sums.collect():
        if r["bucket"] < 0:
            total = r["df"]
        else:
            idf[r["bucket"]] = r["df"]
    idf = np.log((1 + total) / (1 + idf)) + 1.0

    share = F.create_map(*[x for label in languages for x in (F.lit(label), F.lit(per_language / counts[label]))])
    draw = F.pmod(F.col("_draw"), F.lit(1 << 30)) / float(1 << 30)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, offsets in chunks(batches, CHUNK):
            found = sparse_rows(texts_of(data, offsets))
            yield pa.record_batch([ids, pa.array([b.astype(np.uint16).tobytes() for b, _ in found], pa.binary()), pa.array([c.astype(np.uint32).tobytes() for _, c in found], pa.binary())], names=["label", "bucket", "n"])

    number = F.create_map(*[x for k, label in enumerate(languages) for x in (F.lit(label), F.lit(k))])
    picked = rows.filter(draw < F.element_at(share, F.col("_label"))).select(F.element_at(number, F.col("_label")).cast("long").alias("_id"), "_text")
    sample = picked.mapInArrow(released(sparse), "label long, bucket binary, n binary").collect()
    sample.sort(key=lambda r: (bytes(r["bucket"]), bytes(r["n"]), r["label"]))  # the order of training doesn't depend on tasks
    features = [(np.frombuffer(r["bucket"], np.uint16), np.frombuffer(r["n"], np.uint32)) for r in sample]
    weights, bias, temperature = ftrl(features, np.array([r["label"] for r in sample], np.int64), len(languages), idf)
    del sample, features
    release()
    return Model(languages, np.ascontiguousarray((weights * idf[:, None]).T), bias, temperature)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` (calibrated probability of lang_pred) of every whole text.

    A text that is null or has no letter, and every text if nothing was learned, is ``und`` with score 0.
    Ties go to the first language by name. Each row stands alone: repeated rows get equal answers, long
    texts are read whole, an empty table gives an empty result and other columns are not read; with
    ``carry`` they are passed through, the two new columns (``names``) taking the place of namesakes.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for ids, data, offsets in chunks(batches, CHUNK, text_col):
            texts = texts_of(data, offsets)
            letters = np.array([_LETTER.search(t) is not None for t in texts])
            if own is None:
                best, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            else:
                p = own.probabilities(texts)
                place = p.argmax(axis=1)
                best = [own.languages[b] if ok else UNKNOWN for b, ok in zip(place, letters, strict=True)]
                scores = np.where(letters, p[np.arange(len(place)), place], 0.0)
            yield pa.record_batch([ids, pa.array(best, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", *names])

    rows = carried(docs, text_col) if carry else whole_texts(docs, id_col, text_col)
    schema = T.StructType([T.StructField("doc_id", rows.schema["_id"].dataType), T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    found = rows.mapInArrow(released(work), schema)
    return opened(found, "doc_id", list(names)) if carry else found


def held_out(id_col: str, fold: int, at: int) -> Column:
    """Whether crc32 of the identifier as text leaves ``at`` modulo ``fold``; a null identifier is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % fold == at, F.lit(False))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """The contract's query: learn from three folds, predict every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.filter(~held_out("doc_id", 4, 2)))
    return predict(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
