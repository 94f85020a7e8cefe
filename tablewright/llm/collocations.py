"""Phrase collocations from vertical positional inverted lists, extended level by level."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.shared import _LOWER, bounded, buffers, materialise, release
from tablewright.sources.tables import spread

LEAST = 30
MOST_WORDS = 4
TOP = 2000
SCALE = 2_000_000
COVERED = 80
"""Percent of a phrase's occurrences that a longer one must have to displace it."""
LIST_BYTES = 8 << 20
"""Bytes of text whose lists are kept together; a longer text has lists of its own."""
BUCKET_ENTRIES = 1 << 21
"""Counts that are summed by one task, about."""
LEAST_BUCKETS = 16

_CUT = np.zeros(256, bool)
_CUT[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
_SPLIT = _CUT.copy()
_SPLIT[[9, 32]] = True

LISTS = "chunk long, phrases array<bigint>, lengths array<bigint>, places binary"
"""The inverted lists of a chunk: the phrases' words (``width`` numbers each, ascending), the length of each list, and all places, list after list."""


def placed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words (lower case) of the rows' pieces and their places: neighbours in a piece are 1 apart, pieces more."""
    inside = ~_SPLIT[data]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cuts = offsets[1:-1]
    across = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    across = across[inside[across - 1] & inside[across]]  # a row may end without a blank
    starts, ends = np.sort(np.concatenate([starts, across])), np.sort(np.concatenate([ends, across]))
    piece = np.concatenate([[0], np.cumsum(_CUT[data])])[starts] + np.searchsorted(offsets, starts, side="right")
    flat = _LOWER[data[inside]]
    marks = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(marks), pa.py_buffer(flat)])
    return found, np.arange(len(starts)) + np.concatenate([[0], np.cumsum(np.diff(piece) > 0)])[: len(starts)]


def word_lists(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``chunk``, ``lang``, ``words``, ``lengths``, ``places``: inverted lists of the words of some documents of one language."""
    bounded(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")
    rows = spread(docs).select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("_lang"), text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[str, list[pa.Array]] = {}
        size: dict[str, int] = {}

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal number
            data, offsets = buffers(pa.concat_arrays(held.pop(lang)))
            size.pop(lang)
            found, places = placed_words(data, offsets)
            if len(found):
                coded = found.dictionary_encode()
                own = coded.indices.to_numpy()
                lists = np.argsort(own, kind="stable")
                lengths = np.bincount(own, minlength=len(coded.dictionary))
                number += 1
                yield pa.record_batch({
                    "chunk": [number],
                    "lang": [lang],
                    "words": pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), coded.dictionary.cast(pa.string())),
                    "lengths": pa.array([lengths], pa.list_(pa.int64())),
                    "places": [packed(places[lists], np.cumsum(lengths)[:-1])],
                })
                release()

        for batch in batches:
            for lang in pc.unique(batch.column(0)).to_pylist():
                texts = batch.column(1).filter(pc.equal(batch.column(0), lang))
                data, offsets = buffers(texts)
                at = 0
                while at < len(texts):
                    room = max(1, LIST_BYTES - size.get(lang, 0))
                    to = min(len(texts), max(at + 1, int(np.searchsorted(offsets, offsets[at] + room, side="right")) - 1))
                    held.setdefault(lang, []).append(texts.slice(at, to - at))
                    size[lang] = size.get(lang, 0) + int(offsets[to] - offsets[at])
                    at = to
                    if size[lang] >= LIST_BYTES:
                        yield from flush(lang)
        for lang in list(held):
            yield from flush(lang)
        release()

    return rows.mapInArrow(work, "chunk long, lang string, words array<string>, lengths array<bigint>, places binary")


def packed(places: np.ndarray, firsts: np.ndarray) -> bytes:
    """Ascending lists as differences, the first of each list as it is; of four bytes each if they fit."""
    steps = np.diff(places, prepend=0)
    steps[firsts[firsts < len(places)]] = places[firsts[firsts < len(places)]]
    return steps.astype("<u4" if not len(steps) or steps.max() < 1 << 32 else "<i8").tobytes()


def unpacked(blob: bytes, lengths: np.ndarray) -> np.ndarray:
    total = int(lengths.sum())
    steps = np.frombuffer(blob, "<u4" if len(blob) == 4 * total else "<i8").astype(np.int64)
    run = np.cumsum(steps)
    firsts = np.cumsum(lengths) - lengths
    before = np.concatenate([[0], run])[np.minimum(firsts, total)]
    return run - np.repeat(before, lengths)


def grown(phrases: np.ndarray, lengths: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lists of phrases one word longer: places where a phrase stands and another one word further on.

    Both sides are merged by place. The other's last word is the adjacent word; its postings are taken from
    the lists of phrases of the same width, as a phrase whose own last words are rare is rare itself. The two agree in all words between.
    """
    own = np.repeat(np.arange(len(lengths)), lengths)
    order = np.argsort(places, kind="stable")
    places, own = places[order], own[order]
    if not len(places):
        return np.zeros((0, phrases.shape[1] + 1), np.int64), lengths, places
    next_to = np.searchsorted(places, places + 1)
    met = np.flatnonzero(places[np.minimum(next_to, len(places) - 1)] == places + 1)
    code = own[met] * len(phrases) + own[next_to[met]]
    lists = np.argsort(code, kind="stable")
    codes, firsts = np.unique(code[lists], return_index=True)
    longer = np.concatenate([phrases[codes // len(phrases)], phrases[codes % len(phrases), -1:]], axis=1)
    return longer, np.diff(np.append(firsts, len(lists))), places[met][lists]


def opened_lists(row: dict, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.asarray(row["lengths"], np.int64)
    return np.asarray(row["phrases"], np.int64).reshape(-1, width), lengths, unpacked(row["places"], lengths)


def arrays(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, lists of numbers as arrays."""
    for k in range(batch.num_rows):
        row = {}
        for name, column in zip(batch.schema.names, batch.columns, strict=True):
            value = column[k]
            row[name] = value.values.to_numpy(zero_copy_only=False) if pa.types.is_list(column.type) and pa.types.is_integer(column.type.value_type) and value.is_valid else value.as_py()
        yield row


def local_counts(lists: DataFrame, width: int, buckets: int) -> DataFrame:
    """The counts of each chunk's phrases of ``width`` + 1 words, in a row for each bucket that they are summed in."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in arrays(batch):
                longer, lengths, _ = grown(*opened_lists(row, width))
                if not len(longer):
                    continue
                into = np.zeros(len(longer), np.uint64)
                for k in range(width + 1):
                    into = (into ^ longer[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                    into ^= into >> np.uint64(29)
                into = (into % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(into, kind="stable")
                found, firsts = np.unique(into[order], return_index=True)
                for bucket, rows in zip(found.tolist(), np.split(order, firsts[1:]), strict=True):
                    kind = "<u4" if longer.max() < 1 << 32 else "<i8"
                    words = np.ascontiguousarray(longer[rows].T.astype(kind)).tobytes()
                    yield pa.record_batch({"bucket": [bucket], "chunk": pa.array([row["chunk"]], pa.int64()), "words": [words], "counts": [lengths[rows].astype("<u4").tobytes()]})
            release()

    return lists.select("chunk", "phrases", "lengths", "places").mapInArrow(work, "bucket long, chunk long, words binary, counts binary")


def frequent(counted: DataFrame, width: int, least: int) -> DataFrame:
    """Of the phrases of ``width`` words, those counted ``least`` times: a row each without ``chunk``, and for each chunk those that it has.

    Columns: ``chunk``, ``words`` (numbers, phrase after phrase), ``f`` (of a phrase's own row).
    """

    def summed(rows: pa.Table) -> pa.Table:
        chunk = rows.column("chunk").to_numpy()
        counts = [np.frombuffer(c.as_py(), "<u4") for c in rows.column("counts")]
        words = [np.frombuffer(w.as_py(), "<u4" if len(w.as_py()) == 4 * width * len(c) else "<i8").reshape(width, -1) for w, c in zip(rows.column("words"), counts, strict=True)]
        sizes = [len(c) for c in counts]
        words, counts = np.concatenate(words, axis=1).astype(np.int64), np.concatenate(counts).astype(np.int64)
        of = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort(words[::-1])
        words, counts, of = words[:, order], counts[order], of[order]
        new = np.concatenate([[True], (words[:, 1:] != words[:, :-1]).any(axis=0)])
        sums = np.add.reduceat(counts, np.flatnonzero(new))
        kept = sums >= least
        heads = words[:, new][:, kept].T
        stays = np.flatnonzero(kept[np.cumsum(new) - 1])
        stays = stays[np.argsort(of[stays], kind="stable")]
        chunks, firsts = np.unique(of[stays], return_index=True)
        of_chunk = np.diff(np.append(firsts, len(stays)))
        flat = np.concatenate([heads.ravel(), words[:, stays].T.ravel()])
        ends = width * np.cumsum(np.concatenate([[0], np.ones(len(heads), np.int64), of_chunk]))
        return pa.table({
            "chunk": pa.array([None] * len(heads) + chunk[chunks].tolist(), pa.int64()),
            "words": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64())),
            "f": pa.array(sums[kept].tolist() + [None] * len(chunks), pa.int64()),
        })

    return counted.groupBy("bucket").applyInArrow(summed, "chunk long, words array<bigint>, f long")


def kept_lists(lists: DataFrame, found: DataFrame, width: int) -> DataFrame:
    """The lists of the frequent phrases of ``width`` + 1 words of each chunk."""
    of_chunk = found.filter("chunk IS NOT NULL").groupBy("chunk").agg(F.flatten(F.collect_list("words")).alias("kept"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in arrays(batch):
                longer, lengths, places = grown(*opened_lists(row, width))
                kept = row["kept"].reshape(-1, width + 1)
                both = np.concatenate([longer, kept])
                _, code = np.unique(both, axis=0, return_inverse=True)
                stay = np.isin(code.ravel()[: len(longer)], code.ravel()[len(longer) :])
                yield list_row(row["chunk"], longer[stay], lengths[stay], places[np.repeat(stay, lengths)])
            release()

    return lists.select("chunk", "phrases", "lengths", "places").join(of_chunk, "chunk").mapInArrow(work, LISTS)


def list_row(chunk: int, phrases: np.ndarray, lengths: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    numbers = lambda a: pa.ListArray.from_arrays(pa.array([0, a.size], pa.int32()), pa.array(a.ravel(), pa.int64()))
    blob = packed(places, np.cumsum(lengths)[:-1])
    return pa.record_batch({"chunk": pa.array([chunk], pa.int64()), "phrases": numbers(phrases), "lengths": numbers(lengths), "places": [blob]})


def numbered(words: DataFrame) -> DataFrame:
    """``words`` with ``id`` from 0 on without gaps: a place within its partition after the rows of the partitions before it."""
    wide = F.lit((1 << 33) - 1)
    own = materialise(words.withColumns({"part": F.spark_partition_id(), "own": F.monotonically_increasing_id().bitwiseAND(wide)}), "words")
    parts = {r.part: r["count"] for r in own.groupBy("part").count().collect()}  # a row for each partition
    starts, at = [], 0
    for part in sorted(parts):
        starts.append((part, at))
        at += parts[part]
    offsets = own.sparkSession.createDataFrame(starts, "part int, start long")
    return own.join(F.broadcast(offsets), "part").select("lang", "word", "f", (F.col("start") + F.col("own")).alias("id"))


def phrase_counts(docs: DataFrame, text_col: str, lang_col: str, most_words: int, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The words (``lang``, ``word``, ``f``, ``id``) and phrases (``words``: ids, ``f``) counted ``least`` times, and ``lang``, ``n``."""
    first = materialise(word_lists(docs, text_col, lang_col), "lists")
    counted = first.select("lang", F.explode(F.arrays_zip("words", "lengths")).alias("w"))
    counted = counted.groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.lengths").alias("f"))
    words = materialise(numbered(counted.filter(F.col("f") >= least)), "frequent")
    totals = first.groupBy("lang").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n"))

    entries = first.select("chunk", "lang", F.posexplode("words").alias("at", "word"))
    ids = entries.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("chunk").agg(F.collect_list("at").alias("at"), F.collect_list("id").alias("id"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in arrays(batch):
                lengths = np.asarray(row["lengths"], np.int64)
                places = unpacked(row["places"], lengths)
                new = np.full(len(lengths), -1, np.int64)
                new[row["at"]] = row["id"]
                places = places[np.argsort(np.repeat(new, lengths), kind="stable")]
                order = np.argsort(new, kind="stable")
                gone = int((new < 0).sum())
                places = places[int(lengths[order[:gone]].sum()) :]
                yield list_row(row["chunk"], new[order[gone:], None], lengths[order[gone:]], places)
            release()

    lists = materialise(first.select("chunk", "lengths", "places").join(ids, "chunk").mapInArrow(work, LISTS), "lists")
    phrases = None
    for width in range(1, most_words):
        entries = lists.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
        buckets = max(LEAST_BUCKETS, -(-entries // BUCKET_ENTRIES))
        found = materialise(frequent(local_counts(lists, width, buckets), width + 1, least), "phrases")
        own = found.filter("chunk IS NULL").select("words", "f")
        phrases = own if phrases is None else phrases.unionByName(own)
        if width + 1 < most_words:
            lists = materialise(kept_lists(lists, found, width), "lists")
    return words, phrases, totals


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, most_words: int = MOST_WORDS, top: int = TOP) -> DataFrame:
    """The best phrases of 2 to ``most_words`` words of each language.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and 0A-0D hex, and pieces into words at 20 and 09 hex. Each chunk of documents
    keeps inverted lists: the ascending places of each word. A phrase's list is extended by merging it with the lists
    of what stands one word further on; the lengths of its lists, summed over the chunks, are its exact number of occurrences,
    overlaps included. Only phrases counted ``least`` times go to the next level, as no longer one can be more frequent.

    A candidate's score is that of its lowest cut, floor(2000000 a / (l + r)); ties go to the shortest first part. Candidates within a longer
    candidate that has 80 percent of their occurrences or more are dropped. All arithmetic is exact.

    Returns ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` (the language's words), ``score``. A null text counts as empty; a null
    language is ``und`` and shares its phrases with one of that name. Repeated rows count each; texts of any length are taken whole.
    Other columns are not read. An empty table, or one without frequent phrases, gives an empty result.
    """
    words, phrases, totals = phrase_counts(docs, text_col, lang_col, most_words, least)
    singles = words.select(F.array("id").alias("words"), "f")
    parts = materialise(singles.unionByName(phrases), "parts")
    size = F.size("words")
    candidates = parts.filter(size > 1).withColumnRenamed("f", "a")

    cut = candidates.select("words", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cut = cut.select("words", "a", "k", F.slice("words", 1, F.col("k")).alias("left"), F.slice("words", F.col("k") + 1, size - F.col("k")).alias("right"))
    cut = cut.join(parts.select(F.col("words").alias("left"), F.col("f").alias("l")), "left").join(parts.select(F.col("words").alias("right"), F.col("f").alias("r")), "right")
    exact = lambda c, digits=20: F.col(c).cast(f"decimal({digits},0)")
    scored = cut.withColumn("score", F.expr(f"CAST(CAST(a AS DECIMAL(20,0)) * {SCALE} AS DECIMAL(30,0)) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))"))
    best = scored.groupBy("words").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("b")).select("words", "b.score", "b.l", "b.r", "b.a")

    longer = candidates.filter(size > 2).select("a", "words", F.explode(F.sequence(F.lit(2), size - 1)).alias("k"))
    longer = longer.select("a", "words", "k", F.explode(F.sequence(F.lit(1), size - F.col("k") + 1)).alias("s"))
    covered = longer.groupBy(F.slice("words", F.col("s"), F.col("k")).alias("words")).agg(F.max("a").alias("longest"))
    stay = best.join(covered, "words", "left").filter(F.col("longest").isNull() | (exact("longest") * 100 < exact("a") * COVERED)).drop("longest")

    spelt = stay.select("words", F.posexplode("words").alias("at", "id")).join(words.select("id", "lang", "word"), "id")
    spelt = spelt.groupBy("words").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    named = stay.join(spelt, "words").join(totals, "lang")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    """The contract's query over all documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS p,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), sentences AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces
), spots AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM sentences
), grams AS (
  SELECT lang, k, ws[i:i + k - 1] AS g, count(*) AS f FROM spots, (VALUES (1), (2), (3), (4)) v(k) WHERE i + k - 1 <= len(ws) GROUP BY ALL
), totals AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang
), common AS (
  SELECT * FROM grams WHERE f >= 30
), candidates AS (
  SELECT lang, k, g, f AS a FROM common WHERE k > 1
), cuts AS (
  SELECT c.lang, c.g, c.a, j, l.f AS l, r.f AS r, (CAST(c.a AS HUGEINT) * 2000000) // (CAST(l.f AS HUGEINT) + r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM candidates) c
  JOIN common l ON l.lang = c.lang AND l.g = c.g[1:j] JOIN common r ON r.lang = c.lang AND r.g = c.g[j + 1:c.k]
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1
), covered AS (
  SELECT lang, g[s:s + w - 1] AS g, max(a) AS longest
  FROM (SELECT lang, g, a, k, w, unnest(range(1, k - w + 2)) AS s FROM candidates, (VALUES (2), (3)) v(w) WHERE w < k) GROUP BY ALL
), stay AS (
  SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, score
  FROM best b LEFT JOIN covered c ON c.lang = b.lang AND c.g = b.g WHERE longest IS NULL OR 100 * longest < 80 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM stay JOIN totals USING (lang) QUALIFY rank <= 2000
"""
