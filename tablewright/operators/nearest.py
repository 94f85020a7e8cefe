"""A stored vector index in pages with centre and radius, and exact inner-product search that opens only pages whose bound qualifies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tablewright.sources.tables import cut

TOP_K = 5
PAGE_ROWS = 256
"""Vectors of a page at most."""
SAMPLE_ROWS = 20_000
"""Vectors on which the centres are fitted, about: a bounded sample by hash; every vector is indexed."""
MOST_GROUPS = 1024
ROUNDS = 8
QUERIES = 4096
"""Queries that are searched in one pass over the pages."""
BLOCK_CELLS = 1 << 20
"""Scores that a task holds at once."""


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def centres(vectors: DataFrame, groups: int | None = None, seed: int = 7) -> np.ndarray:
    """Centres of ``groups`` groups, by Lloyd's rounds on a sample of about ``SAMPLE_ROWS`` vectors.

    Without ``groups`` there is one for every two pages of vectors, ``MOST_GROUPS`` at most. Any centres give exact results; good ones give small radii.
    """
    n = vectors.count()
    groups = groups or min(MOST_GROUPS, max(1, n // (2 * PAGE_ROWS)))
    share = min(1.0, SAMPLE_ROWS / max(n, 1))
    sampled = vectors.filter(F.pmod(F.xxhash64("record_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("embedding")
    rows = [r[0] for r in sampled.limit(2 * SAMPLE_ROWS).collect()] if n else []
    if not rows:
        return np.zeros((1, 0))
    own = np.array(rows, np.float64)
    rng = np.random.default_rng(seed)
    found = own[rng.choice(len(own), min(groups, len(own)), replace=False)]
    for _ in range(ROUNDS):
        near = nearest(own, found)
        size = np.bincount(near, minlength=len(found))
        sums = np.zeros_like(found)
        np.add.at(sums, near, own)
        found = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], found)
    return found


def nearest(vectors: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The nearest of ``found`` to each vector, in blocks."""
    half = (found**2).sum(axis=1) / 2
    step = max(1, BLOCK_CELLS // len(found))
    parts = [np.argmax(vectors[a : a + step] @ found.T - half, axis=1) for a in range(0, len(vectors), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def vector_index(vectors: DataFrame, groups: int | None = None) -> DataFrame:
    """The index of ``vectors`` (``record_id``, ``embedding``): a table of pages in the shared folder, or wherever it is written to.

    Vectors are put into the group of their nearest centre, and each group is cut into pages of at most ``PAGE_ROWS``, so a group that
    holds most vectors is many pages in many tasks. A page has ``page``, ``records``, ``vectors`` (float64), ``n``, ``centre`` and ``radius`` (the largest distance from
    the centre). All vectors must have one length; rows without identifier or vector, or with a null in it, are left out; repeated rows stay. No vectors: no pages.
    Vectors are written once before: the filter for nulls would be pushed into what computes them, and run for each element and in each pass.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["record_id"].dataType
    own = cut(vectors.select("record_id", F.col("embedding").cast("array<double>").alias("embedding")), "vectors")
    own = own.filter(F.col("record_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()))
    shared = spark.sparkContext.broadcast(centres(own, groups))

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = nearest(_matrix(batch.column(1)), shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.int64()), *batch.columns], names=["group", "record_id", "embedding"])

    schema = T.StructType([T.StructField("group", T.LongType()), T.StructField("record_id", kind), T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    placed = own.mapInArrow(grouped, schema).repartitionByRange("group", "record_id").sortWithinPartitions("group", "record_id")
    record = to_arrow_type(kind)

    def paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, rows = batch.column(0).to_numpy(), _matrix(batch.column(2))
            edges = np.flatnonzero(np.diff(group, prepend=-1))
            for a, b in zip(edges, [*edges[1:], len(group)], strict=True):
                for at in range(a, b, PAGE_ROWS):
                    part = rows[at : min(b, at + PAGE_ROWS)]
                    centre = part.mean(axis=0)
                    radius = float(np.sqrt(((part - centre) ** 2).sum(axis=1).max()))
                    ids = batch.column(1).slice(at, len(part))
                    yield pa.RecordBatch.from_arrays(
                        [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), ids.cast(record)), pa.array([part.tobytes()]), pa.array([len(part)], pa.int64()), pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([radius])],
                        names=["records", "vectors", "n", "centre", "radius"],
                    )

    pages = T.StructType([T.StructField("records", T.ArrayType(kind)), *T._parse_datatype_string("vectors binary, n bigint, centre array<double>, radius double").fields])
    return cut(placed.mapInArrow(paged, pages).withColumn("page", F.monotonically_increasing_id()), "pages")


def _bounds(asked: np.ndarray, size: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """By the triangle inequality: no vector of a page has a larger product with a query than centre . query + radius x |query|."""
    return asked @ centre.T + size[:, None] * radius[None, :]


def vector_top(index: DataFrame, queries: DataFrame, k: int = TOP_K, digits: int = 9, most: int = QUERIES, report: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Exact inner-product search: the best ``k`` (``record_id``, ``rank``, ``score``) of each of a stated set of queries (``query_id``, ``q_embedding``), ties by record.

    ``index`` is ``vector_index``. Queries go in parts of at most ``most``, each broadcast. The page of the largest bound is opened for every query first, which reads centres of
    all pages and vectors of those few; its k-th score is a floor. Then each page is opened for the queries whose bound reaches their floor, by one matrix
    product, and every task keeps k vectors a query. Queries without vector have no hits. With ``report``, also a row for each task with the
    ``pages`` that it met times queries and those ``opened``.
    """
    spark = index.sparkSession
    record = index.schema["records"].dataType.elementType
    kind = queries.schema["query_id"].dataType
    asked = cut(queries.filter("q_embedding IS NOT NULL AND query_id IS NOT NULL").select("query_id", F.col("q_embedding").cast("array<double>").alias("q")), "asked")
    parts = max(1, -(-asked.count() // most))
    hits = counts = None
    number = T.StructField("_number", T.LongType())
    for n in range(parts):
        rows = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == n).collect()
        if not rows:
            continue
        q = np.array([r["q"] for r in rows], np.float64)
        size = np.sqrt((q**2).sum(axis=1))
        shared = spark.sparkContext.broadcast((q, size))

        def best_pages(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked, size = shared.value
            best, page = np.full(len(asked), -np.inf), np.zeros(len(asked), np.int64)
            for batch in batches:
                centre, radius, ids = _matrix(batch.column(1)), batch.column(2).to_numpy(), batch.column(0).to_numpy()
                step = max(1, BLOCK_CELLS // len(asked))
                for a in range(0, len(ids), step):
                    bound = _bounds(asked, size, centre[a : a + step], radius[a : a + step])
                    top = bound.argmax(axis=1)
                    value = bound[np.arange(len(asked)), top]
                    page = np.where(value > best, ids[a : a + step][top], page)
                    best = np.maximum(value, best)
            there = np.flatnonzero(best > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(page[there]), pa.array(best[there])], names=["_number", "page", "bound"])

        seeds = index.select("page", "centre", "radius").mapInArrow(best_pages, "_number long, page long, bound double")
        seeds = seeds.groupBy("_number").agg(F.max_by("page", F.struct("bound", "page")).alias("page"))
        lists = seeds.groupBy("page").agg(F.collect_list("_number").alias("numbers"))  # a part's queries at most

        def floors(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked, _ = shared.value
            for batch in batches:
                for at in range(batch.num_rows):
                    who = batch.column(0)[at].values.to_numpy()
                    rows = np.frombuffer(batch.column(1)[at].as_py(), np.float64).reshape(-1, asked.shape[1])
                    if len(rows) < k:
                        continue
                    step = max(1, BLOCK_CELLS // len(rows))
                    kth = np.concatenate([np.partition(asked[who[a : a + step]] @ rows.T, len(rows) - k, axis=1)[:, len(rows) - k] for a in range(0, len(who), step)])
                    yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(kth)], names=["_number", "floor"])

        floor = np.full(len(rows), -np.inf)
        for r in index.join(lists, "page").select("numbers", "vectors").mapInArrow(floors, "_number long, floor double").collect():  # a row a query
            floor[r["_number"]] = r["floor"]
        told = spark.sparkContext.broadcast(floor)

        def search(batches: Iterator[pa.RecordBatch], shared=shared, told=told) -> Iterator[pa.RecordBatch]:
            asked, size = shared.value
            least, slack = told.value.copy(), 2 * 10.0**-digits
            best: list[list] = [[] for _ in asked]
            met = opened = 0
            for batch in batches:
                bound = _bounds(asked, size, _matrix(batch.column(2)), batch.column(3).to_numpy())
                for at in range(batch.num_rows):
                    met += len(asked)
                    who = np.flatnonzero(bound[:, at] + slack >= least)
                    opened += len(who)
                    if not len(who):
                        continue
                    names = batch.column(0)[at].values
                    rows = np.frombuffer(batch.column(1)[at].as_py(), np.float64).reshape(-1, asked.shape[1])
                    step = max(1, BLOCK_CELLS // len(rows))
                    for a in range(0, len(who), step):
                        score = asked[who[a : a + step]] @ rows.T
                        for i, j in zip(*np.nonzero(score + slack >= least[who[a : a + step], None]), strict=True):
                            best[who[a + i]].append((-round(float(score[i, j]), digits), names[int(j)].as_py()))
                        for w in who[a : a + step].tolist():
                            if len(best[w]) > k:
                                best[w] = sorted(best[w])[:k]
                                least[w] = max(least[w], -best[w][-1][0])
            found = [(w, r, -s, None, None) for w, own in enumerate(best) for s, r in sorted(own)[:k]] + [(-1, None, None, met, opened)]
            arrays = [pa.array(v, to_arrow_type(f.dataType)) for v, f in zip(zip(*found, strict=True), schema.fields, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

        schema = T.StructType([number, T.StructField("record_id", record), *T._parse_datatype_string("score double, pages bigint, opened bigint").fields])
        found = index.select("records", "vectors", "centre", "radius").mapInArrow(search, schema)
        if report:
            found = cut(found, "found")
            own = found.filter("_number < 0").select("pages", "opened")
            counts = own if counts is None else counts.unionByName(own)
        named = spark.createDataFrame([(i, r["query_id"]) for i, r in enumerate(rows)], T.StructType([number, T.StructField("query_id", kind)]))
        found = found.join(F.broadcast(named), "_number").select("query_id", "record_id", "score")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = spark.createDataFrame([], T.StructType([T.StructField("query_id", kind), T.StructField("record_id", record), T.StructField("score", T.DoubleType())]))
        counts = spark.createDataFrame([], "pages long, opened long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "record_id")
    hits = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "record_id", "score", "rank")
    return (hits, counts) if report else hits
