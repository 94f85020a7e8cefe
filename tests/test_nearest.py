import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import nearest, retrieve


def frame(spark, ids, rows):
    return spark.createDataFrame([(i, r if r is None else list(map(float, r))) for i, r in zip(ids, rows, strict=True)], "record_id long, embedding array<float>")


def asked(own):
    return own.select(F.col("record_id").alias("query_id"), F.col("embedding").alias("q_embedding"))


def brute(rows, queries, k):
    out = []
    for q, v in queries:
        best = sorted((-round(float(np.dot(v, x)), 9), i) for i, x in rows)[:k]
        out += [(q, i, -s, n) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("page,groups,most", [(256, None, 4096), (5, 7, 3), (1, 3, 4096)])
def test_search_is_exact(spark, monkeypatch, page, groups, most):
    monkeypatch.setattr(nearest, "PAGE_ROWS", page)
    rng = np.random.default_rng(page)
    base = rng.normal(size=(12, 8)) * 3
    rows = np.round(np.concatenate([base[rng.integers(0, 12, 150)] + rng.normal(size=(150, 8)), np.tile(base[0], (40, 1)), np.zeros((2, 8))]), 2).astype(np.float32)
    own = frame(spark, [*range(len(rows)), 900, None], [*rows, None, rows[0]])
    index = nearest.vector_index(own, groups)
    queries = asked(own.filter("record_id % 9 = 0 OR record_id = 900"))
    pairs = [(i, r.astype(np.float64)) for i, r in enumerate(rows)]
    for k in (1, 5, 300):
        got = nearest.vector_top(index, queries, k, most=most)
        want = brute(pairs, [p for p in pairs if p[0] % 9 == 0], k)
        assert sorted((r.query_id, r.record_id, round(r.score, 6), r["rank"]) for r in got.collect()) == sorted((q, i, round(s, 6), n) for q, i, s, n in want)


def test_pages_out_of_reach_stay_closed(spark, monkeypatch):
    monkeypatch.setattr(nearest, "PAGE_ROWS", 20)
    rng = np.random.default_rng(1)
    rows = np.concatenate([np.eye(16)[k] * 5 + rng.normal(size=(100, 16)) * 0.05 for k in range(16)])
    own = retrieve.unit(frame(spark, range(1600), rows))
    hits, report = nearest.vector_top(nearest.vector_index(own, 16), asked(own.filter("record_id % 100 = 0")), 5, report=True)
    met, opened = report.groupBy().sum("pages", "opened").first()
    assert hits.count() == 80 and met >= 16 * 80 and opened < met / 8


def test_no_vectors_and_no_queries(spark):
    own = frame(spark, [1], [[1, 2]])
    none = nearest.vector_index(own.limit(0))
    assert none.collect() == [] and nearest.vector_top(none, asked(own)).collect() == []
    assert nearest.vector_top(nearest.vector_index(own), asked(own.limit(0))).collect() == []


def test_vectors_are_computed_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def counted(vector):
        calls.add(1)
        return vector

    own = frame(spark, range(60), np.eye(60)).withColumn("embedding", F.udf(counted, "array<float>")("embedding"))
    index = nearest.vector_index(own, 3)
    assert index.groupBy().sum("n").first()[0] == 60 and calls.value == 60
