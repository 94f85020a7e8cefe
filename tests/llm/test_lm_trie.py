import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablewright.llm.elias_fano import EliasFano
from tablewright.llm.lm_trie import DEEP_STRENGTH, LEVELS, ORDER, PROBABILITIES, STRENGTH, at_most, build, lm_score, load, narrow, op7_lm_scoring, quantised, quantised_probability, widened


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2**63) | st.integers(0, 300), max_size=300), st.lists(st.integers(0, 2**63), max_size=20))
def test_elias_fano_access_and_successor(values, probes):
    values = np.array(sorted(values), np.uint64)
    coded = EliasFano.build(values)
    raw = b"pad12345" + coded.to_bytes()
    coded, end = EliasFano.read(memoryview(raw), 8)
    assert end == len(raw)
    assert coded.get(np.arange(len(values))).tolist() == values.tolist()
    probes = np.array(probes + values.tolist() + [int(v) + 1 for v in values], np.uint64)
    assert coded.successor(probes).tolist() == np.searchsorted(values, probes).tolist()
    assert ((coded.find(probes) >= 0) == np.isin(probes, values)).all()


def test_quantiser():
    assert LEVELS[quantised(np.arange(1, 65))].tolist() == list(range(1, 65))
    big = np.geomspace(65, 1e12, 500)
    low = LEVELS[quantised(big)]
    assert (low <= big).all() and (at_most(low) >= big * (1 - 1e-12)).all() and at_most(np.array([0.0, 1, 63])).tolist() == [0, 1, 63]


def test_probabilities_and_narrow_numbers():
    p = np.geomspace(2e-9, 1, 900)
    low = PROBABILITIES[quantised_probability(p)]
    assert (low <= p).all() and (low >= p * 0.91).all() and quantised_probability(np.array([1e-12]))[0] == 0
    for values in ([], [1, 2, 3], [255, 0, 70_000, 254, 4_000_000_000], [256] * 9):
        raw = pa.py_buffer(narrow(np.array(values, np.int64)))
        assert widened(raw, len(values)).tolist() == values


def split(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split() + [None]


def brute(train, docs, order=2, deep=DEEP_STRENGTH):
    grams = [Counter() for _ in range(order)]
    for t in train:
        w = split(t)
        for k in range(order):
            grams[k].update(tuple(w[i : i + k + 1]) for i in range(len(w) - k))
    n, v = sum(grams[0].values()), len(grams[0])
    p1 = lambda w: (grams[0][(w,)] + 1) / (n + v + 1)
    code = lambda c: LEVELS[quantised(np.array([c]))[0]] * (c > 0)

    def p(gram):
        if len(gram) == 1:
            return p1(gram[0])
        if len(gram) == 2:
            return (code(grams[1][gram]) + STRENGTH * p(gram[1:])) / (grams[0][gram[:1]] + STRENGTH)
        c, before = grams[len(gram) - 1][gram], grams[len(gram) - 2][gram[:-1]]
        part = PROBABILITIES[quantised_probability(np.array([c / (before + deep)]))[0]] if c else 0.0
        most = code(before) * (1.145 if code(before) >= 64 else 1)
        return part + deep / (most + deep) * p(gram[1:])

    out = []
    for t in docs:
        w = split(t)
        score = sum(math.log10(p(tuple(w[max(0, i + 1 - order) : i + 1]))) for i in range(len(w)))
        out.append((len(w), sum(grams[0][(x,)] > 0 for x in w), n, sum(math.log10(p1(x)) for x in w), score))
    return out


def corpus():
    rng = random.Random(6)
    words = [f"w{k}" for k in range(300)] + ["été", "日本", "The", "the"]
    docs = [(d, " ".join(rng.choice(words[: rng.choice([5, 300])]) for _ in range(rng.randrange(0, 200)))) for d in range(150)]
    return docs + [(500, None), (501, ""), (502, "the The\tTHE\r\n\x0b x"), (503, "w1 w2 " * 40000), (503, "w1 w2 " * 40000)]


@pytest.mark.parametrize("shard_text,order", [(16 << 20, 3), (20_000, 3), (20_000, 2), (50_000, 5)])
def test_scores_match_brute_force(spark, tmp_path, shard_text, order):
    docs = corpus()
    frame = spark.createDataFrame([(d, t, 1.0, 2) for d, t in docs], "doc_id long, text string, score double, n_tokens int").repartition(5)
    shards = build(frame, f"file://{tmp_path}/m", shard_text=shard_text, order=order)
    assert (len(shards) > 10) == (shard_text < 1 << 20)
    got = sorted(lm_score(frame, shards).collect(), key=lambda r: (r.doc_id, r.n_tokens))
    for r, want in zip(got, brute([t for _, t in docs], [t for _, t in docs], order), strict=True):
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
        assert r.base_score == pytest.approx(want[3], rel=1e-9) and r.score == pytest.approx(want[4], rel=1e-9)


def test_query_learns_from_the_folds_only(spark, tmp_path):
    docs = corpus()
    spark.createDataFrame(docs + [(None, "w1 lone")], "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = zlib.crc32
    train = [t for d, t in docs if out(str(d).encode()) % 7 != 2] + ["w1 lone"]
    want = dict(zip([d for d, _ in docs], brute(train, [t for _, t in docs], ORDER), strict=True))
    rows = op7_lm_scoring(spark, str(tmp_path)).collect()
    assert len(rows) == len(docs) + 1
    for r in rows:
        if r.doc_id is not None:
            assert r.held_out == (out(str(r.doc_id).encode()) % 7 == 2)
            assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3] and r.base_score == pytest.approx(want[r.doc_id][3], rel=1e-9)
            assert r.score == pytest.approx(want[r.doc_id][4], rel=1e-9)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_probabilities_of_a_context_sum_to_one_at_most(spark, tmp_path, order):
    words = [f"w{k}" for k in range(12)]
    rng = random.Random(order)
    train = [" ".join(rng.choice(words[: rng.choice([2, 4, 12])]) for _ in range(rng.randrange(1, 400))) for _ in range(150)] + ["w0 w1 w2 " * 3000, "w3 w4 " * 900]
    frame = spark.createDataFrame(list(enumerate(train)), "doc_id long, text string").repartition(3)
    shards = build(frame, f"file://{tmp_path}/m", order=order)
    contexts = ["w0 w1", "w1 w2", "w2 w0", "w3 w4", "w4 w3", "w11 w10", "w5", "w9 w9 w9", "new w1"]
    texts = [c + tail for c in contexts for tail in ["", *[f" {w}" for w in words], " unknown"]]
    got = [r.score for r in lm_score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2), shards).orderBy("doc_id").collect()]
    assert all(s <= 0 for s in got)
    model = load(tuple(shards))
    for c in contexts:
        total = 0.0
        for tail in [*[f" {w}" for w in words], " unknown", None]:
            own = (c + (tail or "")).encode()
            data, offsets = np.frombuffer(own, np.uint8), np.array([0, len(own)])
            total += last_probability(model, data, offsets, ended=tail is None)
        assert total <= 1 + 1e-6


def last_probability(model, data, offsets, ended):
    """The probability of the last word, or of the end, in its context: scores of token runs differ by it."""
    import tablewright.llm.lm_trie as lm

    row, hashed = lm.tokens(data, offsets)
    keep, real = len(hashed) if ended else len(hashed) - 1, lm.tokens
    try:
        lm.tokens = lambda d, o: (row[:keep], hashed[:keep])
        whole = model.score(data, offsets, lm.STRENGTH)[3][0]
        lm.tokens = lambda d, o: (row[: keep - 1], hashed[: keep - 1])
        return 10.0 ** (whole - model.score(data, offsets, lm.STRENGTH)[3][0])
    finally:
        lm.tokens = real


def test_more_words_are_less_likely(spark, tmp_path):
    frame = spark.createDataFrame([(0, "alpha beta " * 10_000)], "doc_id long, text string")
    texts = spark.createDataFrame([(n, "alpha beta " * n) for n in (40, 50, 60)], "doc_id long, text string")
    got = [r.score for r in lm_score(texts, build(frame, f"file://{tmp_path}/m")).orderBy("doc_id").collect()]
    assert got[0] >= got[1] >= got[2]


def test_order_is_two_or_more(spark, tmp_path):
    with pytest.raises(ValueError):
        build(spark.createDataFrame(corpus()[:2], "doc_id long, text string"), f"file://{tmp_path}/m", order=1)


def test_nothing_learned_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame(corpus()[:5], "doc_id long, text string")
    shards = build(docs.limit(0), f"file://{tmp_path}/none")
    assert all(r.base_score == r.train_tokens == r.n_known == 0 for r in lm_score(docs, shards).collect())
    assert lm_score(docs.limit(0), build(docs, f"file://{tmp_path}/some")).collect() == []
