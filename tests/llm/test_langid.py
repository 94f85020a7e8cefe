import math
import random
import zlib

import numpy as np

from tablewright.llm.langid import Model, fit, ftrl, grams, op10_language_id, predict, sparse_rows

ALPHABETS = {"aa": "aeiostrn", "bb": "áéíóñrst", "cc": "жзиклмно"}


def corpus(n=400, seed=2):
    rng = random.Random(seed)
    rows = []
    for d in range(n):
        lang = rng.choice(list(ALPHABETS))
        text = " ".join("".join(rng.choice(ALPHABETS[lang]) for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(5, 80)))
        rows.append((d, text.capitalize(), lang, f"s{d % 3}", len(text)))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


def test_held_out_accuracy_and_edge_rows(spark, tmp_path):
    rows = corpus() + [(1000, None, "aa", None, None), (1001, "", None, None, None), (1002, "12 !! 34", "bb", "x", 1), (None, "aeio rst", "aa", "x", 1), (1003, "aeiost " * 30000, None, "x", 1), (1003, "aeiost " * 30000, None, "x", 1)]
    spark.createDataFrame([(*r, "c") for r in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = op10_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows[:400]}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert by[1000] == by[1001] == by[1002] == ("und", 0.0)
    assert by[1003][0] == "aa"


def test_prediction_ignores_other_columns_and_survives_nothing_learned(spark):
    docs = spark.createDataFrame([(*r, "c") for r in corpus(60)], SCHEMA)
    model = fit(docs)
    a = {r.doc_id: r.lang_pred for r in predict(docs, model).collect()}
    b = {r.doc_id: r.lang_pred for r in predict(docs.selectExpr("doc_id", "text", "'zz' AS lang", "'zz' AS source"), model).collect()}
    assert a == b
    assert fit(docs.limit(0)) is None
    assert {r.lang_pred for r in predict(docs, None).collect()} == {"und"}
    assert predict(docs.limit(0), model).collect() == []


def test_linear_pass_equals_sparse_rows():
    texts = ["Abc abc", "", "ÉÉ", "x"]
    row, bucket = grams(texts)
    for k, (own, count) in enumerate(sparse_rows(texts)):
        assert np.repeat(own, count).tolist() == sorted(bucket[row == k].tolist())
    model = Model(["a", "b"], np.zeros((2, 1 << 16)), np.array([0.0, 1.0]), 1.0)
    assert model.probabilities(texts).argmax(axis=1).tolist() == [1, 1, 1, 1]


def test_elastic_net_leaves_useless_features_at_zero():
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for _ in range(300):
        y = int(rng.integers(2))
        rows.append((np.array([y, 2 + int(rng.integers(200))]), np.array([1.0, 1.0])))
        labels.append(y)
    weights, _, _ = ftrl(rows, np.array(labels), 2, np.ones(256), l1=2.0)
    assert np.abs(weights[:2]).min() > 0 and (weights[2:] == 0).mean() > 0.9


def test_training_equals_a_plain_loop():
    """FTRL with elastic net, coordinate by coordinate; then the temperature of the least loss on the rows held back."""
    rng = np.random.default_rng(3)
    size, classes, alpha, beta, l1, l2 = 12, 3, 0.5, 1.0, 0.02, 0.1
    idf = rng.uniform(1, 3, size)
    rows, labels = [], []
    for _ in range(60):
        label = int(rng.integers(classes))
        at = np.unique(np.append(rng.integers(0, size, 3), label))
        rows.append((at, rng.integers(1, 5, len(at)).astype(np.uint32)))
        labels.append(label)
    got, got_bias, got_heat = ftrl(rows, np.array(labels), classes, idf, epochs=2)

    order = np.random.default_rng(7).permutation(60)
    back, kept = order[:6], order[6:]
    z, n = [[0.0] * classes for _ in range(size + 1)], [[0.0] * classes for _ in range(size + 1)]

    def weight(i, c):
        if abs(z[i][c]) <= l1:
            return 0.0
        return -(z[i][c] - math.copysign(l1, z[i][c])) / ((beta + math.sqrt(n[i][c])) / alpha + l2)

    def terms(k):
        total = int(rows[k][1].sum())
        return {int(i): int(t) * idf[i] * 30.0 / total for i, t in zip(*rows[k], strict=True)} | {size: 1.0}

    def softmax(scores, heat=1.0):
        top = max(scores)
        e = [math.exp((s - top) / heat) for s in scores]
        return [x / sum(e) for x in e]

    for _ in range(2):
        for k in kept:
            x = terms(k)
            w = {(i, c): weight(i, c) for i in x for c in range(classes)}
            p = softmax([sum(w[i, c] * t for i, t in x.items()) for c in range(classes)])
            for i, t in x.items():
                for c in range(classes):
                    g = t * (p[c] - (labels[k] == c))
                    z[i][c] += g - (math.sqrt(n[i][c] + g * g) - math.sqrt(n[i][c])) / alpha * w[i, c]
                    n[i][c] += g * g
    want = np.array([[weight(i, c) for c in range(classes)] for i in range(size + 1)])
    assert np.allclose(got, want[:-1], atol=1e-9) and np.allclose(got_bias, want[-1], atol=1e-9)
    loss = lambda heat: -sum(math.log(softmax([sum(want[i, c] * t for i, t in terms(k).items()) for c in range(classes)], heat)[labels[k]]) for k in back)
    assert got_heat == min(np.geomspace(0.25, 8, 41), key=loss)
