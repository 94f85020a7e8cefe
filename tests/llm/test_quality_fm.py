import math
import random
import zlib

import numpy as np

from tablewright.llm.quality_fm import FACTORS, FEATURES, STATISTICS, WORD_BUCKETS, Machine, features, fit, op5_quality_classifier, score, train

SCHEMA = "doc_id long, text string, lang string, source string, score string"


def corpus(n=500):
    rng = random.Random(8)
    docs, labels = [], []
    for d in range(n):
        good = rng.random() < 0.7
        text = ["".join(rng.choice("aeiostrn") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(5, 60))]
        if not good:
            text = [w.upper() + "!!" if rng.random() < 0.6 else w for w in text]
        docs.append((d, " ".join(text), "aa", "s", "c"))
        if rng.random() < 0.8:
            labels.append((d, int(good), 0))
    return docs, labels


def offsets_of(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def test_identity_equals_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    machine = Machine(0.1, rng.normal(0, 0.1, FEATURES), rng.normal(0, 0.3, (FEATURES, FACTORS)), np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    texts = ["one two two three", "", "A b C! | d"]
    data, offsets = offsets_of(texts)
    of, bucket, value, stats = features(data, offsets)
    dense = machine.standardised(stats)
    for k, p in enumerate(machine.score(data, offsets)):
        at = np.concatenate([bucket[of == k], np.arange(WORD_BUCKETS, FEATURES)])
        x = np.concatenate([value[of == k], dense[k]])
        z = machine.b + machine.w[at] @ x
        for i in range(len(x)):
            for j in range(i + 1, len(x)):
                z += machine.v[at[i]] @ machine.v[at[j]] * x[i] * x[j]
        assert abs(p - 1 / (1 + np.exp(-z))) < 1e-9


def test_held_out_accuracy_and_edge_rows(spark, tmp_path):
    docs, labels = corpus()
    docs += [(900, None, "aa", None, None), (901, "", None, "s", None), (902, "word " * 50000, "aa", "s", None), (902, "word " * 50000, "aa", "s", None), (None, "x", "aa", "s", None)]
    labels += [(900, 0, None), (None, 1, 1), (3, None, None)]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op5_quality_classifier(spark, str(tmp_path)).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = {d: y for d, y, _ in labels[:-3]}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95


def test_nothing_to_learn_and_empty_tables(spark):
    docs, labels = corpus(20)
    docs = spark.createDataFrame(docs, SCHEMA)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert fit(docs, labels.limit(0)) is None and fit(docs.limit(0), labels) is None
    assert {r.score for r in score(docs, None).collect()} == {0.5}
    assert score(docs.limit(0), fit(docs, labels)).collect() == []


def test_training_equals_a_plain_loop():
    """Adagrad on the logistic loss, weight by weight with the gradient of the sum over pairs."""
    texts, labels = ["one two two three", "A b C! | d", "one one", "b 3 | two", "x"], np.array([1, 0, 1, 0, 1])
    of, bucket, value, stats = features(*offsets_of(texts))
    rows = [(bucket[of == k], value[of == k], stats[k]) for k in range(len(texts))]
    got = train(rows, labels, epochs=3, rate=0.1, decay=2e-3, seed=5)

    rng = np.random.default_rng(5)
    v = {(i, f): x for i, line in enumerate(rng.normal(0, 0.02, (FEATURES, FACTORS))) for f, x in enumerate(line)}
    w, gw, gv, gb = [0.0] * FEATURES, [1e-2] * FEATURES, dict.fromkeys(v, 1e-2), 1e-2
    b = math.log(0.6 / 0.4)
    mean, scale = stats.mean(axis=0), stats.std(axis=0) + 1e-6
    for _ in range(3):
        for k in rng.permutation(len(rows)):
            dense = np.clip((stats[k] - mean) / scale, -4, 4) / math.sqrt(len(STATISTICS))
            x = dict(zip(rows[k][0].tolist(), rows[k][1].tolist(), strict=True)) | {WORD_BUCKETS + n: t for n, t in enumerate(dense.tolist())}
            z = b + sum(w[i] * t for i, t in x.items())
            at = list(x)
            z += sum(v[at[i], f] * v[at[j], f] * x[at[i]] * x[at[j]] for i in range(len(at)) for j in range(i + 1, len(at)) for f in range(FACTORS))
            g = 1 / (1 + math.exp(-z)) - labels[k]
            total = [sum(v[i, f] * t for i, t in x.items()) for f in range(FACTORS)]
            dv = {(i, f): g * t * (total[f] - v[i, f] * t) + 2e-3 * v[i, f] for i, t in x.items() for f in range(FACTORS)}
            gb += g * g
            b -= 0.1 * g / math.sqrt(gb)
            for i, t in x.items():
                d = g * t + 2e-3 * w[i]
                gw[i] += d * d
                w[i] -= 0.1 * d / math.sqrt(gw[i])
            for key, d in dv.items():
                gv[key] += d * d
                v[key] -= 0.1 * d / math.sqrt(gv[key])
    assert abs(got.b - b) < 1e-9 and np.allclose(got.w, w, atol=1e-9)
    assert np.allclose(got.v, np.array([[v[i, f] for f in range(FACTORS)] for i in range(FEATURES)]), atol=1e-9)
