import random

import numpy as np
import pytest

from tablewright.llm.components import components
from tablewright.llm.jaccard_join import Cell, jaccard_components


def brute_set(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(docs):
    sets = {d: brute_set(t) for d, t in docs}
    label = {d: d for d in sets}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                ra, rb = root(a), root(b)
                label[max(ra, rb)] = min(ra, rb)
    return sorted((d, len(sets[d]), root(d)) for d in ids)


def corpus(seed, size):
    rng = random.Random(seed)
    words = [f"W{k}" for k in range(3000)]
    passage = [rng.choice(words) for _ in range(60)]
    docs, bases = [], []
    for d in range(size):
        kind = rng.random()
        if kind < 0.35 or not bases:
            text = [rng.choice(words) for _ in range(rng.choice([1, 3, 5, 6, 12, 40, 150, 400]))]
            if rng.random() < 0.4:
                text[rng.randrange(len(text)) : 0] = passage
            bases.append(text)
        else:
            text = list(rng.choice(bases))
            for _ in range(rng.randrange(0, 1 + len(text) // 25)):
                text[rng.randrange(len(text))] = rng.choice(words)
            if kind > 0.8:
                bases.append(text)
        docs.append((d * 3, (" " if kind < 0.5 else "\n").join(text)))
    return docs


@pytest.mark.parametrize("seed,size,cell_tokens,cell_queries", [(1, 350, 200_000, 1000), (2, 350, 600, 3), (3, 350, 1500, 1000)])
def test_components_match_brute_force(spark, seed, size, cell_tokens, cell_queries):
    docs = corpus(seed, size)
    frame = spark.createDataFrame([(a, b, "x", 1) for a, b in docs], "doc_id long, text string, component_id string, n int").repartition(5)
    got = jaccard_components(frame, bucket_text=1 << 16, cell_tokens=cell_tokens, cell_queries=cell_queries)
    assert sorted(map(tuple, got.collect())) == brute(docs)


def test_threshold_is_exact(spark):
    a = [f"a{k}" for k in range(11)]  # 7 shingles
    docs = [(1, " ".join(a)), (2, " ".join(a[:10])), (3, " ".join(a + ["b"])), (4, " ".join(["z"] + a[:8]))]
    docs += [(10, "one two"), (11, "ONE  two"), (12, "one two three"), (13, None), (14, ""), (15, " \n"), (16, "x " * 60000), (17, "x " * 9)]
    got = jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute(docs)


def test_hot_copies_null_and_repeated_ids(spark):
    rng = random.Random(4)
    base = [f"w{k}" for k in range(40)]
    docs = [(d, " ".join(base)) for d in range(200)]
    for d in range(200, 400):
        own = list(base)
        own[rng.randrange(40)] = f"edit{d}"
        docs.append((d, " ".join(own)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = jaccard_components(frame, cell_tokens=400, cell_queries=5)
    assert sorted(map(tuple, got.collect())) == brute(docs)
    odd = spark.createDataFrame([(None, "a b"), (None, "a b c d e f g"), (7, "a b c d e f g"), (7, "a b c d e f g"), (8, "a b c d e f g")], "doc_id long, text string")
    assert sorted(map(str, map(tuple, jaccard_components(odd).collect()))) == ["(7, 3, 7)", "(8, 3, 7)", "(None, 1, None)", "(None, 3, None)"]
    assert jaccard_components(odd.limit(0)).collect() == []


def test_components_of_chains(spark):
    links = [(k, k + 1) for k in range(0, 70)] + [(200, 150), (150, 175)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(71)) and {got[k] for k in (150, 175, 200)} == {150}


def test_cell_opens_only_with_enough_overlap():
    cell = Cell(np.array([1, 2, 3, 4, 10, 11, 12]), np.array([0, 4, 7]))
    assert cell.linked(np.array([1, 2, 3, 4]), 75, np.arange(2)).tolist() == [0]
    assert cell.linked(np.array([1, 2, 10, 20]), 75, np.arange(2)).tolist() == []
    assert cell.own_components(75).tolist() == [0, 1]


@pytest.mark.parametrize("cell_tokens,cell_queries", [(200_000, 1000), (600, 3)])
def test_links_match_brute_force(spark, cell_tokens, cell_queries):
    docs = corpus(6, 250)
    rng, base = random.Random(7), [f"w{k}" for k in range(40)]
    for d in range(2000, 2060):  # near copies, some of them equal, with several links each
        own = list(base)
        own[rng.randrange(40)] = f"edit{d % 45}"
        docs.append((d, " ".join(own)))
    docs.append((3000, ""))
    sets = {d: brute_set(t) for d, t in docs}
    linked = lambda x, y: bool(x and y) and 100 * len(x & y) >= 75 * len(x | y)
    want = sorted((*row, sum(e != row[0] and linked(sets[row[0]], y) for e, y in sets.items())) for row in brute(docs))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = jaccard_components(frame, bucket_text=1 << 16, cell_tokens=cell_tokens, cell_queries=cell_queries, links=True)
    assert sorted(map(tuple, got.collect())) == want and max(r[3] for r in want) > 20


def test_links_of_repeated_null_and_no_rows(spark):
    odd = spark.createDataFrame([(None, "a b c d e f g"), (7, "a b c d e f g"), (7, "a b c d e f g"), (8, "a b c d e f g"), (9, "z")], "doc_id long, text string")
    assert sorted(map(str, map(tuple, jaccard_components(odd, links=True).collect()))) == ["(7, 3, 7, 1)", "(8, 3, 7, 1)", "(9, 1, 9, 0)", "(None, 3, None, 0)"]
    assert jaccard_components(odd.limit(0), links=True).collect() == []
