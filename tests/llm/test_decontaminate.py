import random
import tracemalloc

import numpy as np
import pytest

from tablewright.llm.decontaminate import BINS, Index, contamination, minima


def brute_set(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs, items):
    out = []
    for d, text in docs:
        have = brute_set(text)
        for i, item in items:
            own = brute_set(item)
            both = len(have & own)
            if own and 100 * both >= 75 * len(own):
                out.append((d, i, len(own), both))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(4000)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(k, " ".join(make(rng.choice([2, 5, 6, 9, 16, 30, 59, 120])))) for k in range(60)] + [(90, None), (91, ""), (92, "same words here again now"), (93, "same words here again now")]
    docs = []
    for d in range(150):
        text = make(rng.randrange(3, 3000))
        for _ in range(rng.randrange(3)):
            own = items[rng.randrange(60)][1].split()
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = "Edit"
            at = rng.randrange(len(text))
            text[at:at] = [w.upper() for w in own]
        docs.append((d, "\n".join(text)))
    return docs + [(500, items[0][1]), (501, None), (502, ""), (503, "x same words here again now y"), (503, "x same words here again now y")], items


@pytest.mark.parametrize("block", [2_000_000, 300])
def test_pairs_match_brute_force(spark, block):
    docs, items = corpus()
    left = spark.createDataFrame([(a, b, "c") for a, b in docs], "doc_id long, text string, item_id string").repartition(5)
    right = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(left, right, block=block).collect()
    assert sorted(((r.doc_id, r.item_id, r.item_shingles, r.shared) for r in got), key=str) == brute(docs, items)


def test_empty_sides(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert len(contamination(docs, items).collect()) == 1
    assert contamination(docs.limit(0), items).collect() == []
    assert contamination(docs, items.limit(0)).collect() == []


def test_null_ids_and_a_long_item_in_a_long_document(spark):
    rng = random.Random(8)
    item = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    text = [f"x{k}" for k in range(20_000)] + item[:2400] + [f"y{k}" for k in range(20_000)]
    docs = spark.createDataFrame([(None, " ".join(text)), (1, "a b c d e f"), (2, " ".join(item[:1500]))], "doc_id long, text string")
    items = spark.createDataFrame([(5, " ".join(item)), (None, "a b c d e f")], "item_id long, text string")
    assert sorted(((r.doc_id, r.item_id, r.item_shingles, r.shared) for r in contamination(docs, items).collect()), key=str) == [(1, None, 2, 2), (None, 5, 2996, 2396)]


def test_candidates_reach_recall_with_signatures_of_bounded_size():
    """MinHash alone, before verification: items of every size with a quarter of their shingles replaced, within long documents."""
    rng = np.random.default_rng(4)
    found = total = 0
    for n in (1, 2, 5, 9, 17, 30, 33, 65, 129, 257, 513, 1100):
        items = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)) for _ in range(20)]
        index = Index(list(enumerate(items)))
        for k, own in enumerate(items):
            kept = rng.permutation(own)[: -(-3 * len(own) // 4)]
            noise = rng.integers(0, 1 << 63, 5 * n + 40).astype(np.uint64) * np.uint64(2) + np.uint64(1)
            at = int(rng.integers(0, len(noise)))
            hashes = np.concatenate([noise[:at], kept, noise[at:]])
            pairs = index.candidates(np.zeros(len(hashes), np.int64), hashes, np.zeros(1, np.int64), np.array([len(hashes)]))
            found, total = found + ([0, k] in pairs.tolist()), total + 1
    assert found == total
    assert len(minima(np.sort(rng.integers(0, 1 << 63, 60_000).astype(np.uint64)), BINS)) <= 1 << BINS


def test_memory_grows_linearly_with_the_item():
    rng = np.random.default_rng(5)
    own = np.unique(rng.integers(0, 1 << 63, 60_000).astype(np.uint64))
    index = Index([(1, own)])
    hashes = np.concatenate([rng.integers(0, 1 << 63, 40_000).astype(np.uint64), rng.permutation(own)])
    tracemalloc.start()
    pairs = index.candidates(np.zeros(len(hashes), np.int64), hashes, np.zeros(1, np.int64), np.array([len(hashes)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pairs.tolist() == [[0, 0]] and peak < 60 << 20
