import random

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from tablewright.llm.simhash_ball import ball, fingerprints, links, near_duplicates, xxh64
from tablewright.llm.components import components

SCHEMA = "doc_id long, text string, fp string, label string, _id string"


def brute_print(text):
    ws = regex.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not ws:
        return 0
    runs = [" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))]
    hs = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows, radius=4):
    prints = [brute_print(t) for _, t in rows]
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                label[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(doc, least.get(top(i), doc))
    return sorted(((doc, f"{p:016x}", least.get(top(i))) for i, ((doc, _), p) in enumerate(zip(rows, prints))), key=str)


def test_hash_is_xxh64():
    data = np.frombuffer(random.Random(1).randbytes(5000), np.uint8)
    spans = [(a, a + n) for n in [*range(0, 100), 255, 512, 513, 2000] for a in (0, 3, 7, 2999 if n <= 2000 else 0)]
    starts, ends = np.array(spans).T
    assert xxh64(data, starts, ends).tolist() == [xxhash.xxh64_intdigest(data[a:b].tobytes(), 42) for a, b in spans]


def test_prints_match_brute_force():
    rng = random.Random(2)
    texts = ["", " \t\n", "One", "É ß two\x0bTHREE", "a " * 1000, "w" * 3000 + " x y z q"] + [" ".join(rng.choice(["ab", "Cd", "éé", "x" * 40, "\n"]) for _ in range(rng.randrange(900))) for _ in range(30)]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    got = fingerprints(np.frombuffer(b"".join(raw), np.uint8), offsets)
    assert got.tolist() == [brute_print(t) for t in texts]


@pytest.mark.parametrize("shard_variants", [1 << 22, 3000])
def test_no_link_is_lost(spark, shard_variants):
    rng = random.Random(3)
    found = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        found.add(base)
        for _ in range(4):
            base ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 7)))
            found.add(base)
    found = sorted(found | set(ball(1).tolist()) | {(1 << 64) - 1})
    signed = [x - (1 << 64) if x >> 63 else x for x in found]
    prints = spark.createDataFrame([(x,) for x in signed], "fp long")
    pairs = links(prints, shard_variants=shard_variants)
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() for r in pairs.collect())
    got = {r.node % (1 << 64): r.label % (1 << 64) for r in components(pairs).collect()}
    want = {x: x for x in found}
    for _ in found:
        for x in found:
            want[x] = min((want[y] for y in found if (x ^ y).bit_count() <= 4), key=lambda v: v - (1 << 64) if v >> 63 else v)
    assert {x: got.get(x, x) for x in found} == want


def test_components_match_brute_force(spark):
    rng = random.Random(4)
    base = " ".join(f"w{rng.randrange(400)}" for _ in range(300))
    rows = []
    for k in range(60):
        ws = base.split()
        for _ in range(rng.randrange(4)):
            ws[rng.randrange(300)] = "new"
        rows.append((k, " ".join(ws)))
    rows += [(100 + k, " ".join(f"v{rng.randrange(50)}" for _ in range(rng.randrange(40)))) for k in range(60)]
    rows += [(300, None), (301, ""), (None, " \n"), (None, base), (302, base), (302, base), (303, "z" * 50000)]
    docs = spark.createDataFrame([(*r, "x", None, "y") for r in rows], SCHEMA).repartition(5)
    got = near_duplicates(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_empty_table_and_rows_without_id(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    got = near_duplicates(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.component_id) for r in got] == [(None, None)]


def test_odd_radius_is_refused(spark):
    with pytest.raises(ValueError):
        links(spark.createDataFrame([(1,)], "fp long").select(F.col("fp")), radius=3)
