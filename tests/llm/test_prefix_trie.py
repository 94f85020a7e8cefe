import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tablewright.llm.prefix_trie import prefix_trie, summed_chains

SCHEMA = "conv_id long, turn long, role string, text string, c string, depth string, owner string, _scan string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def remainder(c, by):
    return c - by * int(c / by)


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - remainder(c, 5), [])[:h] + ts[h:]
    members = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    children = {}
    for s in members:
        if s:
            children.setdefault(s[:-1], []).append(s)

    def sums(s):
        below = [sums(k) for k in children.get(s, [])]
        return sum(b[0] for b in below) or 1, (len(members[s]) - 1) * (len(s[-1][1].encode()) if s else 0) + sum(b[1] for b in below)

    out = []
    for s, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(built[c]) == len(s)))
        out.append((min(cs), len(s), min(members[s[:-1]]) if s else None, len(cs), len(children.get(s, [])), *sums(s), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", None, "y", "z") for r in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("seed", [1, 2])
def test_nodes_match_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(30), -1, -3, -5, 1 << 40, 77_777]:
        said = [rng.choice("ab") for _ in range(rng.randrange(1, 12))]
        rows += [(c, rng.choice([k, k, None]), rng.choice(["user", None]), t * 3) for k, t in enumerate(said)]
    rows += [(40, 1, "user", None), (40, 1, "user", ""), (40, 1, "user", "é" * 9000), (41, 5, "u", "t"), (41, 5, "u", "t"), (None, 1, "user", "lost")]
    rows += [(c, t, "user", "same") for c in range(100, 140) for t in range(3)]
    got = prefix_trie(conversations(spark, rows))
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_a_long_conversation_and_forks_at_every_depth(spark):
    rows = [(10, t, "user", f"t{t}") for t in range(60)]
    rows += [(10 + k, t, "user", f"t{t}" if t < 2 * k else f"own{k}") for k in range(1, 5) for t in range(2 * k + 3)]
    assert sorted(map(tuple, prefix_trie(conversations(spark, rows)).collect()), key=str) == brute(rows)


def test_empty_table_and_rows_without_conversation(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert prefix_trie(conversations(spark, [(None, 1, "a", "b")])).collect() == []


def test_chains_of_any_height_are_summed(spark):
    chains = spark.range(40).select(F.col("id").alias("c"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit(1).cast("long").alias("leaves"), F.col("id").alias("saved"))
    assert sorted(map(tuple, summed_chains(chains).collect())) == [(c, 40 - c, sum(range(c, 40))) for c in range(40)]
