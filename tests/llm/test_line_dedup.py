import random

import pytest

from tablewright.llm.line_dedup import line_dedup, line_table, suffix_levels

SCHEMA = "doc_id long, text string, p long, first string, d long"


def brute(docs, least_lines, least_words):
    seen, gone = {}, set()
    order = sorted((d, t or "") for d, t in docs)
    h = 1
    while h <= least_lines:
        seen = set()
        for d, t in order:
            ls = t.split("\n")
            for p in range(len(ls) - h + 1):
                s = tuple(ls[p : p + h])
                if s in seen and (h == least_lines or len(" ".join(s).split()) >= least_words):
                    gone |= {(d, q) for q in range(p, p + h)}
                seen.add(s)
        h *= 2
    out = []
    for d, t in order:
        ls = t.split("\n")
        off = [p for p in range(len(ls)) if (d, p) in gone]
        runs, last = [], None
        for p in off:
            if last is not None and p == last + 1:
                runs[-1] += 1
            else:
                runs.append(1)
            last = p
        out.append((d, len(ls), len(off), len(runs), max(runs, default=0), "\n".join(x for p, x in enumerate(ls) if (d, p) not in gone)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    lines = [" ".join(rng.choice("abcdef") * rng.randrange(1, 4) for _ in range(rng.choice([0, 1, 2, 5, 9, 25]))) for _ in range(60)] + ["", "", "x"]
    docs = [(d, "\n".join(rng.choice(lines) if rng.random() < 0.6 else f"line {rng.random()}" for _ in range(rng.randrange(1, 30)))) for d in range(120)]
    docs += [(200 + k, docs[k][1]) for k in range(20)] + [(300, None), (301, ""), (302, "same\n" * 4000), (303, "\n\n\n")]
    return docs


@pytest.mark.parametrize("least_lines,least_words", [(4, 20), (1, 3), (2, 1000), (8, 12)])
def test_deletions_match_brute_force(spark, least_lines, least_words):
    docs = corpus(least_lines)
    frame = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in docs], SCHEMA).repartition(4)
    got = line_dedup(frame, least_lines=least_lines, least_words=least_words, every_length=False)
    assert sorted(map(tuple, got.collect())) == brute(docs, least_lines, least_words)


def test_ranks_are_the_order_of_suffixes(spark):
    docs = corpus(9)[:60]
    lines = line_table(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").persist()
    lid = {(r.d, r.p): r.lid for r in lines.collect()}
    for h, level in suffix_levels(lines, 4):
        rows = sorted((r["rank"], tuple(lid[r.d, r.p + k] for k in range(h)), (r.first.d, r.first.p)) for r in level.collect())
        keys = [k for _, k, _ in rows]
        assert keys == sorted(keys)
        assert all((a[0] == b[0]) == (a[1] == b[1]) and (a[1] != b[1] or a[2] == b[2]) for a, b in zip(rows, rows[1:], strict=False))


def test_edge_rows(spark):
    long = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(None, long), (4, long), (4, long), (5, long + "\nmore")], "doc_id long, text string")
    assert sorted(((r.doc_id or 0, r.n_removed, r.text) for r in line_dedup(docs).collect())) == [(0, 0, long), (4, 1, ""), (4, 1, ""), (5, 1, "more")]
    assert line_dedup(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        line_dedup(docs, least_lines=3, every_length=False)


def test_every_length_finds_runs_of_three_lines(spark):
    three = "\n".join(" ".join(f"{c}{k}" for k in range(9)) for c in "abc")  # 27 words, 18 in any 2 lines
    docs = [(1, "x\n" + three), (2, three + "\ny"), (3, "z")]
    got = {r.doc_id: (r.n_removed, r.longest_run, r.text) for r in line_dedup(spark.createDataFrame(docs, "doc_id long, text string"), every_length=True).collect()}
    assert got == {1: (0, 0, docs[0][1]), 2: (3, 3, "y"), 3: (0, 0, "z")}


@pytest.mark.parametrize("least_lines,least_words", [(4, 20), (3, 12), (5, 12)])
def test_every_length_matches_brute_force(spark, least_lines, least_words):
    docs = corpus(least_lines + 20)
    order, gone = sorted((d, t or "") for d, t in docs), set()
    for h in range(1, least_lines + 1):
        seen = set()
        for d, t in order:
            ls = t.split("\n")
            for p in range(len(ls) - h + 1):
                run = tuple(ls[p : p + h])
                if run in seen and (h == least_lines or len(" ".join(run).split()) >= least_words):
                    gone |= {(d, q) for q in range(p, p + h)}
                seen.add(run)
    want = sorted((d, "\n".join(x for p, x in enumerate(t.split("\n")) if (d, p) not in gone)) for d, t in order)
    got = line_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), least_lines=least_lines, least_words=least_words, every_length=True)
    assert sorted((r.doc_id, r.text) for r in got.collect()) == want
