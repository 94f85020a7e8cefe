import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tablewright.llm.collocations import collocations, packed, unpacked

SCHEMA = "text string, lang string, chunk string, words string, id string"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least, most=4, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(ws)
            f[lang or "und"].update(tuple(ws[i : i + k]) for k in range(1, most + 1) for i in range(len(ws) - k + 1))
    out = []
    for lang, c in f.items():
        found = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        rows = []
        for g, a in found.items():
            score, k = min((2_000_000 * a // (c[g[:k]] + c[g[k:]]), k) for k in range(1, len(g)))
            if not any(len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h))) and 100 * b >= 80 * a for h, b in found.items()):
                rows.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("seed,words,top", [(1, "a b c", 2000), (2, "One two THREE four É ß, x. y", 7), (3, "new york city of the a b c d e f", 2000)])
def test_phrases_match_brute_force(spark, seed, words, top):
    rng = random.Random(seed)
    words = words.split()
    rows = [(" ".join(rng.choice(words) + rng.choice(["", "", "", ".", "\t", "\n", "\r\n"]) for _ in range(rng.randrange(40))), rng.choice(["en", "de", None, "und"])) for _ in range(80)]
    rows += [(None, "en"), ("", None), ("  \n", "en"), ("a", "fr"), ("z " * 5000, "xx"), ("no blank at the end", "en"), ("no blank at the end", "en"), ("no blank", "en")] + [("the same text", "en")] * 5
    docs = spark.createDataFrame([(*r, "x", None, "y") for r in rows], SCHEMA).repartition(5)
    got = collocations(docs, least=3, top=top)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == brute(rows, 3, top=top)


def test_empty_table_and_no_frequent_phrase(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations(spark.createDataFrame([("a b", "en", None, None, None)], SCHEMA)).collect() == []
    assert collocations(spark.createDataFrame([("a " * 20 + "b. " * 40, "en", None, None, None)], SCHEMA)).collect() == []


def test_lists_survive_packing():
    rng = np.random.default_rng(1)
    for top in (50, 1 << 40):
        lists = [np.sort(rng.choice(top, size, replace=False)) for size in (1, 5, 20, 1)]
        lengths = np.array([len(x) for x in lists])
        places = np.concatenate(lists)
        assert (unpacked(packed(places, np.cumsum(lengths)[:-1]), lengths) == places).all()
    assert len(unpacked(b"", np.zeros(0, np.int64))) == 0
