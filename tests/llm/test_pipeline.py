import random

import numpy as np
import tiktoken

import corpus_pipeline
from tablewright.llm.bpe import production, read_ranks
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_jaccard_join import brute as groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    letters = {"aa": "aeiostrn", "bb": "áéíóñrst"}
    make = lambda lang, n: ["".join(rng.choice(letters[lang]) for _ in range(rng.randrange(2, 8))) for _ in range(n)]
    items = [(k, " ".join(make("aa", 30))) for k in range(5)]
    docs = []
    for d in range(160):
        lang = rng.choice(["aa", "bb"])
        text = make(lang, rng.randrange(20, 120))
        if d % 17 == 0:
            text[3:3] = items[d % 5][1].split()
        docs.append((d, " ".join(text), lang))
    for d in range(160, 220):
        _, text, lang = docs[rng.randrange(160)]
        own = text.split()
        if d % 2:
            own[rng.randrange(len(own))] = "edit"
        docs.append((d, " ".join(own), lang))
    docs += [(300, None, "aa"), (301, "", None), (302, "123 456 !!", "bb"), (303, "aeiost rean " * 20000, None), (0, docs[0][1], "aa")]
    return docs, items


def test_stages_match_brute_force(spark, tmp_path):
    docs, items = corpus()
    spark.createDataFrame([(d, t, lang, "s", 1) for d, t, lang in docs], SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(got)

    left = [(d, t) for d, t, _ in docs if t and any(c.isalpha() for c in t)]
    last = {}
    for d, t in left:
        last[t] = max(d, last.get(t, -1))
    left = [(d, t) for t, d in last.items()]
    left = [(d, t) for (d, t), (_, _, c) in zip(sorted(left), groups(left), strict=True) if d == c]
    bad = {r[0] for r in leaks(left, items)}
    want = {d: t for d, t in left if d not in bad}
    assert set(got) == set(want)
    oracle = tiktoken.Encoding("own", pat_str=production()[1], mergeable_ranks=read_ranks(production()[0]), special_tokens={})
    for d, t in want.items():
        assert got[d].text == t and np.frombuffer(got[d].ids, "<u4").tolist() == oracle.encode_ordinary(t)


def test_stages_keep_columns_and_survive_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA + ", score string, kept string")
    spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, none, str(tmp_path))
        assert out.columns == none.columns and out.collect() == []
    assert corpus_pipeline.tokens(spark, none, str(tmp_path)).collect() == []


def test_null_and_clashing_ids_get_their_own_decision(spark, tmp_path):
    text = lambda c, n=12: " ".join(f"{c}{k}" for k in range(n))
    spark.createDataFrame([(1, text("item"))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    left = lambda stage, *rows: sorted(((r.doc_id or -1, r.text) for r in stage(spark, frame(*rows), str(tmp_path)).collect()))
    # a copy goes by its own text: of the clashing id 7 only the row equal to 9, of rows without id those equal to others
    got = left(corpus_pipeline.exact, (7, text("a")), (7, text("b")), (9, text("a")), (None, text("a")), (None, text("c")), (None, text("c")))
    assert got == [(-1, text("c")), (7, text("b")), (9, text("a"))]
    got = left(corpus_pipeline.near, (7, text("a", 41)), (7, text("b")), (3, text("a", 40)), (None, text("a", 42)), (None, text("c")))
    assert got == [(-1, text("c")), (3, text("a", 40)), (7, text("b"))]
    got = left(corpus_pipeline.clean_of_benchmarks, (7, text("item")), (7, text("b")), (None, "x " + text("item")), (None, text("c")))
    assert got == [(-1, text("c")), (7, text("b"))]


def test_dotted_and_clashing_column_names(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, "aeio rst nae", "aa", 5, "x", 7), (2, "aeio rst nae", "aa", 6, "y", 8)], "doc_id long, text string, lang string, `n.chars` long, score string, _id long")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns[:6] == ["doc_id", "text", "lang", "n.chars", "score", "_id"] or name == "byte_bpe"
    assert [(r["doc_id"], r["n.chars"], r["score"], r["_id"]) for r in docs.collect()] == [(2, 6, "y", 8)]


def test_columns_named_like_those_of_the_stages_are_kept(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(k, f"aeio rst nae {k}", "aa", "mine", 0.25, "d", b"i", 9, "s", "t") for k in (1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _lang string, _SURE double, decoded string, ids binary, N_TOKENS int, ids_sha256 string, _row string")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "byte_bpe":
            assert docs.columns == ["doc_id", "text", "lang", "_lang", "_SURE", "decoded", "ids", "N_TOKENS", "ids_sha256", "_row"]
    got = docs.collect()
    assert len(got) == 2 and len(docs.columns) == len({c.lower() for c in docs.columns})
    for r in got:
        assert (r["_lang"], r["_SURE"], r["decoded"], bytes(r["ids_own"]), r["n_tokens_own"], r["ids_sha256_own"], r["_row"]) == ("mine", 0.25, "d", b"i", 9, "s", "t")
        assert r["n_tokens"] == len(r["ids"]) // 4 and len(r["decoded_sha256"]) == 64
