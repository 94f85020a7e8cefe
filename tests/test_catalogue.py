import pytest
from pyspark.sql import functions as F

from tablewright.operators import context
from tablewright.plans.catalogue import QUERIES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    filler = [(k, f"plain words of document {k}", "en", "src2") for k in range(20)]
    docs = [(100, "late", "en", "src1"), (101, "first", "en", "src1"), *filler]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine, first and late")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(k, t, "user", f"c{k}t{t}") for k in (2, 3) for t in (0, 1)], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


@pytest.mark.parametrize("name", ["bm25_topk", "rrf_hybrid", "hybrid_v2"])
def test_terms_after_the_sixth_are_searched(spark, tables, name):
    rank = "rank" if name.startswith("bm25") else "bm25_rank"
    assert {r.record_id for r in QUERIES[name](spark, tables).collect() if (r[rank] or 9) <= 2} == {"100", "101"}


def test_every_intent_of_the_whole_text_is_searched(spark, tables):
    got = {(r.intent_index, r.record_id) for r in QUERIES["multi_intent_search"](spark, tables).collect()}
    assert (1, "101") in got and (2, "100") in got


def test_every_conversation_has_its_context(spark, tables):
    want = {k: f"Context:\n\nc{k}t0\n\nc{k}t1\n\nQuestion:\n\nc{k}t1\n\nAnswer using only the context above." for k in (2, 3)}
    told = spark.createDataFrame(list(want.items()), "query_id long, user string").select("query_id", F.sha2("user", 256)).collect()
    assert sorted(map(tuple, QUERIES["prompt"](spark, tables).collect())) == sorted(map(tuple, told))


def test_a_query_without_context_gets_the_placeholder(spark):
    asked = spark.createDataFrame([(1, "q"), (2, "q")], "query_id int, query string")
    found = spark.createDataFrame([(1, "known")], "query_id int, context_text string")
    got = {r.query_id: r.user for r in context.prompts(asked, found).collect()}
    assert got[1].startswith("Context:\n\nknown\n\n") and got[2].startswith("Context:\n\nNO RETRIEVED RECORDS.\n\n")
