import json
import os
import sys
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.functions import text as tx
from tablewright.operators import catalog, context, evaluate, inverted, questions, records, retrieve
from tablewright.sources import datasets, parsed, vectors
from tablewright.sources.tables import cut
from tests.test_questions import SCHEMA, asked, seven_pages


@pytest.fixture(scope="module")
def recs(spark):
    return cut(records.retrieval_text(spark.createDataFrame(seven_pages(), SCHEMA)))


@pytest.fixture(scope="module")
def posted(recs):
    return inverted.bm25_index(recs, tx.search_tokens(retrieve.search_text(recs)))


def test_structured_multi_intent(spark, recs):
    q = asked(spark, "inlet line size and material code of UNIT-3A", "colour of UNIT-1A", "water pressure of UNIT-2A")
    got = {}
    for r in questions.structured_multi_intent(recs, q).orderBy("query_id", "intent_index", "rank").collect():
        got.setdefault((r.query_id, r.intent_index), []).append(r.record_id)
    assert got[0, 0] == ["p03_r8_inlet"] and got[0, 1] == ["p03_r58"]
    assert got[1, 0] == [None]
    assert (2, 0) in got and len(got) == 4


def test_grounded_from_question_to_answer(spark, recs, posted):
    q = spark.createDataFrame([(0, "material code of UNIT-2A"), (1, "  "), (2, None)], "query_id int, query string")
    out = questions.grounded(recs, posted, q, k=3, generate=lambda system, user: f"{len(user) > 0}")
    assert sorted(r.query_id for r in out.rejected.collect()) == [1, 2]
    hits = [r.record_id for r in out.hits.orderBy("rank").collect()]
    assert hits[0] == "p02_r58" and len(hits) <= 3 and out.unresolved.count() == 0
    text = out.contexts.collect()
    assert [r.query_id for r in text] == [0] and "TC9725132581" in text[0].context_text
    assert [(r.query_id, r.answer, r.llm_used) for r in out.answers.collect()] == [(0, "True", True)]
    half = questions.grounded(recs, posted, q, known=recs.filter("record_id <> 'p02_r58'"), k=3)
    assert [r.record_id for r in half.unresolved.collect()] == ["p02_r58"]
    assert [r.answer for r in half.answers.collect()] == [context.INSUFFICIENT]
    assert questions.grounded(recs, posted, q.limit(0)).answers.collect() == []


def test_index_violations(recs):
    items, values = catalog.item_index(recs), catalog.value_index(catalog.value_entries(recs))
    assert catalog.index_violations(items, values).collect() == []
    bad = catalog.index_violations(items.drop("value").limit(0), values)
    assert sorted(map(tuple, bad.collect())) == [("columns", "items lacks value"), ("no_items", "there are no items")]


def test_contexts_tell_where_records_come_from(spark, recs):
    hits = recs.filter("item = 'UNIT-1A'").withColumn("query_id", F.lit(0)).withColumn("rank", F.row_number().over(retrieve.Window.orderBy("ord"))).withColumn("mode", F.lit("m"))
    cases = spark.createDataFrame([(0,)], "query_id int")
    for c, kind in {"expected_mode": "string", "expected_ids": "array<string>", "expected_count": "int", "min_count": "int", "expected_empty": "boolean", "expected_contains": "array<string>"}.items():
        cases = cases.withColumn(c, F.lit(None).cast(kind))
    told = context.build_context(hits)
    assert context.context_violations(told, hits, cases).collect() == []
    less = told.withColumn("context_text", F.replace("context_text", F.lit("Page: 1"), F.lit("")))
    assert [r.check for r in context.context_violations(less, hits, cases).collect()] == ["provenance"]
    assert [r.check for r in context.context_violations(told, hits.withColumn("page", F.lit(None).cast("int")), cases).collect()] == ["provenance"]


def test_report(spark, tmp_path):
    golden = spark.createDataFrame([(1, "a", ["x", "y"]), (2, "a", ["z"]), (3, "none", []), (4, "none", [])], "query_id int, category string, expected array<string>")
    hits = spark.createDataFrame([(1, "y", 1), (1, "q", 2), (1, "x", 3), (2, "q", 1), (2, "q", 2), (4, "x", 1)], "query_id int, record_id string, rank int")
    out = evaluate.report(golden, hits)
    assert sorted((r.query_id, r.got) for r in out.failures.collect()) == [(2, ["q"]), (4, ["x"])]
    percent = {r.category: r for r in out.percent.collect()}
    assert percent["a"].recall == "50.00%" and percent["none"].recall == "50.00%" and percent["ALL"].queries == 4
    assert percent["a"].precision == "33.33%"
    evaluate.write_report(out, f"file://{tmp_path}/r")
    assert spark.read.json(f"file://{tmp_path}/r/failures").count() == 2


def test_models_of_no_server():
    assert context.listed_models("http://127.0.0.1:9", timeout=1) is None


def test_vector_table(spark, recs, tmp_path):
    texts = recs.select("record_id", retrieve.embedding_text(recs).alias("text"))
    own = vectors.encoded(texts, lambda ts: np.array([[len(t), 1.0] for t in ts]))
    vectors.write_vectors(recs, own, f"file://{tmp_path}/v")
    back = vectors.read_vectors(spark, f"file://{tmp_path}/v")
    assert {"vector_id", "record_id", "page", "values", "embedding"} <= set(back.columns)
    want = {r.record_id: [float(len(r.text)), 1.0] for r in texts.collect()}
    assert {r.record_id: r.embedding for r in back.collect()} == want
    assert sorted(r.vector_id for r in back.collect()) == [r.ord for r in recs.orderBy("ord").collect()]
    assert vectors.encoded(texts.limit(0), lambda ts: np.zeros((len(ts), 2))).collect() == []


def test_files_and_artifacts(spark, tmp_path):
    for name, raw in {"a.json": b'{"a": 1}', "b.txt": b"x", "c.json": b"[1]", "d.json": b"{\xff"}.items():
        (tmp_path / name).write_bytes(raw)
    found = sorted((os.path.basename(r.path), r.rule) for r in datasets.file_violations(spark, f"file://{tmp_path}").collect())
    assert found == [("b.txt", "suffix"), ("c.json", "root_object"), ("d.json", "utf8")]
    assert [r.rule for r in datasets.file_violations(spark, f"file://{tmp_path}/none.json").collect()] == ["missing"]
    one = lambda value: spark.createDataFrame([(json.dumps(value),)], "json string")
    rules = lambda *values: [r.rule for r in datasets.artifact_violations(*map(one, values)).collect()]
    assert rules({}, {}, [{"record_id": "a"}]) == rules({}, {}, {"records": [1]}) == rules({}, {}, {"retrieval_records": [1]}) == []
    assert rules([], 3, []) == ["catalogue_object", "index_object", "records_empty"]
    assert rules({}, {}, {"other": [1]}) == ["records_list"]


def test_parser_packages(spark, tmp_path):
    pdf = tmp_path / "a.pdf"
    pdf.write_bytes(b"%PDF")
    script = "import sys, zipfile; z = zipfile.ZipFile(sys.argv[2], 'w'); z.writestr('out/content.json', '[1]'); z.writestr('out/a.md', '#'); z.close()"
    package = parsed.run_parser(str(pdf), f"{tmp_path}/out", [sys.executable, "-c", script, "{pdf}", "{out}"])
    assert zipfile.is_zipfile(package)
    rows = parsed.read_packages(spark, f"file://{tmp_path}/out").collect()
    assert [(r.member, bytes(r.content)) for r in rows] == [("out/content.json", b"[1]")]
    with pytest.raises(FileNotFoundError):
        parsed.run_parser(f"{tmp_path}/no.pdf", str(tmp_path), ["true"])
    with pytest.raises(ValueError):
        parsed.run_parser(package, str(tmp_path), ["true"])
    with pytest.raises(RuntimeError):
        parsed.run_parser(str(pdf), f"{tmp_path}/x", ["false"])
