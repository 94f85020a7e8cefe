import pytest
from pyspark.sql import functions as F

from tablewright.functions import text as tx
from tablewright.operators import catalog, context, evaluate, inverted, questions, records, retrieve
from tablewright.operators.vocabulary import with_best
from tablewright.sources.tables import cut

ITEMS = [f"UNIT-{k}A" for k in range(1, 8)]
SCHEMA = "record_id string, ord long, page int, table_id string, row_number int, item string, section string, subsection string, parameter string, sub_parameter string, sub_sub_parameter string, side string, values map<string,string>, values_json map<string,string>"


def seven_pages():
    rows = []
    for p, item in enumerate(ITEMS, 1):
        base = (p, "t")
        add = lambda no, section, parameter, sub, side, values: rows.append((f"p{p:02d}_r{no}" + (f"_{side}" if side else ""), len(rows), *base, no, item, section, None, parameter, sub, None, side, values, {k: f'"{v}"' for k, v in values.items()}))  # noqa: B023, E731
        add(1, None, "ITEM", None, None, {"value": item})
        for side in ("inlet", "outlet"):
            add(8, "STEAM CONDITIONS", "Line Size", "Piping Class", side, {"value": f"{p}", "class": f"A{p}A"})
            add(12, "STEAM CONDITIONS", "Flow", None, side, {"min": "1", "normal": "2", "max": "3", "unit": "t/h"})
        add(30, "WATER CONDITIONS", "Press.", None, None, {"value": f"{p}0"})
        add(58, "WATER CONDITIONS", "Material Code", None, None, {"value": f"TC97{p}5132581"})
    return rows


@pytest.fixture(scope="module")
def recs(spark):
    return cut(records.retrieval_text(spark.createDataFrame(seven_pages(), SCHEMA)))


@pytest.fixture(scope="module")
def posted(recs):
    return inverted.bm25_index(recs, tx.search_tokens(retrieve.search_text(recs)))


def asked(spark, *texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "query_id int, query string")


def ids(hits, by="rank"):
    out = {}
    for r in hits.orderBy("query_id", by).collect():
        out.setdefault(r.query_id, []).append(r.record_id)
    return out


def test_rule_parser(spark, recs):
    q = asked(spark, "What is the inlet line size of unit-1A?", "piping class of the outlet steam of UNIT-2A", "normal flow", "water pressure of Unit-3a", "steam flow maximum", "turbine shaft of UNIT-1A")
    got = {r.query_id: r for r in questions.parse(q, recs).collect()}
    assert (got[0].q_item, got[0].q_parameter, got[0].q_side, got[0].problems) == ("UNIT-1A", "Line Size", "inlet", [])
    assert (got[1].q_item, got[1].q_parameter, got[1].q_sub_parameter, got[1].q_side, got[1].q_value_field) == ("UNIT-2A", "Line Size", "Piping Class", "outlet", "class")
    assert (got[2].q_item, got[2].q_parameter, got[2].q_value_field, got[2].problems) == (None, "Flow", "normal", ["item"])
    assert (got[3].q_parameter, got[3].q_section, got[4].q_section, got[4].q_value_field) == ("Pressure", "WATER CONDITIONS", "STEAM CONDITIONS", "max")
    assert got[5].q_parameter is None and got[5].problems == ["parameter"]


def test_splitting(spark):
    q = asked(spark, "What is the inlet steam flow, outlet steam flow, outlet piping class, and material code of X?", "show me  a as well as b", "  ", "sand and gravel", "what is a and b and c")
    got = {}
    for r in questions.split_intents(q).orderBy("query_id", "intent_index").collect():
        got.setdefault(r.query_id, []).append(r.intent)
    assert got == {0: ["the inlet steam flow", "outlet steam flow", "outlet piping class", "material code of X"], 1: ["a", "b"], 3: ["sand", "gravel"], 4: ["a", "b", "c"]}


def test_structured_exact_and_hybrids(spark, recs, posted):
    q = questions.parse(asked(spark, "inlet line size of UNIT-1A", "material code of UNIT-4A", "turbine shaft of UNIT-1A"), recs).withColumn("terms", tx.search_tokens("query"))
    assert ids(retrieve.structured(recs, q.filter("q_parameter IS NOT NULL")))[0] == ["p01_r8_inlet"]
    assert ids(retrieve.exact(recs, q.filter("query_id = 1"))) == {1: ["p04_r58"]}
    for hybrid in (retrieve.hybrid_v1, retrieve.hybrid_v2):
        got = ids(hybrid(recs, posted, q), "hybrid_rank")
        assert got[0][0] == "p01_r8_inlet" and got[1][0] == "p04_r58" and 2 not in got
    assert ids(retrieve.hybrid_v2(recs, posted, q), "hybrid_rank")[0] == ["p01_r8_inlet"]
    assert {r.query_id for r in retrieve.abstained(q, retrieve.hybrid_v2(recs, posted, q)).collect()} == {2}


def test_multi_intent_hybrid(spark, recs, posted):
    q = asked(spark, "What is the inlet steam flow, outlet steam flow, outlet piping class, and material code of UNIT-2A?")
    assert ids(questions.hybrid_v3(recs, posted, q)) == {0: ["p02_r12_inlet", "p02_r12_outlet", "p02_r8_outlet", "p02_r58"]}


def test_bm25_matches_a_plain_loop(spark, recs, posted):
    import math
    from collections import Counter

    docs = {r.record_id: (r.ord, r.t) for r in recs.select("record_id", "ord", tx.search_tokens(retrieve.search_text(recs)).alias("t")).collect()}
    n, avg = len(docs), sum(len(t) for _, t in docs.values()) / len(docs)
    df = Counter(w for _, t in docs.values() for w in set(t))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else floor for w, v in raw.items()}
    q = asked(spark, "flow flow of unit-3a", "zzz qqq", "material unit-7a value", "").withColumn("terms", tx.search_tokens("query"))
    got = ids(inverted.bm25(posted, q, 10))
    for k, text in enumerate(["flow flow of unit-3a", "zzz qqq", "material unit-7a value"]):
        score = lambda t: sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in text.split())  # noqa: B023, E731
        assert got[k] == [d for d, _ in sorted(docs.items(), key=lambda x: (-round(score(x[1][1]), 9), x[1][0]))[:10]]
    assert 3 not in got


@pytest.fixture(scope="module")
def known(recs):
    entries = cut(catalog.value_entries(recs))
    values = cut(catalog.value_index(entries))
    return cut(catalog.schema_terms(recs)), cut(catalog.item_index(recs)), entries, cut(catalog.identifier_fields(values)), values


def test_adapter_modes(spark, recs, posted, known):
    terms, items, entries, fields, values = known
    q = asked(
        spark, "What is the inlet line size of UNIT-1A?", "which item has material code TC9735132581", "list the water conditions", "material code of any unit", "item of ZZZZ-999", "what colour is it", "press of UNIT-5A", "material code QX99887766 flow",
    )
    intents = questions.unknown_identifier(questions.understand(q, terms, items, entries, fields), fields)
    kinds = {r.query_id: r.intent_type for r in intents.collect()}
    assert kinds[0] == "entity_scoped_lookup" and kinds[2] == "section_lookup" and kinds[3] == "schema_lookup" and kinds[5] == "unresolved"
    hits, summary = questions.adapter_search(intents, recs, posted, values)
    got, mode = ids(hits), {r.query_id: (r.mode, r.abstained) for r in summary.collect()}
    assert got[0] == ["p01_r8_inlet"] and mode[0] == ("entity_scoped_lookup", False)
    assert set(got[1]) <= {r[0] for r in seven_pages() if r[0].startswith("p03")} and got[1]
    assert len(got[2]) == 14 and mode[2][0] == "section_lookup"
    assert len(got[3]) == 5 and mode[3][0] == "global_hybrid_v3"
    assert mode[4] == mode[5] == ("abstain", True) and mode[7] == ("abstain", True)
    assert got[6] == ["p05_r30"]


def test_alike_questions_are_answered_once(spark, recs, posted, known, monkeypatch):
    monkeypatch.setattr(questions, "CLASS_QUERIES", 2)
    terms, items, entries, fields, values = known
    texts = ["What is the inlet line size of UNIT-1A?", "tell the inlet line size of UNIT-1A", "list the water conditions", "material code of any unit", "what colour is it"]
    q = asked(spark, *[t for t in texts for _ in range(5)])
    intents = questions.unknown_identifier(questions.understand(q, terms, items, entries, fields), fields)
    own, answers = questions.adapter_answers(intents, recs, posted, values)
    lists = {}
    for r in sorted(answers.collect(), key=lambda r: r["rank"]):
        lists.setdefault(r.class_id, []).append(r.record_id)
    assert sorted(len(v) for v in lists.values()) == [1, 5, 14]  # three lists for twenty questions that have answers
    every = {}
    for r in sorted(questions.of_classes(own, answers, "left").collect(), key=lambda r: r["rank"] or 0):
        every.setdefault(r.query_id, []).append(r.record_id)
    assert len(every) == 25 and all(every[k] == lists.get(r.class_id, [None]) for k, r in {r.query_id: r for r in own.collect()}.items())
    assert every[0] == every[9] == ["p01_r8_inlet"] and every[24] == [None]


def test_plans_of_the_adapter_hold_few_tables(spark, recs, posted, known, monkeypatch):
    leaves = lambda df: df._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    terms, items, entries, fields, values = known
    q = asked(spark, "What is the inlet line size of UNIT-1A?", "list the water conditions", "material code of any unit")
    intents = cut(questions.unknown_identifier(questions.understand(q, terms, items, entries, fields), fields))
    written = {}
    monkeypatch.setattr(questions, "cut", lambda df, name="cut": (written.setdefault(name, []).append(leaves(df)), cut(df, name))[1])
    questions.adapter_answers(intents, recs, posted, values)
    assert max(map(max, written.values())) <= 12, written
    assert max(written["listed"]) <= 3, written  # a table of pairs for each mode


def test_context_prompt_and_answers(spark, recs, posted, known):
    terms, items, entries, fields, values = known
    q = asked(spark, "What is the inlet line size of UNIT-1A?", "what colour is it")
    intents = questions.unknown_identifier(questions.understand(q, terms, items, entries, fields), fields)
    hits, summary = questions.adapter_search(intents, recs, posted, values)
    found, lost = retrieve.resolve(hits, recs)
    assert lost.count() == 0
    made = context.build_context(found, "Sheet")
    (row,) = made.collect()
    assert row.context_text.split("\n")[:5] == ["Document: Sheet", "Page: 1", "Table: t", "Row: 8", "Item: UNIT-1A"] and "Class: A1A" in row.context_text
    user = {r.query_id: r.user for r in context.prompts(q, made).collect()}
    assert user[0].startswith("Context:\n\nDocument: Sheet") and "NO RETRIEVED RECORDS." in user[1] and user[1].endswith("Answer using only the context above.")
    said = {r.query_id: (r.answer, r.llm_used) for r in context.answers(summary, made, lambda s, u: f"{len(s) > 9} {u[:8]}").collect()}
    assert said == {0: ("True Context:", True), 1: (context.NOT_FOUND, False)}
    cases = spark.createDataFrame([(0, "section_lookup", ["p01_r8_inlet"], 2, 1, False, ["a1a"]), (1, "abstain", None, None, None, True, ["nowhere"])], "query_id int, expected_mode string, expected_ids array<string>, expected_count int, min_count int, expected_empty boolean, expected_contains array<string>")
    assert {(r.query_id, r.check) for r in context.context_violations(made, hits, cases).collect()} == {(0, "mode"), (0, "count"), (1, "contains")}
    assert "Record 1:\nRecord ID: p01_r8_inlet\nPage: 1" in found.select(context.prompt_record(found).alias("t")).first().t


def test_metrics_and_edges(spark):
    golden = spark.createDataFrame([(1, "a", ["x", "y"]), (2, "a", []), (3, "b", ["z"]), (4, "b", ["q"])], "query_id int, category string, expected array<string>")
    hits = spark.createDataFrame([(1, "n", 1), (1, "y", 2), (1, "y", 3), (3, "z", 1)], "query_id int, record_id string, rank int")
    got = {r.query_id: r for r in evaluate.metrics(golden, hits).collect()}
    assert (got[1].reciprocal_rank, got[1].hit_at_1, got[1].hit_at_3, got[1].precision, got[1].recall, got[1].exact_match) == (0.5, 0.0, 1.0, 0.5, 0.5, 0.0)
    assert (got[2].reciprocal_rank, got[2].recall, got[3].exact_match, got[4].recall) == (0.0, 0.0, 1.0, 0.0)
    assert {r.query_id: r.recall for r in evaluate.metrics(golden, hits, empty="match").collect()}[2] == 1.0
    assert {r.query_id: r.recall for r in evaluate.metrics(golden, hits, empty="null").collect()}[2] is None
    means = {r.category: (r.queries, r.recall) for r in evaluate.by_category(evaluate.metrics(golden, hits), ["recall"]).collect()}
    assert means == {"a": (2, 0.25), "b": (2, 0.5), "ALL": (4, 0.375)}
    cover = {r.query_id: (r.coverage, r.full_success, r.missing, r.unexpected) for r in evaluate.multi_intent_coverage(golden, hits).collect()}
    assert cover[1] == (0.5, False, ["x"], ["n"]) and cover[3] == (1.0, True, [], [])
    summary = spark.createDataFrame([(2, True, 0)], "query_id int, abstained boolean, records int")
    assert [r.passed for r in evaluate.negative_passes(golden, summary).collect()] == [True]
    intents = spark.createDataFrame([(1, 0), (1, 1)], "query_id int, intent_index int")
    parts = spark.createDataFrame([(1, 0, "x", 1), (1, 1, "n", 1), (1, 1, "y", 2)], "query_id int, intent_index int, record_id string, rank int")
    assert [evaluate.full_query_hit(golden, intents, parts, k).first()[1] for k in (1, 2)] == [False, True]


def test_more_than_ten_thousand_short_terms_all_match(spark):
    own = [chr(0x4E00 + k // 110) + chr(0x5E00 + k % 110) for k in range(12_000)]
    terms = spark.createDataFrame([(t, t) for t in [*own, "z"]], "value string, norm string")
    queries = spark.createDataFrame([(k, f"a {t} b") for k, t in enumerate(own)] + [(-1, "z"), (-2, ""), (-3, "a"), (-4, None)], "query_id long, q string")
    got = {r.query_id: r.hit for r in with_best(queries, questions.names_of(terms, "x"), "q", {"x": "hit"}).collect()}
    assert got == dict(enumerate(own)) | {-1: "z", -2: None, -3: None, -4: None}


def schema_frame(spark, rows):
    columns = "record_id string, ord long, page int, table_id string, row_number int, item string, section string, subsection string, parameter string, sub_parameter string, sub_sub_parameter string, side string, values map<string,string>, values_json map<string,string>"
    made = [(f"r{k}", k, 1, "t", k, None, section, subsection, parameter, child, None, None, {"value": "1"}, {"value": "1"}) for k, (parameter, child, section, subsection) in enumerate(rows)]
    return cut(spark.createDataFrame(made, columns))


def understood(spark, recs, *texts):
    none = spark.createDataFrame([], "norm string, parameter string")
    found = questions.understand(asked(spark, *texts), cut(catalog.schema_terms(recs)), none.select("norm"), none, none.select("parameter"))
    return {r.query_id: (r.parameter, r.sub_parameter, r.section) for r in found.collect()}


def test_equal_terms_go_to_the_first_and_children_to_the_parent_asked_for(spark):
    own = schema_frame(spark, [("Gamma Two", None, None, None), ("Alpha One", None, None, None), ("Aaa Type", "Range", "BIG HALL", None), ("Zzz Type", "Range", None, None), ("Other", "Lower Range", None, None)])
    got = understood(spark, own, "alpha one gamma two", "aaa type range", "zzz type range", "range", "alpha one lower range", "aaa-type of big/hall", "lower - range")
    assert got[0][0] == "Alpha One"
    assert got[1][:2] == ("Aaa Type", "Range") and got[2][:2] == ("Zzz Type", "Range")
    assert got[3][:2] == ("Zzz Type", "Range")  # the repair takes a child's last parent
    assert got[4][:2] == ("Alpha One", None)  # a parameter that is named keeps no child of another
    assert got[5] == ("Aaa Type", None, "BIG HALL") and got[6][:2] == ("Other", "Lower Range")


def test_fragments_have_sections_of_their_own(spark, recs):
    own = schema_frame(spark, [("Flow", None, "STEAM CONDITIONS", "INLET SIDE"), ("Flow", None, "HOT STEAM", "OUTLET AND INLET PART"), ("Flow", None, "COLD WATER", None)])
    q = asked(spark, "steam flow, flow of cold water and hot steam pressure, material code, inlet flow, flow at the inlet side")
    got = {r.intent_index: (r.q_section, r.q_subsection) for r in questions.parse_intents(questions.split_intents(q), own).collect()}
    assert got == {0: ("STEAM CONDITIONS", None), 1: ("COLD WATER", None), 2: ("HOT STEAM", None), 3: (None, None), 4: (None, "OUTLET AND INLET PART"), 5: (None, "OUTLET AND INLET PART")}


def test_questions_about_an_item_are_split(spark, recs, posted, known):
    terms, items, entries, fields, values = known
    q = asked(spark, "What is the inlet line size and material code of UNIT-2A?", "press of UNIT-5A")
    intents = questions.unknown_identifier(questions.understand(q, terms, items, entries, fields), fields)
    hits, _ = questions.adapter_search(intents, recs, posted, values, schema=(terms, items, entries, fields))
    assert ids(hits) == {0: ["p02_r8_inlet", "p02_r58"], 1: ["p05_r30"]}


def test_bm25_in_blocks_and_without_documents(spark, posted, monkeypatch):
    q = asked(spark, "flow of unit-3a", "material unit-7a", "zzz").withColumn("terms", tx.search_tokens("query"))
    whole = ids(inverted.bm25(posted, q, 7))
    bare = ids(inverted.bm25(posted, q, 7, fill=False))
    assert 2 not in bare and all(whole[k][: len(bare[k])] == bare[k][:7] for k in bare)
    monkeypatch.setattr(inverted, "QUERY_ENTRIES", 2)
    assert ids(inverted.bm25(posted, q, 7)) == whole
    assert inverted.bm25(posted.limit(0), q, 7).collect() == [] and inverted.bm25(posted, q.limit(0), 7).collect() == []


def test_metrics_of_hits_that_tell_their_relevance(spark):
    golden = spark.createDataFrame([(1, "a", ["x", "y", "z"]), (2, "a", []), (3, "b", ["q"])], "query_id int, category string, expected array<string>")
    hits = spark.createDataFrame([(1, "w", 1), (1, "x", 2), (1, "x", 4), (1, "y", 3), (2, "x", 1)], "query_id int, record_id string, rank int")
    wanted = golden.select("query_id", F.explode("expected").alias("record_id"), F.lit(True).alias("relevant"))
    told = hits.join(wanted, ["query_id", "record_id"], "left")
    counted = golden.select("query_id", "category", F.size("expected").alias("expected_count"))
    assert sorted(map(tuple, evaluate.metrics(counted, told).collect())) == sorted(map(tuple, evaluate.metrics(golden, hits).collect()))
