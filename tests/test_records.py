import json

import pytest
from pyspark.sql import functions as F

from tablewright.operators import catalog, records
from tablewright.sources import datasets

PAGES = [
    {
        "page": 1, "table_id": "t1", "title": "a", "equipment": "e", "row_count": 8, "notes": None,
        "rows": [
            {"no": 1, "parameter": "ITEM", "value": "VALVE-A1 "},
            {"no": 2, "type": "section_header", "parameter": "STEAM CONDITIONS"},
            {"no": 3, "type": "subsection_header", "parameter": "INLET STEAM"},
            {"no": 4, "parameter": "Line Size", "sub_parameter": "Piping Class", "inlet": {"value": '6"', "class": "A2A"}, "outlet": {"value": '8"', "class": ""}, "unit": "inch"},
            {"no": 5, "parameter": "Flow", "inlet": {"value": ""}, "outlet": {"min": 1.5, "max": 20}},
            {"no": 6, "type": "section_header", "parameter": None},
            {"no": 7, "parameter": "", "sub_parameter": None, "x": [], "y": {"z": " "}},
            {"no": 8, "parameter": "Material Code", "value": "TC9765132581", "list": ["p", "q"], "nested": {"a_b": "v", "n": None}, "zero": 0, "off": False},
        ],
    },
    {"page": 2, "table_id": None, "title": "b", "equipment": "e", "row_count": 2, "notes": "", "rows": [{"no": 1, "parameter": "item", "value": "FIRST"}, {"no": 2, "parameter": "Item", "value": "VALVE-B2"}]},
]


def dataset(**changes):
    return {"schema": {"name": datasets.DATASET_NAME, "version": "1"}, "dataset": {"dataset_name": "d", "document_name": "x", "page_count": 2, "total_rows": 10}, "pages": PAGES} | changes


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("f", json.dumps(dataset(), ensure_ascii=False))], "path string, json string")


@pytest.fixture(scope="module")
def built(files):
    return records.enrich(records.retrieval_text(records.build_records(datasets.dataset_rows(files)))).orderBy("ord").persist()


def test_records_fill_down_sides_and_scalars(built):
    rows = built.collect()
    assert [r.record_id for r in rows] == ["p01_r1", "p01_r4_inlet", "p01_r4_outlet", "p01_r5_outlet", "p01_r8", "p02_r1", "p02_r2"]
    assert [(r.section, r.subsection) for r in rows] == [(None, None), ("STEAM CONDITIONS", "INLET STEAM"), ("STEAM CONDITIONS", "INLET STEAM"), ("STEAM CONDITIONS", "INLET STEAM"), (None, None), (None, None), (None, None)]
    assert rows[1]["values"] == {"value": '6"', "class": "A2A"} and rows[2]["values"] == {"value": '8"', "class": ""}
    keys = {r.record_id: r.k for r in built.select("record_id", F.map_keys("values").alias("k")).collect()}
    assert keys["p01_r8"] == ["value", "list", "nested", "zero", "off"] and rows[5].table_id == "instrument_specification_page_2"


def test_retrieval_text(built):
    text = {r.record_id: r.retrieval_text for r in built.collect()}
    assert text["p01_r4_inlet"] == 'Section: STEAM CONDITIONS. Subsection: INLET STEAM. Parameter: Line Size. Sub-parameter: Piping Class. Side: Inlet. Value: 6". Class: A2A.'
    assert text["p01_r8"] == "Parameter: Material Code. Value: TC9765132581. List: p, q. Nested: A B: v. Zero: 0. Off: false."


def test_last_item_of_a_page_wins_and_enrichment(built):
    items = {r.record_id: (r.item, r.item_normalized) for r in built.collect()}
    assert items["p01_r8"] == ("VALVE-A1", "VALVE-A1") and items["p02_r1"][0] == "VALVE-B2"
    assert {r.field for r in records.enrich_violations(built.withColumn("item", F.lit(" "))).collect()} == {"item"}
    counts = records.enrich_statistics(built).first()
    assert (counts.pages, counts.records, counts.with_side, counts.with_section) == (2, 7, 3, 3)


def test_build_counters(files, built):
    rows = datasets.dataset_rows(files)
    got = records.build_statistics(rows, built).first()
    assert (got.pages, got.tables, got.source_rows, got.header_rows, got.blank_rows, got.side_records, got.scalar_records, got.records) == (2, 2, 10, 3, 1, 3, 4, 7)
    assert records.text_statistics(built).first().records == 7
    assert datasets.dataset_statistics(files).first()[1:] == (2, 10, 2) or datasets.dataset_statistics(files).first().rows == 10
    assert datasets.dataset_page(files, 2).count() == 1 and datasets.dataset_page(files, 9).count() == 0


@pytest.mark.parametrize(
    "rule,change",
    [
        ("schema_name", {"schema": {"name": "other"}}), ("schema_object", {"schema": "x"}), ("pages_list", {"pages": {}}), ("pages_empty", {"pages": []}), ("page_count", {"dataset": {"page_count": 3}}), ("total_rows", {"dataset": {"total_rows": 3}}),
        ("row_count", {"pages": [PAGES[0] | {"row_count": 4}]}), ("page_keys", {"pages": [{"page": 1, "rows": []}]}), ("row_keys", {"pages": [PAGES[1] | {"rows": [{"no": 1}]}]}), ("row_object", {"pages": [PAGES[1] | {"rows": [1]}]}), ("rows_list", {"pages": [PAGES[1] | {"rows": 5}]}),
    ],
)
def test_each_rule_is_reported(spark, rule, change):
    bad = spark.createDataFrame([("f", json.dumps(dataset(**change)))], "path string, json string")
    assert rule in {r.rule for r in datasets.dataset_violations(bad).collect()}


def test_valid_dataset_has_no_violations_and_broken_roots_do(spark, files):
    assert datasets.dataset_violations(files).collect() == []
    bad = spark.createDataFrame([("f", "[1]"), ("g", json.dumps({"pages": []}))], "path string, json string")
    assert {("f", "root_object"), ("g", "root_keys")} <= {(r.path, r.rule) for r in datasets.dataset_violations(bad).collect()}


def test_catalogue_and_index(built):
    have = {(r.kind, r.value) for r in catalog.vocabulary(built).collect()}
    assert {("section", "STEAM CONDITIONS"), ("parameter", "Flow"), ("side", "outlet"), ("value_field", "max"), ("item", "VALVE-B2")} <= have
    assert ("parameter_hierarchy", "Line Size", "Piping Class") in {tuple(r) for r in catalog.hierarchy(built).collect()}
    assert {r.kind: r.n for r in catalog.catalogue_counts(built).collect()}["record"] == 7
    assert catalog.catalogue_violations(built).collect() == [] and len(catalog.catalogue_violations(built.limit(0)).collect()) == 2
    items = {r.norm: r for r in catalog.item_index(built).collect()}
    assert items["valve-a1"].occurrences == 5 and items["valve-a1"].record_ids[0] == "p01_r1"
    entries = catalog.value_entries(built)
    index = catalog.value_index(entries)
    got = {(r.parameter, r.field, r.norm) for r in index.collect()}
    assert ("Material Code", "value", "tc9765132581") in got and not any(f in ("min", "zero", "list") for _, f, _ in got)
    assert {r.parameter for r in catalog.identifier_fields(index).collect()} == {"Material Code", "ITEM", "item", "Item"} & {r.parameter for r in index.collect() if len(r.value) >= 6 and any(c.isdigit() for c in r.value)}
    assert {r.norm for r in catalog.value_lookup(index).collect()} == {n for _, _, n in got}


def test_record_files_with_any_root(spark, tmp_path):
    row = {"record_id": "a", "page": 1, "parameter": "P", "values": {"b": "x", "a": 2}}
    for k, root in enumerate(({"records": [row]}, {"items": [row]}, [row])):
        (tmp_path / f"{k}.json").write_text(json.dumps(root))
    rows = datasets.read_records(spark, f"file://{tmp_path}/*.json").collect()
    assert [r.record_id for r in rows] == ["a"] * 3 and rows[0]["values"] == {"b": "x", "a": "2"}
    datasets.write_records(spark.createDataFrame([("a",)], "record_id string"), f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 1
    (tmp_path / "page_003_x.json").write_text("{}")
    found = datasets.read_by_page(spark, f"file://{tmp_path}/page_*.json", spark.createDataFrame([(3,), (4,)], "page_number int"))
    assert {r.page_number: r.found for r in found.collect()} == {3: True, 4: False}
    assert len(datasets.read_binary_hashes(spark, f"file://{tmp_path}/0.json").first().sha256) == 64


def test_emptiness_of_deep_objects(spark):
    deep = lambda leaf, n=6: "".join(f'{{"k{k}": ' for k in range(n)) + leaf + "}" * n
    empty = [None, "null", '""', '" \\n "', "[ ]", "{}", deep("null"), deep('""'), deep('{"a": [], "b": "\\t"}'), '{"a b": null, "": {"x": ""}}']
    full = ["0", "false", '"x"', "[null]", deep("0"), deep('"a\\" "'), deep("[{}]"), '{"a": null, "b": {"c": "null"}}', '{"null": "1"}']
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(empty + full)], "k int, t string")
    got = {r.k: r.e for r in rows.select("k", records.json_empty(F.col("t")).alias("e")).collect()}
    assert [got[k] for k in range(len(got))] == [True] * len(empty) + [False] * len(full)


def test_counters_of_what_is_written_equal_a_scan(spark, tmp_path):
    rows = [("s", None, "p", None, None, "inlet", {"a": "1"}), (None, None, "p", "q", None, None, {}), ("", None, None, None, None, None, None)]
    own = spark.createDataFrame(rows * 3, "section string, subsection string, parameter string, sub_parameter string, sub_sub_parameter string, side string, values_json map<string,string>").repartition(3)
    made = records.retrieval_text(own)
    found = datasets.write_records(made, f"file://{tmp_path}/out", counters=records.counters())
    assert found == made.agg(*[c.alias(n) for n, c in records.counters().items()]).first().asDict() and found["records"] == 9 and found["side_records"] == 3
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 9 and datasets.write_records(made, f"file://{tmp_path}/out") == {}
    none = datasets.write_records(made.limit(0), f"file://{tmp_path}/none", counters=records.counters())
    assert none["records"] == none["characters"] == 0
