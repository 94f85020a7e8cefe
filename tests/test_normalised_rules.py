import json

from tablewright.operators import normalised_rules as rules


def cell(row, column, rowspan=1, colspan=1, **other):
    return {"text": "t", "row": row, "column": column, "rowspan": rowspan, "colspan": colspan} | other


def document(*blocks, **other):
    pages = [{"page": 1, "blocks": list(blocks)}]
    return {"schema": {"name": rules.SCHEMA_NAME, "version": "1"}, "source": {}, "extraction": {}, "document": {"page_count": 1, "pages": pages}} | other


def table(rows, columns=3, count=None, **other):
    body = {"type": "table_body", "table": {"row_count": len(rows) if count is None else count, "column_count": columns, "rows": rows}}
    return {"type": "table", "page": 1, "bbox": [0], "parts": [body]} | other


def frame(spark, *docs):
    texts = [d if d is None or isinstance(d, str) else json.dumps(d) for d in docs]
    return spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "path string, json string").repartition(2)


def found(spark, *docs):
    return sorted((r.path, r.rule) for r in rules.violations(frame(spark, *docs)).collect())


def test_sound_documents_break_no_rule(spark):
    sound = document({"type": "text", "page": 1, "bbox": [1], "text": "{["}, table([[cell(0, 0, 2), cell(0, 1, 1, 2)], [cell(1, 1), cell(1, 2, 10**9)]]))
    assert found(spark, sound) == []


def test_roots_of_any_kind(spark):
    assert {r for p, r in found(spark, "[1]", None, "", "not json") if p == "0"} >= {"root_object"} and {p for p, r in found(spark, "[1]", None, "", "not json") if r == "root_object"} == {"0", "1", "2", "3"}
    assert found(spark, {"schema": {}}) == sorted(("0", r) for r in ("root_source", "root_extraction", "root_document", "schema_name", "schema_version"))
    assert found(spark, document(document=[]))[0] == ("0", "document_object") and ("0", "pages_list") in found(spark, document(document={"page_count": 1, "pages": {}}))


def test_cells(spark):
    bad = [[{"text": "t"}, cell(0, 2, 0), cell(0, 0, 1, "x"), 7, cell(0, 1, 1, 3)], "row", []]
    got = [r for _, r in found(spark, document(table(bad, count=9)))]
    want = ["cell_colspan", "cell_column", "cell_columns", "cell_object", "cell_row", "cell_rowspan", "colspan", "row_count", "row_list", "rowspan"]
    assert sorted(set(got)) == want


def test_overlaps_are_found_across_rows(spark):
    grid = [[cell(0, 0, 3), cell(0, 1)], [cell(1, 1)], [cell(2, 0), cell(2, 1, 5, 2), cell(2, 2)]]
    at = rules.levels(frame(spark, document(table(grid))))
    assert sorted((r.row, r.column) for r in rules.overlaps(at["cells"]).collect()) == [(2, 0), (2, 2)]


def test_statistics_and_empty_input(spark):
    own = frame(spark, document(table([[cell(0, 0, 2)], [cell(1, 1, 1, 2)]], parts=[{"type": "note"}]), table([[cell(0, 0, 2)], [cell(1, 1, 1, 2)]]), table([])))
    got = {r["name"]: r.n for r in rules.statistics(own).collect()}
    assert got == {"pages": 1, "blocks": 3, "type table": 3, "tables": 3, "empty_tables": 1, "table_rows": 2, "table_cells": 2, "rowspan_cells": 1, "colspan_cells": 1}
    assert rules.statistics(own.limit(0)).collect() == [] and rules.violations(own.limit(0)).collect() == []
