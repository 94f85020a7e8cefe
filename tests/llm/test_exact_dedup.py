import hashlib

import pytest

from tablewright.llm.exact_dedup import exact_dedup

SCHEMA = "doc_id long, text string, _id string, _run string, kept string"


def brute(rows, best):
    groups = {}
    for doc, text in rows:
        groups.setdefault(text or "", []).append(doc)
    out = []
    for doc, text in rows:
        ids = groups[text or ""]
        keep = best(ids)
        out.append((doc, keep, len(ids), doc == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("keep,best", [("max", max), ("min", min)])
@pytest.mark.parametrize("runs,fan_in", [(256, 16), (5, 2), (1, 16)])
def test_groups_match_brute_force(spark, keep, best, runs, fan_in):
    rows = [(i, f"t{i % 7}" if i < 300 else "hot") for i in range(900)] + [(1000, None), (1001, ""), (1002, "é " * 20000), (1003, "T0"), (1003, "T0")]
    docs = spark.createDataFrame([(a, b, "x", None, None) for a, b in rows], SCHEMA).repartition(6)
    got = exact_dedup(docs, keep=keep, runs=runs, fan_in=fan_in)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect())) == brute(rows, best)


def test_empty_table_and_null_ids(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = exact_dedup(spark.createDataFrame([(None, "a"), (4, "a"), (None, "b")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.kept) for r in rows) == [(0, 0, True), (0, 4, False), (4, 4, True)]
