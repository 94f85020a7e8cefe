import json
import re

from pyspark.sql import functions as F

from tablewright.operators import layout, pages
from tablewright.plans import catalogue


def clean(t):
    t = re.sub(r"\n[ \t]+", "\n", re.sub(r"[ \t]+", " ", t.replace("\r\n", "\n").replace("\r", "\n")))
    return re.sub(r"\n{3,}", "\n\n", t).strip()


def pack(parts, sep, most):
    done, now = [], None
    for p in parts:
        if now is not None and len(now + sep + p) > most:
            done.append(now)
            now = None
        now = p if now is None else now + sep + p
    return done + ([now] if now is not None else [])


def brute_split(text, most):
    text = clean(text or "")
    if not text:
        return []
    if len(text) <= most:
        return [text]
    out = []
    for p in pack([clean(x) for x in re.split(r"\n\s*\n", text) if clean(x)], "\n\n", most):
        out += [p] if len(p) <= most else pack(re.split(r"(?<=[.!?])\s+", p), " ", most)
    return out


def test_split_text(spark):
    texts = [None, "", "short", "a. " * 40, "One two. Three!\n\nFour " + "x" * 50 + ". Five?\n \nSix.", "y" * 90, "p1\n\n\n\np2\n\n" + "q " * 30]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", layout.split_text("t", 40).alias("s")).collect()
    assert {r.k: r.s for r in rows} == {k: brute_split(t, 40) for k, t in enumerate(texts)}


def test_table_cells(spark):
    html = "<table><tr><th rowspan=2>A</th><th colspan='2'>B &amp; C</th></tr><tr><td>x</td><td colspan=bad> y </td></tr><tr></tr><tr><td></td></tr></table>"
    rows = spark.createDataFrame([(html,), (None,)], "html string")
    got = layout.table_cells(rows, "html").collect()
    assert [tuple(c) for c in got[0].cells] == [(0, 0, 2, 1, "A"), (0, 1, 1, 2, "B & C"), (1, 0, 1, 1, "x"), (1, 1, 1, 1, "y"), (3, 0, 1, 1, "")]
    assert (got[0].row_count, got[0].column_count, got[1].cells, got[1].row_count) == (4, 3, [], 0)
    moved = layout.table_cells(rows, "html", expand_spans=True).first().cells
    assert [(c.row, c.column) for c in moved] == [(0, 0), (0, 1), (1, 1), (1, 2), (3, 0)]


def test_blocks_to_chunks(spark):
    table = "<table><tr><td>Size</td><td>6</td></tr><tr><td>Class</td><td>A2</td></tr></table>"
    parsed = {
        "extensions": {"docvortex_layout": {"pages": [{"page_idx": 0, "width_pt": 10.0, "height_pt": 20.0}]}},
        "pages": [
            {"page_idx": 0, "blocks": [
                {"type": "doc_title", "index": 0, "bbox": [0, 0, 1, 1], "content": "Manual"},
                {"type": "text", "index": 1, "bbox": [0, 0, 1, 1], "content": "1. General\nfirst line\nsecond line\n1.1 Scope\ninside"},
                {"type": "header", "index": 2, "bbox": ["x", 0, 1, 1], "content": "skip"},
                {"type": "table", "index": 3, "bbox": [0, 0, 1, 1], "content": [{"type": "table_caption", "content": "Cap"}, {"type": "table_body", "content": table, "image_path": "i.png"}]},
            ]},
            {"page_idx": 1, "blocks": [{"type": "text", "index": 0, "bbox": [0, 0, 1, 1], "content": [{"content": "more"}, {"content": "text"}]}, {"type": "text", "index": 1, "bbox": [0, 0, 1, 1], "content": "2. Next\nend"}]},
        ],
    }
    files = spark.createDataFrame([("d", json.dumps(parsed))], "path string, json string")
    blocks = layout.normalised_blocks(layout.document_blocks(files)).persist()
    assert {(r.page, r.block_index, r.problem) for r in layout.block_violations(blocks).collect()} == {(1, 2, "no box")}
    made = layout.chunks(blocks).orderBy("chunk_id").collect()
    assert [(r.content_type, r.content, r.section, r.subsection) for r in made] == [
        ("heading", "Manual", "Manual", None), ("heading", "1. General", "1. General", None), ("text", "first line\nsecond line", "1. General", None), ("heading", "1.1 Scope", "1. General", "1.1 Scope"), ("text", "inside", "1. General", "1.1 Scope"),
        ("table", "Size | 6\nClass | A2", "1. General", "1.1 Scope"), ("text", "more text", "1. General", "1.1 Scope"), ("heading", "2. Next", "2. Next", None), ("text", "end", "2. Next", None),
    ]
    assert made[0].chunk_id == "chunk_000000_page_1_block_0"
    assert {(r.page, r.block_index) for r in layout.term_hits(blocks, ["class"]).collect()} == {(1, 3)}


def test_page_rules(spark):
    base = {k: 0 for k in pages.METRICS} | {"text_density": 0.0, "image_coverage": 0.0}
    rows = [base | {"page_number": 1}, base | {"page_number": 2, "images": 1, "image_coverage": 0.95, "unique_images": 1}, base | {"page_number": 3, "characters": 3000, "blocks": 70, "horizontal_lines": 3, "vertical_lines": 3, "rectangles": 5, "drawings": 2000}]
    own = spark.createDataFrame([{k: (float(v) if k in ("text_density", "image_coverage") else int(v)) for k, v in r.items()} for r in rows])
    got = {r.page_number: r for r in pages.classify(own).collect()}
    assert [got[k].page_state for k in (1, 2, 3)] == ["EMPTY", "IMAGE_ONLY", "TEXT_ONLY"]
    assert got[2].image_signals == ["image_references_present", "full_page_image"] and got[2].routing_signals[:2] == ["requires_ocr", "contains_images"]
    assert got[3].strong_grid and got[3].review_reasons == ["strong_grid_evidence", "extreme_vector_complexity", "extreme_layout_density"]
    assert pages.page_violations(own).collect() == [] and pages.rederive(own, pages.classify(own)).collect() == []
    changed = pages.classify(own).withColumn("text_complexity", F.lit("HIGH"))
    assert {(r.page_number, r.field) for r in pages.rederive(own, changed).collect()} == {(1, "text_complexity"), (2, "text_complexity")}
    status = {r.page_number: r.overall_status for r in pages.reconcile(pages.classify(own), own.filter("page_number > 1")).collect()}
    assert status[1] == "CONTRADICTION" and status[3] == "REVIEW_REQUIRED"


def test_cuts_are_those_of_a_plain_loop(spark):
    import random

    rng = random.Random(3)
    lists = [["x" * rng.randrange(12) for _ in range(rng.randrange(30))] for _ in range(40)] + [[], ["y" * 99], ["", "", ""]]
    got = [r.s for r in spark.createDataFrame([(k, [t, []]) for k, t in enumerate(lists)], "k int, t array<array<string>>").repartition(3).select("k", layout.packed(F.col("t"), "--", 20).alias("s")).orderBy("k").collect()]
    for parts, (made, none) in zip(lists, got, strict=True):
        want = []
        for part in parts:
            if want and len(want[-1]) + 2 + len(part) <= 20:
                want[-1] += "--" + part
            else:
                want.append(part)
        assert made == want and none == []


def test_work_of_cuts_is_that_of_the_texts_made():
    import time

    import numpy as np

    began = time.time()
    assert len(layout._breaks(np.ones(2_000_000, np.int32), 1, 9_999)) == 401 and time.time() - began < 5
    assert layout._breaks(np.array([5, 5, 50, 1]), 1, 11) == [0, 2, 3, 4]


def test_hierarchy_of_a_long_document(spark):
    lines = spark.range(300_000).select(
        F.lit("d").alias("path"), F.lit(1).alias("page"), F.lit(0).alias("block_index"), F.lit(0).alias("body_index"), F.col("id").alias("line"),
        F.when(F.col("id") % 1000 == 0, 1).when(F.col("id") % 100 == 0, 2).alias("level"), F.col("id").cast("string").alias("text"),
    )
    got = layout.with_hierarchy(lines)
    same = lambda name, by: F.col(name).cast("long") == F.floor(F.col("line") / by) * by
    sub = F.when(F.col("line") % 1000 < 100, F.col("subsection").isNull()).otherwise(same("subsection", 100))
    assert got.filter(~same("section", 1000) | ~sub | F.col("clause").isNotNull()).isEmpty() and got.count() == 300_000


def test_contained_spans_are_counted_by_places(spark, monkeypatch):
    rows = [(k % 3, 5 * n + k, float(k % 7), float(k % 4), k % 7 + 1.0, k % 4 + 1.5) for n in range(4) for k in range(5)] + [(0, 99, None, 1.0, 2.0, 2.0)]
    rects = [(n % 3, n % 25, float(n % 5), 0.0, n % 5 + 4.0, 4.0 + n % 2) for n in range(30)]
    spans = spark.createDataFrame(rows, "page_number long, span_id long, x0 double, y0 double, x1 double, y1 double")
    boxes = spark.createDataFrame(rects, "page_number long, rect_id long, x0 double, y0 double, x1 double, y1 double")
    want = {}
    for p, _, x0, y0, x1, y1 in rows:
        for q, r, a, b, c, d in rects:
            if x0 is not None and p == q and x0 >= a and y0 >= b and x1 <= c and y1 <= d:
                want[r] = want.get(r, 0) + 1
    made, pairs = [], pages.contained_spans
    monkeypatch.setattr(pages, "contained_spans", lambda *a: made.append((a[0].count(), pairs(*a).count())) or pairs(*a))
    assert {r.rect_id: r.spans for r in pages.contained_counts(spans, boxes).collect()} == want
    assert made[0][0] == 6 and made[0][1] <= sum(want.values()) // 4  # pairs of places, not of rows


def test_chunks_of_a_table_are_those_of_the_expression_and_texts_are_cleaned_once(spark):
    texts = [None, "", "  a\u00a0 b\r\n c ", "One two. Three! " * 9, "para one\n\n\x0bpara two \n \n" + "Long sentence here. " * 6 + "\n\nend", "\n\n".join(["x" * 30] * 5)]
    own = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    want = [r.c for r in own.select("k", layout.split_text("t", 40).alias("c")).orderBy("k").collect()]
    assert [r.c for r in layout.with_chunks(own, "t", "c", 40).orderBy("k").collect()] == want and len(want[4]) > 3
    plan = catalogue.QUERIES["chunk_pack"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1
