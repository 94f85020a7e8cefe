from pyspark.sql import functions as F

from tablewright.operators import page_rules

PAGES = (
    "document string, pos long, page_number long, page_state string, orientation string, characters long, words long, blocks long, spans long, listed_blocks long, listed_spans long,"
    " images long, unique_images long, image_coverage double, drawings long"
)


def page(document, number, pos=None, **other):
    own = {"page_state": "MIXED_TEXT_IMAGE", "orientation": "portrait", "characters": 5, "words": 1, "blocks": 2, "spans": 3, "listed_blocks": 2, "listed_spans": 3, "images": 1, "unique_images": 1, "image_coverage": 0.5, "drawings": 0} | other
    return (document, number if pos is None else pos, number, *own.values())


def frames(spark, pages, images=(), declared=()):
    return spark.createDataFrame(pages, PAGES), spark.createDataFrame(list(images), "document string, xref long"), spark.createDataFrame(list(declared), "document string, page_count long")


def issues(found):
    return sorted((r.document, r.page_number or 0, r.severity, r.code) for r in found.collect())


def test_sound_documents_have_no_issue(spark):
    own = frames(spark, [page("a", n) for n in (1, 2, 3)] + [page("b", 1)], [("a", 7), ("a", 7), ("b", 8)], [("a", 3), ("b", 1)])
    assert issues(page_rules.page_issues(*own)) == []
    got = {(r.document, r["name"]): r.value for r in page_rules.document_summaries(*own).collect()}
    assert got["a", "images_distinct"] == 1 and got["a", "images_total"] == 3 and got["a", "MIXED_TEXT_IMAGE"] == 3 and got["b", "page_count"] == 1


def test_every_code(spark):
    bad = [
        page("a", 1, page_state="EMPTY"), page("a", 2, unique_images=2), page("a", 3, image_coverage=1.5), page("a", 4, listed_blocks=9), page("a", 5, listed_spans=9), page("a", 6, drawings=-1),
        page("a", 8), page("a", 9, drawings=None, image_coverage=None),
    ]
    got = issues(page_rules.page_issues(*frames(spark, bad, [], [("a", 9), ("none", 2)])))
    assert got == sorted([
        ("a", 1, "CRITICAL", "PAGE_STATE_INCONSISTENT"), ("a", 2, "CRITICAL", "IMAGE_XREF_COUNT_INVALID"), ("a", 3, "WARNING", "IMAGE_COVERAGE_OUT_OF_RANGE"), ("a", 4, "CRITICAL", "TEXT_BLOCK_COUNT_MISMATCH"),
        ("a", 5, "CRITICAL", "TEXT_SPAN_COUNT_MISMATCH"), ("a", 6, "CRITICAL", "NEGATIVE_DRAWING_COUNT"), ("a", 9, "CRITICAL", "NEGATIVE_DRAWING_COUNT"), ("a", 9, "WARNING", "IMAGE_COVERAGE_OUT_OF_RANGE"),
        ("a", 0, "CRITICAL", "PAGE_COUNT_MISMATCH"), ("none", 0, "CRITICAL", "PAGE_COUNT_MISMATCH"), ("a", 0, "CRITICAL", "PAGE_NUMBER_SEQUENCE_INVALID"),
        ("a", 0, "CRITICAL", "SUMMARY_INVARIANT_FAILED"), ("a", 0, "CRITICAL", "SUMMARY_INVARIANT_FAILED"), ("a", 0, "CRITICAL", "SUMMARY_INVARIANT_FAILED"),
    ])


def test_breaks_are_counted_across_ranges(spark):
    number = F.when(F.col("id") % 10_000 == 5_000, None).otherwise(F.col("id") + 1)
    own = spark.range(100_000).select(F.lit("long").alias("document"), F.col("id").alias("pos"), number.alias("page_number"))
    own = own.unionByName(spark.createDataFrame([("late", 1, 2), ("late", 2, 3), ("good", 5, 1), ("good", 9, 2)], "document string, pos long, page_number long"))
    assert sorted(map(tuple, page_rules.sequence_breaks(own).collect())) == [("late", 1), ("long", 20)]
    assert page_rules.sequence_breaks(own.limit(0)).collect() == []
