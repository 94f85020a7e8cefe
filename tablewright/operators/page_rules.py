"""Document summaries in one pass of grouping sets, and the rules that measured pages must keep, with their codes and severities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.operators.pages import page_state
from tablewright.operators.scan import range_blocks
from tablewright.sources.tables import cut

FIGURES = ("characters", "words", "blocks", "spans")
WITH_TEXT = ("TEXT_ONLY", "MIXED_TEXT_IMAGE")
WITH_IMAGES = ("IMAGE_ONLY", "MIXED_TEXT_IMAGE")


def document_summaries(pages: DataFrame, images: DataFrame, declared: DataFrame) -> DataFrame:
    """(document, kind, name, value): all that is summed up of each document's pages.

    ``pages`` have ``document``, ``page_state``, ``orientation``, ``characters``, ``words``, ``blocks``, ``spans``, ``images``, ``image_coverage`` and ``drawings``; ``images`` have
    ``document`` and ``xref``, a row for each reference; ``declared`` has ``document`` and ``page_count``. Kinds are ``state`` and ``orientation`` (pages), ``figure``
    (totals, distinct image references, least, most, mean and median, the last two to four places) and ``invariant`` (1 if it holds).
    Pages and references are one table that passes once through grouping sets of state, orientation and neither; totals are held against the sums
    over states. A document without pages has no row.
    """
    metrics = (*FIGURES, "images", "image_coverage", "drawings")
    own = pages.select("document", "page_state", "orientation", *[F.col(m).cast("double").alias(m) for m in metrics], F.lit(None).cast("string").alias("xref"), F.lit(1).alias("page"))
    refs = images.filter("xref IS NOT NULL").select("document", F.col("xref").cast("string").alias("xref"), F.lit(0).alias("page"))
    both = own.unionByName(refs, allowMissingColumns=True)
    state_in = lambda names: F.count_if(F.coalesce(F.col("page_state").isin(*names), F.lit(False)) & (F.col("page") == 1))
    figures = {}
    for m in (*FIGURES, "image_coverage"):
        figures |= {f"{m}_mean": F.round(F.avg(m), 4), f"{m}_most": F.max(m)}
    for m in FIGURES:
        figures |= {f"{m}_least": F.min(m), f"{m}_median": F.round(F.median(m), 4)}
    figures |= {"images_total": F.sum("images"), "images_most": F.max("images"), "images_distinct": F.countDistinct("xref"), "drawings_total": F.sum("drawings"), "drawings_most": F.max("drawings")}
    figures |= {"pages_with_images": F.count_if(F.col("images") > 0), "pages": F.sum("page")}
    counted = both.groupingSets(
        [["document", F.col("page_state")], ["document", F.col("orientation")], ["document"]], F.col("document"), F.col("page_state"), F.col("orientation")
    ).agg(
        F.grouping_id().alias("_g"), F.sum("page").alias("_n"), F.count_if(F.col("characters") > 0).alias("_text"), state_in(WITH_TEXT).alias("_t"), state_in(WITH_IMAGES).alias("_i"),
        *[v.cast("double").alias(k) for k, v in figures.items()],
    )
    # the bits of the grouping number are set for the columns that are not grouped by
    state, orientation, whole = F.col("_g") == 1, F.col("_g") == 2, F.col("_g") == 3
    row = lambda kind, name, value: F.struct(F.lit(kind).alias("kind"), name.alias("name"), value.cast("double").alias("value"))
    counted = cut(counted.filter("_n > 0"), "summaries")
    by_state = counted.filter(state).groupBy("document").agg(F.sum("images_total").alias("_images"), F.sum("drawings_total").alias("_drawings"))
    out = counted.join(declared.select("document", "page_count"), "document", "left").join(by_state, "document", "left")
    holds = {
        "page_count": F.col("page_count") == F.col("_n"),
        "text_pages": F.col("_text") == F.col("_t"),
        "image_pages": F.col("pages_with_images") == F.col("_i"),
        "image_total": F.col("images_total").eqNullSafe(F.col("_images")),
        "drawing_total": F.col("drawings_total").eqNullSafe(F.col("_drawings")),
    }
    sums = [row("figure", F.lit(k), F.coalesce(F.col(k), F.lit(0.0))) for k in figures]
    rules = [row("invariant", F.lit(k), F.coalesce(v, F.lit(False)).cast("int")) for k, v in holds.items()]
    rows = F.when(state, F.array(row("state", F.col("page_state"), F.col("_n")))).when(orientation, F.array(row("orientation", F.col("orientation"), F.col("_n")))).when(whole, F.array(*sums, *rules))
    return out.select("document", F.explode(rows).alias("r")).select("document", "r.*")


def sequence_breaks(pages: DataFrame) -> DataFrame:
    """(document, breaks): documents whose pages, in the order of ``pos``, are not numbered 1, 2, 3 .., and at how many places.

    Pages are parted into ranges; within a range neighbours are compared, and of the ranges of a document the ends alone meet.
    """
    ranged = range_blocks(pages.select("document", "pos", F.col("page_number").cast("long").alias("number")), ["document"], ["pos"])
    inside = Window.partitionBy("document", "_block").orderBy("pos")
    steps = ranged.withColumn("_before", F.lag("number").over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    broken = ~F.col("_first") & ~F.col("number").eqNullSafe(F.col("_before") + 1)
    ends = steps.groupBy("document", "_block").agg(F.count_if(broken).alias("inner"), F.min_by("number", "pos").alias("begin"), F.max_by("number", "pos").alias("end"))
    across = Window.partitionBy("document").orderBy("_block")
    met = ends.withColumn("_ahead", F.lag("end").over(across)).withColumn("_n", F.row_number().over(across))
    wanted = F.when(F.col("_n") == 1, F.lit(1)).otherwise(F.col("_ahead") + 1)
    return met.groupBy("document").agg(F.sum(F.col("inner") + (~F.col("begin").eqNullSafe(wanted)).cast("int")).alias("breaks")).filter("breaks > 0")


def page_issues(pages: DataFrame, images: DataFrame, declared: DataFrame) -> DataFrame:
    """(document, page_number, severity, code, detail) of every broken rule; nothing is raised.

    Besides the columns of ``document_summaries``, ``pages`` have ``pos``, ``page_number``, ``unique_images``, ``listed_blocks`` and ``listed_spans`` (what is listed, where
    ``blocks`` and ``spans`` are what is counted). A null figure breaks the rules that it is part of. All codes are critical but that of the coverage.
    """
    no = F.lit(None).cast("string")
    broken = lambda c: ~F.coalesce(c, F.lit(False))
    state = page_state(F.col("characters"), F.col("images"))
    rules: list[tuple[str, Column, Column]] = [
        ("PAGE_STATE_INCONSISTENT", broken(F.col("page_state") == state), state),
        ("IMAGE_XREF_COUNT_INVALID", broken(F.col("unique_images") <= F.col("images")), no),
        ("IMAGE_COVERAGE_OUT_OF_RANGE", broken(F.col("image_coverage").between(0, 1 + 1e-9)), no),
        ("TEXT_BLOCK_COUNT_MISMATCH", broken(F.col("blocks") == F.col("listed_blocks")), no),
        ("TEXT_SPAN_COUNT_MISMATCH", broken(F.col("spans") == F.col("listed_spans")), no),
        ("NEGATIVE_DRAWING_COUNT", broken(F.col("drawings") >= 0), no),
    ]
    found = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(code).alias("code"), detail.alias("detail"))) for code, bad, detail in rules]))
    own = pages.select("document", "page_number", F.explode(found).alias("f")).select("document", "page_number", "f.*")
    whole = lambda rows, code, detail: rows.select("document", F.lit(None).cast("long").alias("page_number"), F.lit(code).alias("code"), detail.cast("string").alias("detail"))
    counts = declared.join(pages.groupBy("document").agg(F.count("*").alias("n")), "document", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    failed = document_summaries(pages, images, declared).filter("kind = 'invariant' AND value = 0")
    every = [
        own.withColumn("page_number", F.col("page_number").cast("long")),
        whole(counts.filter(broken(F.col("n") == F.col("page_count"))), "PAGE_COUNT_MISMATCH", F.col("n")),
        whole(sequence_breaks(pages), "PAGE_NUMBER_SEQUENCE_INVALID", F.col("breaks")),
        whole(failed, "SUMMARY_INVARIANT_FAILED", F.col("name")),
    ]
    severity = F.when(F.col("code") == "IMAGE_COVERAGE_OUT_OF_RANGE", "WARNING").otherwise("CRITICAL")
    return reduce(DataFrame.unionByName, every).select("document", "page_number", severity.alias("severity"), "code", "detail")
