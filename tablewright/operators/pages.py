"""Page analytics: states, complexity classes, signals, summaries and reconciliation by rules over page metrics.

Pages are flat rows: ``page_number``, ``characters``, ``words``, ``lines``, ``blocks``, ``spans``, ``text_density``, ``images``, ``unique_images``,
``image_coverage``, ``drawings``, ``rectangles``, ``curves``, ``horizontal_lines``, ``vertical_lines``, ``width``, ``height``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions import text as tx

# Upper bounds (exclusive) of the classes before the last, and the thresholds of signals.
CLASSES = {
    "text_complexity": ("characters", (("LOW", 1000), ("MEDIUM", 3000), ("HIGH", None))),
    "layout_complexity": ("blocks", (("SIMPLE", 15), ("MODERATE", 40), ("COMPLEX", 70), ("EXTREME", None))),
    "vector_complexity": ("drawings", (("LOW", 100), ("MEDIUM", 500), ("HIGH", 2000), ("EXTREME", None))),
    "rectangle_complexity": ("rectangles", (("LOW", 5), ("MEDIUM", 25), ("HIGH", 75), ("EXTREME", None))),
    "curve_complexity": ("curves", (("LOW", 100), ("MEDIUM", 1000), ("HIGH", 10000), ("EXTREME", None))),
    "image_complexity": ("images", (("NONE", 1), ("LOW", 3), ("MEDIUM", 5), ("HIGH", None))),
}
LOW_DENSITY, HIGH_DENSITY = 0.01, 0.05
LARGE_IMAGE, FULL_IMAGE = 0.50, 0.90
STATES = ("EMPTY", "IMAGE_ONLY", "MIXED_TEXT_IMAGE", "TEXT_ONLY")
METRICS = ("characters", "words", "lines", "blocks", "spans", "text_density", "images", "unique_images", "image_coverage", "drawings", "rectangles", "curves", "horizontal_lines", "vertical_lines")


def page_state(characters: Column, images: Column) -> Column:
    return F.when((characters == 0) & (images == 0), "EMPTY").when(characters == 0, "IMAGE_ONLY").when(images > 0, "MIXED_TEXT_IMAGE").otherwise("TEXT_ONLY")


def complexity(name: str) -> Column:
    column, steps = CLASSES[name]
    out = None
    for label, bound in steps:
        if bound is None:
            return out.otherwise(label)
        out = F.when(F.col(column) < bound, label) if out is None else out.when(F.col(column) < bound, label)


def tags(rules: list[tuple[Column, str]]) -> Column:
    """The tags whose rule holds, in order, each once."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(rule, F.lit(tag)) for rule, tag in rules])))


def grids(pages: DataFrame) -> DataFrame:
    """``possible_grid``, ``strong_grid`` and the evidence behind them."""
    h, v, r = F.col("horizontal_lines"), F.col("vertical_lines"), F.col("rectangles")
    return pages.withColumns({"possible_grid": (h >= 2) & (v >= 2), "strong_grid": (h >= 3) & (v >= 2) & (r >= 5), "grid_evidence": tags([(h >= 2, "multiple_horizontal_lines"), (v >= 2, "multiple_vertical_lines"), (r >= 5, "multiple_rectangles")])})


def classify(pages: DataFrame) -> DataFrame:
    """State, six classes, grid evidence and six lists of signals for each page; ``review_required`` if there is a reason."""
    c = F.col
    own = grids(pages).withColumn("page_state", page_state(c("characters"), c("images"))).withColumns({k: complexity(k) for k in CLASSES})
    dense, extreme = c("blocks") >= 40, c("blocks") >= 70
    mixed, some = c("page_state") == "MIXED_TEXT_IMAGE", c("images") > 0
    full, large = some & (c("image_coverage") >= FULL_IMAGE), some & (c("image_coverage") >= LARGE_IMAGE)
    text = [
        (c("characters") == 0, "no_native_text"), ((c("characters") > 0) & (c("characters") < 1000), "low_text_content"), (c("characters") >= 3000, "high_text_content"), (dense, "dense_text_blocks"), (extreme, "extreme_text_block_density"),
        (c("lines") >= 100, "many_text_lines"), (c("spans") >= 100, "many_text_spans"), (c("text_density") >= HIGH_DENSITY, "high_text_density"), ((c("text_density") <= LOW_DENSITY) & (c("characters") > 0), "low_text_density"),
    ]
    vector = [
        (c("drawings") >= 500, "high_vector_complexity"), (c("drawings") >= 2000, "extreme_vector_complexity"), (c("rectangles") >= 25, "many_rectangles"), (c("rectangles") >= 75, "extreme_rectangle_density"),
        (c("curves") >= 1000, "many_curves"), (c("curves") >= 10000, "extreme_curve_density"), (c("horizontal_lines") >= 3, "multiple_horizontal_lines"), (c("vertical_lines") >= 2, "multiple_vertical_lines"),
    ]
    image = [(some & (c("unique_images") > 0), "image_references_present"), (full, "full_page_image"), (large & ~full, "large_image"), (some & ~large, "embedded_image")]
    layout = [(dense, "dense_layout"), (extreme, "extreme_layout_density"), (mixed, "mixed_content_layout"), (some, "contains_images"), (c("possible_grid"), "grid_evidence"), (c("strong_grid"), "strong_grid_evidence")]
    review = [
        (c("strong_grid"), "strong_grid_evidence"), (c("drawings") >= 2000, "extreme_vector_complexity"), ((c("characters") < 1000) & (c("drawings") >= 500), "low_text_with_complex_geometry"), (extreme, "extreme_layout_density"),
        (c("image_coverage") >= FULL_IMAGE, "full_page_image"), (mixed & (c("image_coverage") >= LARGE_IMAGE), "large_image_with_native_text"),
    ]
    routing = [
        (c("page_state") == "IMAGE_ONLY", "requires_ocr"), (mixed, "mixed_content"), (some, "contains_images"), (full, "full_page_image"), (large, "large_image"), (c("characters") < 1000, "low_text_content"), (dense, "dense_layout"), (extreme, "extreme_layout_density"),
        (c("drawings") >= 500, "high_vector_complexity"), (c("drawings") >= 2000, "extreme_vector_complexity"), (c("possible_grid"), "grid_evidence"), (c("strong_grid"), "strong_grid_evidence"), (mixed | c("possible_grid") | dense, "requires_layout_analysis"),
    ]
    named = {"text_signals": text, "vector_signals": vector, "image_signals": image, "layout_signals": layout, "review_reasons": review, "routing_signals": routing}
    return own.withColumns({k: tags(v) for k, v in named.items()}).withColumn("review_required", F.size("review_reasons") > 0)


def class_summary(classified: DataFrame) -> DataFrame:
    """(kind, value, n): pages of each state, class and signal."""
    plain = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("page_state", *CLASSES)])
    named = lambda k: F.transform(k, lambda s: F.struct(F.lit(k).alias("kind"), s.alias("value")))
    lists = [named(k) for k in ("text_signals", "vector_signals", "image_signals", "layout_signals", "review_reasons", "routing_signals")]
    return classified.select(F.explode(F.concat(plain, *lists)).alias("s")).groupBy("s.kind", "s.value").agg(F.count("*").alias("n"))


def page_lists(classified: DataFrame, column: str) -> DataFrame:
    """The page numbers of each class, in order."""
    return classified.groupBy(column).agg(F.array_sort(F.collect_list("page_number")).alias("pages"))


def document_summary(pages: DataFrame, names: tuple[str, ...] = ("characters", "words", "images", "drawings")) -> DataFrame:
    """(metric, least, most, mean, median): figures over all pages, rounded to four places."""
    long = pages.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("v")) for n in names])).alias("m")).select("m.*")
    return long.groupBy("metric").agg(F.coalesce(F.min("v"), F.lit(0.0)).alias("least"), F.coalesce(F.max("v"), F.lit(0.0)).alias("most"), F.coalesce(F.round(F.avg("v"), 4), F.lit(0.0)).alias("mean"), F.coalesce(F.round(F.median("v"), 4), F.lit(0.0)).alias("median"))


def page_violations(pages: DataFrame) -> DataFrame:
    """(page_number, field, problem): missing or negative metrics, unknown states, pages numbered twice."""
    problems = [F.when(F.col(c).isNull(), F.struct(F.lit(c).alias("field"), F.lit("missing").alias("problem"))).when(F.col(c) < 0, F.struct(F.lit(c).alias("field"), F.lit("negative").alias("problem"))) for c in METRICS if c in pages.columns]
    if "page_state" in pages.columns:
        problems.append(F.when(~F.coalesce(F.col("page_state").isin(*STATES), F.lit(False)), F.struct(F.lit("page_state").alias("field"), F.lit("unknown").alias("problem"))))
        problems.append(F.when(F.col("page_state") != page_state(F.col("characters"), F.col("images")), F.struct(F.lit("page_state").alias("field"), F.lit("inconsistent").alias("problem"))))
    own = pages.select("page_number", F.explode(F.array_compact(F.array(*problems))).alias("p")).select("page_number", "p.*")
    twice = pages.groupBy("page_number").count().filter("count > 1").select("page_number", F.lit("page_number").alias("field"), F.lit("duplicate").alias("problem"))
    return own.unionByName(twice)


EXPECTED_SIGNALS = ("requires_ocr", "contains_images", "high_vector_complexity", "extreme_vector_complexity", "low_text_content", "dense_layout", "extreme_layout_density", "requires_layout_analysis")


def rederive(pages: DataFrame, classified: DataFrame) -> DataFrame:
    """(page_number, field, expected, actual) where a class or one of EXPECTED_SIGNALS of ``classified`` differs from what ``pages`` gives; a page without class is an issue."""
    signal = lambda s: F.array_contains("routing_signals", s).cast("string")
    fields = {k: F.col(k) for k in ("page_state", *CLASSES)} | {s: signal(s) for s in EXPECTED_SIGNALS}
    fresh = classify(pages).select("page_number", *[v.alias(f"e_{k}") for k, v in fields.items()])
    both = fresh.join(classified.select("page_number", *[v.alias(k) for k, v in fields.items()], F.lit(1).alias("_there")), "page_number", "left")
    differs = [F.when(~F.col(f"e_{k}").eqNullSafe(F.col(k)), F.struct(F.lit(k).alias("field"), F.col(f"e_{k}").alias("expected"), F.col(k).alias("actual"))) for k in fields]
    missing = F.array(F.struct(F.lit("page").alias("field"), F.lit("present").alias("expected"), F.lit("missing").alias("actual")))
    return both.select("page_number", F.explode(F.when(F.col("_there").isNull(), missing).otherwise(F.array_compact(F.array(*differs)))).alias("d")).select("page_number", "d.*")


BLOCK_TOLERANCE = 10
SEVERITY = ("CONSISTENT", "WARNING", "REVIEW_REQUIRED", "CONTRADICTION")


def reconcile(classified: DataFrame, investigated: DataFrame) -> DataFrame:
    """One row per classified page with the status of each check against an independent investigation, and the worst.

    Page type, characters, images, drawings and the classes of vectors and images contradict when they differ; words and blocks warn; an investigation that sees a grid asks for
    review, signals without physical ground warn. A page without investigation is a contradiction.
    """
    names = ("characters", "words", "blocks", "images", "drawings", "horizontal_lines", "vertical_lines", "rectangles")
    other = investigated.select("page_number", *[F.col(c).alias(f"i_{c}") for c in names], F.lit(1).alias("_there"))
    both = classified.join(other, "page_number", "left")
    c = F.col
    level = lambda bad, status: F.when(bad, SEVERITY.index(status)).otherwise(0)
    ground = tags([(c("i_images") > 0, "contains_images"), (c("i_characters") < 1000, "low_text_content"), (c("i_drawings") >= 500, "high_vector_complexity"), (c("i_drawings") >= 2000, "extreme_vector_complexity"), (c("i_blocks") >= 40, "dense_layout"), (c("i_blocks") >= 70, "extreme_layout_density")])
    grid = (c("i_horizontal_lines") >= 3) & (c("i_vertical_lines") >= 3)
    image_class = F.when(c("i_images") == 0, "NONE").when(c("i_images") <= 3, "LOW").when(c("i_images") <= 5, "MEDIUM").otherwise("HIGH")
    vector_class = F.when(c("i_drawings") < 100, "LOW").when(c("i_drawings") < 500, "MEDIUM").when(c("i_drawings") < 2000, "HIGH").otherwise("EXTREME")
    checks = {
        "page_type": level(c("page_state") != page_state(c("i_characters"), c("i_images")), "CONTRADICTION"),
        "character_count": level(c("characters") != c("i_characters"), "CONTRADICTION"),
        "word_count": level(c("words") != c("i_words"), "WARNING"),
        "block_count": level(F.abs(c("blocks") - c("i_blocks")) > BLOCK_TOLERANCE, "WARNING"),
        "image_count": level(c("images") != c("i_images"), "CONTRADICTION"),
        "drawing_count": level(c("drawings") != c("i_drawings"), "CONTRADICTION"),
        "vector_class": level(c("vector_complexity") != vector_class, "CONTRADICTION"),
        "image_class": level(c("image_complexity") != image_class, "CONTRADICTION"),
        "routing": F.when(grid, SEVERITY.index("REVIEW_REQUIRED")).when(F.size(F.array_except("routing_signals", ground)) > 0, SEVERITY.index("WARNING")).otherwise(0),
    }
    names = F.array(*[F.lit(s) for s in SEVERITY])
    said = lambda k: F.element_at(names, k + 1)
    worst = F.when(c("_there").isNull(), F.lit(3)).otherwise(F.greatest(*checks.values()))
    return both.select("page_number", *[F.when(c("_there").isNotNull(), said(v)).alias(k) for k, v in checks.items()], said(worst).alias("overall_status"))


def contained_spans(spans: DataFrame, rectangles: DataFrame, cell: float = 64.0) -> DataFrame:
    """Pairs of a text span and a rectangle of the same page that holds it (``page_number``, ``x0``, ``y0``, ``x1``, ``y1``; ids ``span_id``, ``rect_id``).

    A range join in two dimensions made an equality join: a rectangle is listed in each grid cell of ``cell`` points that it
    touches, a span in that of its upper left corner.
    """
    at = lambda c: F.floor(F.col(c) / cell)
    own = spans.select("page_number", "span_id", "x0", "y0", "x1", "y1", at("x0").alias("gx"), at("y0").alias("gy"))
    wide = rectangles.select("page_number", "rect_id", *[F.col(c).alias(f"r{c}") for c in ("x0", "y0", "x1", "y1")], F.explode(F.sequence(at("x0"), at("x1"))).alias("gx"), at("y0").alias("_a"), at("y1").alias("_b"))
    wide = wide.withColumn("gy", F.explode(F.sequence("_a", "_b"))).drop("_a", "_b")
    held = (F.col("x0") >= F.col("rx0")) & (F.col("y0") >= F.col("ry0")) & (F.col("x1") <= F.col("rx1")) & (F.col("y1") <= F.col("ry1"))
    return own.join(wide, ["page_number", "gx", "gy"]).filter(held).select("page_number", "span_id", "rect_id")


def contained_counts(spans: DataFrame, rectangles: DataFrame, cell: float = 64.0) -> DataFrame:
    """(rect_id, spans): how many spans each rectangle holds, where it holds any; frames as for ``contained_spans``.

    Spans of equal place are counted first and rectangles of equal place asked once, so pairs are made of distinct places alone, never of
    all spans and rectangles; their number grows with the places, not with the rows.
    """
    box = ["page_number", "x0", "y0", "x1", "y1"]
    places = spans.groupBy(*box).agg(F.count("*").alias("_n")).withColumn("span_id", F.col("_n"))
    shape = F.struct(*box)
    pairs = contained_spans(places, rectangles.select(*box).distinct().withColumn("rect_id", shape), cell)
    held = pairs.groupBy(F.col("rect_id").alias("_shape")).agg(F.sum("span_id").alias("_held"))
    return rectangles.select("rect_id", shape.alias("_shape")).join(held, "_shape").groupBy("rect_id").agg(F.sum("_held").alias("spans"))


def line_kind(dx: Column, dy: Column) -> Column:
    """A drawn line counts as horizontal or vertical from 20 points on with a skew of 1 at most."""
    return F.when((F.abs(dx) >= 20) & (F.abs(dy) <= 1), "horizontal").when((F.abs(dy) >= 20) & (F.abs(dx) <= 1), "vertical")


def investigation_summary(pages: DataFrame) -> DataFrame:
    """(kind, n, pages): pages of each type, and those with many drawings, little text or a grid."""
    kinds = [
        (page_state(F.col("characters"), F.col("images")), None), (F.col("drawings") >= 500, "high_vector"), (F.col("drawings") >= 2000, "extreme_vector"), (F.col("characters") < 1000, "low_text"),
        ((F.col("horizontal_lines") >= 3) & (F.col("vertical_lines") >= 3), "grid"),
    ]
    marked = F.array_compact(F.array(*[rule if tag is None else F.when(rule, F.lit(tag)) for rule, tag in kinds]))
    return pages.select("page_number", F.explode(marked).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("page_number")).alias("pages"))


def read_page_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Flat page rows of JSON reports whose ``pages`` hold nested metrics; values that aren't numbers count as 0."""
    where = {
        "page_number": "page_number", "width": "dimensions.width", "height": "dimensions.height", "characters": "text.characters", "words": "text.words", "lines": "text.lines", "blocks": "text.block_count", "spans": "text.span_count", "text_density": "text.text_density",
        "images": "images.reference_count", "unique_images": "images.unique_xref_count", "image_coverage": "images.coverage_ratio", "drawings": "vectors.drawing_count", "rectangles": "vectors.rectangle_count", "curves": "vectors.curve_count",
        "horizontal_lines": "vectors.meaningful_horizontal_line_count", "vertical_lines": "vectors.meaningful_vertical_line_count",
    }
    pages = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json(F.get_json_object("value", "$.pages"), "array<string>")).alias("p"))
    floats = ("width", "height", "text_density", "image_coverage")
    return pages.select(*[(tx.safe_float if k in floats else tx.safe_int)(F.get_json_object("p", f"$.{v}")).alias(k) for k, v in where.items()])


def scan_pdf(spark: SparkSession, path: str, measure: Callable[[bytes], list[dict]]) -> DataFrame:
    """Page metrics of PDF files; ``measure`` turns a file's bytes into one dict of metrics per page, on the executors, with whatever library is there."""
    kinds = {"page_number": "long", **{m: "double" if m in ("text_density", "image_coverage") else "long" for m in METRICS}}

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for name, content in zip(files["path"], files["content"], strict=True):
                rows = [{"path": name, **{k: page.get(k, 0) for k in kinds}} for page in measure(bytes(content))]
                yield pd.DataFrame(rows, columns=["path", *kinds])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(work, "path string, " + ", ".join(f"{k} {v}" for k, v in kinds.items()))
