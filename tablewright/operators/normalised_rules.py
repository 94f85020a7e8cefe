"""Rules and statistics of normalised documents: root, pages, blocks, tables and cells, and cells that take one another's place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The schema's name, keys of the root, fields of a cell.
SCHEMA_NAME = "pdf-ingestion-normalized"
ROOT_KEYS = ("schema", "source", "extraction", "document")
CELL_FIELDS = ("text", "row", "column", "rowspan", "colspan")
WARNINGS = ("schema_name", "schema_version", "block_page", "block_bbox", "table_empty", "table_body")


def _has(json: str, key: str) -> Column:
    return F.array_contains(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")), key)


def _get(json: str, path: str) -> Column:
    return F.get_json_object(json, f"$.{path}")


def _list(json: Column) -> Column:
    return F.when(F.startswith(F.ltrim(json), F.lit("[")), F.from_json(json, "array<string>"))


def _whole(json: str, key: str, default: int) -> tuple[Column, Column]:
    """A number of a cell and whether it is a whole one; a missing one is the default."""
    text = _get(json, key)
    good = F.coalesce(text.rlike(r"^-?\d+$"), F.lit(False)) | ~_has(json, key)
    return F.when(_has(json, key), text.try_cast("long")).otherwise(default), good


def levels(files: DataFrame) -> dict[str, DataFrame]:
    """``files`` (``path``, ``json``) taken apart: pages, blocks, tables (bodies with a table object), rows and cells, a row each with its place."""
    pages = files.select("path", F.posexplode(_list(_get("json", "document.pages"))).alias("page_pos", "page"))
    blocks = pages.select("path", "page_pos", F.posexplode(_list(_get("page", "blocks"))).alias("block_pos", "block"))
    spot = ["path", "page_pos", "block_pos"]
    parts = blocks.filter(_get("block", "type") == "table").select(*spot, F.posexplode_outer(_list(_get("block", "parts"))).alias("part_pos", "part"))
    body = F.coalesce((_get("part", "type") == "table_body") & F.startswith(F.ltrim(_get("part", "table")), F.lit("{")), F.lit(False))
    parts = parts.withColumn("body", body)
    tables = parts.filter("body").select(
        *spot, "part_pos", _list(_get("part", "table.rows")).alias("rows"), _get("part", "table.row_count").alias("row_count"), _get("part", "table.column_count").try_cast("long").alias("column_count"), _get("part", "image_path").alias("image_path")
    )
    spot = [*spot, "part_pos"]
    rows = tables.select(*spot, "column_count", F.size("rows").alias("n_rows"), F.posexplode("rows").alias("row_pos", "row"))
    cells = rows.select(*spot, "column_count", "n_rows", "row_pos", F.posexplode(_list(F.col("row"))).alias("cell_pos", "cell"))
    row, column = _whole("cell", "row", 0), _whole("cell", "column", 0)
    down, across = _whole("cell", "rowspan", 1), _whole("cell", "colspan", 1)
    cells = cells.withColumns({"is_cell": F.startswith(F.ltrim("cell"), F.lit("{")), "at_row": row[0], "at_column": column[0], "rowspan": down[0], "colspan": across[0], "row_good": down[1] & (down[0] >= 1), "column_good": across[1] & (across[0] >= 1)})
    return {"files": files, "pages": pages, "blocks": blocks, "parts": parts, "tables": tables, "rows": rows, "cells": cells}


def overlaps(cells: DataFrame) -> DataFrame:
    """(path, page_pos, block_pos, part_pos, row, column): where a cell begins, in a row that it reaches, before another that begins further left has ended.

    A cell is an interval of columns in each row that it spans, cut at the table's end; in a row the intervals are swept by their
    begin, so a table costs its slots and not the pairs of its cells.
    """
    spot = ["path", "page_pos", "block_pos", "part_pos"]
    sound = cells.filter("is_cell AND row_good AND column_good AND at_row >= 0 AND at_row < n_rows")
    last = F.least(F.col("at_row") + F.col("rowspan") - 1, F.col("n_rows") - 1)
    spans = sound.select(*spot, "row_pos", "cell_pos", F.col("at_column").alias("column"), (F.col("at_column") + F.col("colspan")).alias("end"), F.explode(F.sequence("at_row", last)).alias("row"))
    before = Window.partitionBy(*spot, "row").orderBy("column", "row_pos", "cell_pos").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_reach", F.max("end").over(before)).filter(F.col("column") < F.col("_reach")).select(*spot, "row", "column")


def violations(files: DataFrame) -> DataFrame:
    """(path, page_pos, block_pos, severity, rule) of every broken rule of normalised documents (``path``, ``json``); nothing is raised."""
    at = levels(files)

    def broken(level: str, rule: str, bad: Column) -> DataFrame:
        own = at[level]
        place = [F.col(c) if c in own.columns else F.lit(None).cast("int").alias(c) for c in ("page_pos", "block_pos")]
        return own.filter(F.coalesce(bad, F.lit(True))).select("path", *place, F.lit(rule).alias("rule"))

    is_object = F.startswith(F.ltrim("json"), F.lit("{"))
    document = F.startswith(F.ltrim(_get("json", "document")), F.lit("{"))
    listed = _list(_get("json", "document.pages"))
    rules = [
        broken("files", "root_object", ~is_object),
        *[broken("files", f"root_{k}", is_object & ~_has("json", k)) for k in ROOT_KEYS],
        broken("files", "schema_name", is_object & ~F.coalesce(_get("json", "schema.name") == SCHEMA_NAME, F.lit(False))),
        broken("files", "schema_version", is_object & _get("json", "schema.version").isNull()),
        broken("files", "document_object", _has("json", "document") & ~F.coalesce(document, F.lit(False))),
        broken("files", "pages_list", F.coalesce(document, F.lit(False)) & listed.isNull()),
        broken("files", "page_count", listed.isNotNull() & ~F.coalesce(_get("json", "document.page_count").try_cast("long") == F.size(listed), F.lit(False))),
        broken("pages", "page_blocks", _list(_get("page", "blocks")).isNull()),
        broken("blocks", "block_type", ~_has("block", "type")),
        broken("blocks", "block_page", ~_has("block", "page")),
        broken("blocks", "block_bbox", ~_has("block", "bbox")),
        broken("tables", "table_empty", F.coalesce(F.size("rows"), F.lit(0)) <= 0),
        broken("tables", "row_count", (F.size("rows") > 0) & ~F.coalesce(F.col("row_count").try_cast("long") == F.size("rows"), F.lit(False))),
        broken("rows", "row_list", _list(F.col("row")).isNull()),
        broken("cells", "cell_object", ~F.coalesce("is_cell", F.lit(False))),
        *[broken("cells", f"cell_{f}", F.col("is_cell") & ~_has("cell", f)) for f in CELL_FIELDS],
        broken("cells", "cell_columns", F.col("is_cell") & F.coalesce(F.col("at_column") + F.col("colspan") > F.col("column_count"), F.lit(False))),
        broken("cells", "rowspan", F.col("is_cell") & ~F.coalesce("row_good", F.lit(False))),
        broken("cells", "colspan", F.col("is_cell") & ~F.coalesce("column_good", F.lit(False))),
    ]
    bare = at["parts"].groupBy("path", "page_pos", "block_pos").agg(F.max("body").alias("some")).filter("NOT some")
    rules.append(bare.select("path", "page_pos", "block_pos", F.lit("table_body").alias("rule")))
    rules.append(overlaps(at["cells"]).select("path", "page_pos", "block_pos", F.lit("cell_overlap").alias("rule")))
    severity = F.when(F.col("rule").isin(*WARNINGS), "WARNING").otherwise("ERROR")
    return reduce(DataFrame.unionByName, rules).select("path", "page_pos", "block_pos", severity.alias("severity"), "rule")


def statistics(files: DataFrame) -> DataFrame:
    """(path, name, n): pages, blocks (each type too), tables, empty tables, rows, cells, spanning cells and table images of each document."""
    at = levels(files)
    count = lambda level, name, keep=None: (at[level] if keep is None else at[level].filter(keep)).select("path", (F.lit(name) if isinstance(name, str) else name).alias("name"))
    rows = [
        count("pages", "pages"), count("blocks", "blocks"), count("blocks", F.concat(F.lit("type "), F.coalesce(_get("block", "type"), F.lit("UNKNOWN")))), count("blocks", "tables", _get("block", "type") == "table"),
        count("tables", "empty_tables", F.coalesce(F.size("rows"), F.lit(0)) <= 0), count("rows", "table_rows"), count("cells", "table_cells"), count("cells", "rowspan_cells", F.col("rowspan") > 1),
        count("cells", "colspan_cells", F.col("colspan") > 1), count("tables", "table_images", F.coalesce("image_path", F.lit("")) != ""),
    ]
    return reduce(DataFrame.unionByName, rows).groupBy("path", "name").agg(F.count("*").alias("n"))
