"""Parsed page layouts to normalised blocks, table cells and chunks that keep their place in the document's hierarchy."""

from __future__ import annotations

from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions import text as tx
from tablewright.operators.scan import State, range_blocks, scan

MAX_CHARS = 1800
CELL = "struct<row:int,column:int,rowspan:int,colspan:int,text:string>"
BLOCK = "struct<type:string,index:int,bbox:array<string>,content:string>"
TITLES = ("paragraph_title", "doc_title")
IGNORED = ("page_number", "footer", "header")


class _Cells(HTMLParser):
    """Cells of all rows of a table in reading order; a cell takes the next column of its own row."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.row, self.column, self.open, self.found = -1, 0, None, []

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.close_cell()
            self.row += 1
            self.column = 0
        elif tag in ("td", "th"):
            self.close_cell()
            spans = dict(attrs)
            self.open = (max(self.row, 0), self.column, self.span(spans.get("rowspan")), self.span(spans.get("colspan")), [])
        elif tag == "br" and self.open:
            self.open[4].append("\n")

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self.close_cell()

    def handle_data(self, data):
        if self.open:
            self.open[4].append(data)

    @staticmethod
    def span(value) -> int:
        try:
            return max(1, int(value))
        except (TypeError, ValueError):
            return 1

    def close_cell(self):
        if self.open:
            row, column, rowspan, colspan, said = self.open
            text = "".join(said).replace(" ", " ")
            self.found.append((row, column, rowspan, colspan, " ".join(text.split(" ")).strip()))
            self.column = column + colspan
            self.open = None


def _parsed(html: str | None, expand: bool) -> list[tuple]:
    parser = _Cells()
    parser.feed(html or "")
    parser.close()
    parser.close_cell()
    if not expand:
        return parser.found
    taken: set[tuple[int, int]] = set()
    moved = []
    for row, _, rowspan, colspan, text in parser.found:
        column = 0
        while (row, column) in taken:
            column += 1
        taken |= {(row + i, column + j) for i in range(rowspan) for j in range(colspan)}
        moved.append((row, column, rowspan, colspan, text))
    return moved


def _parser(expand: bool):
    @F.pandas_udf(f"array<{CELL}>")
    def cells(html: pd.Series) -> pd.Series:
        return html.map(lambda h: [dict(zip(("row", "column", "rowspan", "colspan", "text"), c, strict=True)) for c in _parsed(h, expand)])

    return cells


def table_cells(tables: DataFrame, html: str, expand_spans: bool = False) -> DataFrame:
    """``cells`` of an HTML table with ``row_count`` and ``column_count``.

    Cells have row, column, rowspan, colspan (1 at least; bad ones count as 1) and text. As parsed, a row's columns are not
    moved by cells that reach down from rows above; ``expand_spans`` places them around those.
    """
    return counted_cells(tables.withColumn("cells", _parser(expand_spans)(F.col(html))))


def counted_cells(tables: DataFrame) -> DataFrame:
    last = lambda f: F.coalesce(F.array_max(F.transform("cells", f)), F.lit(0))
    return tables.withColumn("row_count", last(lambda c: c["row"] + 1)).withColumn("column_count", last(lambda c: c["column"] + c["colspan"]))


def long_cells(tables: DataFrame) -> DataFrame:
    """One row per cell."""
    return tables.select("*", F.inline("cells")).drop("cells")


def bbox(c: Column) -> Column:
    """Four numbers, or null where one isn't."""
    numbers = F.transform(c, lambda x: x.try_cast("double"))
    return F.when((F.size(numbers) > 0) & ~F.exists(numbers, lambda x: x.isNull()), numbers)


def inline_text(content: Column) -> Column:
    """Text of a block's content: a string, or the ``content`` of a list's parts joined by blanks."""
    parts = F.transform(F.from_json(content, "array<struct<content:string>>"), lambda p: tx.strip(F.coalesce(p["content"], F.lit(""))))
    return F.when(content.startswith("["), tx.clean_document(F.array_join(F.filter(parts, lambda p: p != ""), " "))).otherwise(tx.clean_document(F.coalesce(content, F.lit(""))))


def document_blocks(files: DataFrame) -> DataFrame:
    """One row per block of parsed layout JSON (``path``, ``json``): page number and sizes, block position, type, box, content as JSON."""
    pages = files.select("path", "json", F.posexplode(F.from_json(F.get_json_object("json", "$.pages"), f"array<struct<page_idx:int,blocks:array<{BLOCK}>>>")).alias("page_pos", "p"))
    sizes = F.from_json(F.get_json_object("json", "$.extensions.docvortex_layout.pages"), "array<struct<page_idx:int,width_pt:double,height_pt:double>>")
    own = pages.select("path", "page_pos", "p", F.coalesce("p.page_idx", "page_pos").alias("page_idx"), sizes.alias("_sizes"))
    own = own.withColumn("_size", F.filter("_sizes", lambda s: s["page_idx"] == F.col("page_idx"))[0])
    blocks = own.select("path", (F.col("page_idx") + 1).alias("page"), F.col("_size.width_pt").alias("width"), F.col("_size.height_pt").alias("height"), F.posexplode("p.blocks").alias("block_index", "b"))
    return blocks.select("path", "page", "width", "height", "block_index", F.coalesce("b.type", F.lit("text")).alias("type"), bbox(F.col("b.bbox")).alias("bbox"), F.col("b.content").alias("content"))


def normalised_blocks(blocks: DataFrame, expand_spans: bool = False) -> DataFrame:
    """Blocks with ``text``, and for tables ``caption``, ``html``, ``image_path`` and parsed cells.

    A table's parts are told apart by their type; several bodies are one table each, emitted once.
    """
    text = blocks.filter("type <> 'table'").select("path", "page", "block_index", "type", "bbox", inline_text(F.col("content")).alias("text"))
    part = "struct<type:string,content:string,image_path:string>"
    tables = blocks.filter("type = 'table'").withColumn("_parts", F.from_json("content", f"array<{part}>"))
    caption = F.array_join(F.transform(F.filter("_parts", lambda p: p["type"] == "table_caption"), lambda p: p["content"]), " ")
    bodies = F.filter("_parts", lambda p: p["type"] == "table_body")
    one = tables.select("path", "page", "block_index", "type", "bbox", caption.alias("caption"), F.posexplode_outer(bodies).alias("body_index", "_b"))
    one = table_cells(one.select("path", "page", "block_index", "type", "bbox", tx.clean_document("caption").alias("caption"), "body_index", F.col("_b.content").alias("html"), F.col("_b.image_path").alias("image_path")), "html", expand_spans)
    return text.unionByName(one, allowMissingColumns=True)


def block_violations(blocks: DataFrame) -> DataFrame:
    """(path, page, block_index, problem) of normalised blocks: no type, no box, cells beyond their table, empty text."""
    outside = F.exists("cells", lambda c: (c["column"] + c["colspan"] > F.col("column_count")) | (c["row"] >= F.col("row_count")) | (c["row"] < 0))
    table = F.col("type") == "table"
    problems = [(F.col("type").isNull(), "no type"), (F.col("bbox").isNull(), "no box"), (table & F.col("html").isNull(), "no table body"), (table & F.coalesce(outside, F.lit(False)), "cell outside its table"), (~table & (F.coalesce("text", F.lit("")) == ""), "empty text")]
    return blocks.select("path", "page", "block_index", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in problems]))).alias("problem"))


def term_hits(blocks: DataFrame, terms: list[str]) -> DataFrame:
    """(path, page, block_index, term): blocks or cells that contain a term, regardless of case and quotes."""
    said = F.concat(F.array(F.coalesce("text", F.lit(""))), F.coalesce(F.transform("cells", lambda c: c["text"]), F.array().cast("array<string>")))
    cells = blocks.select("path", "page", "block_index", F.explode(said).alias("t")).withColumn("t", tx.fold_quotes(F.upper("t")))
    hit = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.col("t"), tx.fold_quotes(F.upper(t))))
    return cells.select("path", "page", "block_index", F.explode(hit).alias("term")).distinct()


def real_table(cells: Column, rows: Column, columns: Column) -> Column:
    """Whether a table is data rather than a wrapper of prose.

    Not with fewer than two rows or cells; not with two headings and a fifth of its cells long; not with a product-standard page
    reference; else with two rows and columns and a share of .35 short cells, or three rows and two columns.
    """
    text = F.array_join(F.transform(cells, lambda c: c["text"]), " ")
    headings = F.regexp_count(text, F.lit(r"\b\d+(?:\.\d+){0,4}\.?\s+[A-Z][A-Za-z]"))
    share = lambda f: F.size(F.filter(cells, f)) / F.greatest(F.size(cells), F.lit(1))
    prose = (headings >= 2) & (share(lambda c: F.length(c["text"]) > 120) >= 0.2)
    wrapper = F.upper(text).rlike("PRODUCT STANDARD") & F.upper(text).rlike(r"PAGE\s+\d+\s+OF\s+\d+")
    shape = ((rows >= 2) & (columns >= 2) & (share(lambda c: F.length(c["text"]) <= 80) >= 0.35)) | ((rows >= 3) & (columns >= 2))
    return (rows >= 2) & (F.size(cells) >= 2) & ~prose & ~wrapper & shape


def table_rows(cells: Column) -> Column:
    """Each row's cells joined by bars, with their spans noted."""
    shown = lambda c: F.concat(c["text"], F.when(c["rowspan"] > 1, F.format_string("[rowspan=%d]", c["rowspan"])).otherwise(""), F.when(c["colspan"] > 1, F.format_string("[colspan=%d]", c["colspan"])).otherwise(""))
    rows = F.array_sort(F.array_distinct(F.transform(cells, lambda c: c["row"])))
    return F.transform(rows, lambda r: F.array_join(F.transform(F.filter(cells, lambda c: c["row"] == r), shown), " | "))


def _breaks(lengths: np.ndarray, separator: int, most: int) -> list[int]:
    """Where the parts of these lengths are cut when they are joined greedily: the first part of each text, and the end.

    Each next cut is sought in the running lengths, so the work is that of the texts made and not of the parts joined.
    """
    running = np.concatenate([[0], np.cumsum(lengths.astype(np.int64) + separator)])
    cuts = [0]
    while cuts[-1] < len(lengths):
        far = int(np.searchsorted(running, running[cuts[-1]] + most + separator, side="right")) - 1
        cuts.append(max(far, cuts[-1] + 1))
    return cuts


def _cuts(separator: int, most: int):
    """A UDF of the cuts for each list of lengths; only numbers go to Python."""

    @F.arrow_udf("array<array<int>>")
    def cuts(lengths: pa.Array) -> pa.Array:
        inner = lengths.flatten()
        numbers = inner.flatten().to_numpy(zero_copy_only=False)
        sizes = pc.fill_null(pc.list_value_length(inner), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        found = [_breaks(numbers[e - s : e], separator, most) for e, s in zip(ends, sizes, strict=True)]
        marks = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]), pa.int32())
        flat = pa.ListArray.from_arrays(marks, pa.array([x for f in found for x in f], pa.int32()))
        outer = pc.fill_null(pc.list_value_length(lengths), 0).to_numpy(zero_copy_only=False)
        null = np.append(lengths.is_null().to_numpy(zero_copy_only=False), False)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(outer)]), pa.int32(), mask=null), flat)

    return cuts


def _joined(parts: Column, at: Column, i: Column, separator: str) -> Column:
    """The parts from the i-th cut (from 1) to the next one as one text."""
    return F.array_join(F.slice(parts, F.element_at(at, i) + 1, F.element_at(at, i + 1) - F.element_at(at, i)), separator)


def packed(lists: Column, separator: str, most: int) -> Column:
    """Each list of texts of a list joined greedily to texts none of which is longer than ``most``, unless a part is."""
    cuts = _cuts(len(separator), most)(F.transform(lists, lambda parts: F.transform(parts, F.length)))
    texts = lambda parts, at: F.transform(F.sequence(F.lit(1), F.size(at) - 1), lambda i: _joined(parts, at, i, separator))
    return F.zip_with(lists, cuts, lambda parts, at: F.when(F.size(at) > 1, texts(parts, at)).otherwise(F.array().cast("array<string>")))


def packed_rows(rows: Column, separator: str, most: int) -> Column:
    """As ``packed`` for one short list, the rows of a table, without a UDF: the work grows with the square of the texts made."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"))

    def step(acc: Column, row: Column) -> Column:
        longer = F.concat(acc["now"], F.lit(separator), row)
        full = acc["now"].isNotNull() & (F.length(longer) > most)
        done = F.when(full, F.array_append(acc["done"], acc["now"])).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(acc["now"].isNull() | full, row).otherwise(longer).alias("now"))

    return F.aggregate(rows, start, step, lambda acc: F.when(acc["now"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["now"])))


def _paragraphs(text: Column) -> Column:
    """The paragraphs of a clean text; a part of a clean text is clean but for its ends."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), tx.strip), lambda p: p != "")


def _sentences(paragraphs: Column, most: int) -> Column:
    """The sentences of each paragraph that is too long; it is packed with no other, so they don't depend on how paragraphs are packed."""
    return F.transform(paragraphs, lambda p: F.when(F.length(p) > most, F.split(p, r"(?<=[.!?])\s+")).otherwise(F.array().cast("array<string>")))


def _texts(paragraphs: Column, parts: Column, cuts: Column) -> Column:
    """The chunks: paragraphs joined from cut to cut, or the packed sentences of a paragraph that stands alone."""
    own = lambda i: F.get(parts, F.element_at(cuts, i))
    one = lambda i: F.when(F.size(own(i)) > 0, own(i)).otherwise(F.array(_joined(paragraphs, cuts, i, "\n\n")))
    return F.flatten(F.transform(F.sequence(F.lit(1), F.size(cuts) - 1), one))


def split_text(c: Column | str, most: int = MAX_CHARS) -> Column:
    """Chunks of at most ``most`` characters: paragraphs packed together, longer ones by sentences; a longer sentence stays whole. Null and blank give none.

    One expression, in which the text is cleaned and parted several times; ``with_chunks`` does each step once.
    """
    text = tx.clean_chunk(c)
    paragraphs = _paragraphs(text)
    parts = packed(_sentences(paragraphs, most), " ", most)
    cuts = _cuts(2, most)(F.array(F.transform(paragraphs, F.length)))[0]
    # all three go into the lambda as one variable, so that they are computed once
    held = F.array(F.struct(paragraphs.alias("p"), parts.alias("s"), cuts.alias("c")))
    whole = F.flatten(F.transform(held, lambda w: _texts(w["p"], w["s"], w["c"])))
    return F.when(text == "", F.array().cast("array<string>")).when(F.length(text) <= most, F.array(text)).otherwise(whole)


def with_chunks(df: DataFrame, text: str, name: str, most: int = MAX_CHARS) -> DataFrame:
    """``df`` with the chunks of ``text`` (as ``split_text``) as ``name``: the text is cleaned once, and only one that is too long is parted, once.

    Explode the chunks by ``posexplode_outer``: from an inner one Spark infers a filter that it pushes down, which would do all of it again.
    """
    own = df.withColumn("_clean", tx.clean_chunk(text))
    own = own.withColumn("_ps", F.when(F.length("_clean") > most, _paragraphs(F.col("_clean"))))
    own = own.withColumn("_ss", _sentences(F.col("_ps"), most))
    own = own.withColumn("_s", packed(F.col("_ss"), " ", most)).withColumn("_c", _cuts(2, most)(F.array(F.transform("_ps", F.length)))[0])
    none = F.array().cast("array<string>")
    made = F.when(F.col("_clean") == "", none).when(F.col("_ps").isNull(), F.array("_clean")).otherwise(_texts(F.col("_ps"), F.col("_s"), F.col("_c")))
    return own.withColumn(name, made).drop("_clean", "_ps", "_ss", "_s", "_c")


def without_header(c: Column, marks: tuple[str, ...] = tx.HEADER_MARKS) -> Column:
    """A text without the marks of a repeated page head, if it is one."""
    bare = c
    for mark in marks:
        bare = F.regexp_replace(bare, f"(?i){mark}", "")
    return F.when(tx.repeated_header(c), tx.clean_chunk(bare)).otherwise(c)


def semantic_lines(blocks: DataFrame) -> DataFrame:
    """One row per line of text blocks and of tables that only wrap prose, with what kind of line it is.

    ``kind`` is heading (numbered or title), letter (letter heading) or text; ``level`` 1 to 3 for headings that move the hierarchy. Headers,
    footers, page numbers and, in wrappers, page labels and noise are left out.
    """
    own = blocks.filter(~F.col("type").isin(*IGNORED))
    wrapper = (F.col("type") == "table") & ~F.coalesce(real_table(F.col("cells"), F.col("row_count"), F.col("column_count")), F.lit(False))
    kept = F.filter(F.transform("cells", lambda c: tx.clean_chunk(c["text"])), lambda t: ~tx.page_label(t) & ~tx.layout_noise(t))
    text = F.when(wrapper, F.array_join(kept, "\n")).when(~F.col("type").isin("table", "image"), tx.clean_chunk("text"))
    titled = F.col("type").isin(*TITLES)
    lines = F.when(titled, F.array(F.col("_text"))).otherwise(F.filter(F.transform(F.split(without_header(F.col("_text")), r"\n+"), tx.clean_chunk), lambda x: x != ""))
    rows = own.withColumn("_text", text).filter(F.coalesce("_text", F.lit("")) != "").select("path", "page", "block_index", F.coalesce("body_index", F.lit(0)).alias("body_index") if "body_index" in blocks.columns else F.lit(0).alias("body_index"), "type", titled.alias("titled"), F.posexplode(lines).alias("line", "text"))
    number = tx.heading_number("text")
    level = F.when(number.isNotNull(), F.least(tx.heading_level(number), F.lit(3))).when(F.col("titled"), 1)
    kind = F.when(level.isNotNull(), "heading").when(tx.letter_heading("text"), "letter").otherwise("text")
    return rows.withColumn("number", number).withColumn("level", level).withColumn("kind", kind)


def with_hierarchy(lines: DataFrame) -> DataFrame:
    """``section``, ``subsection`` and ``clause`` in force at each line of a document, across its blocks and pages; a higher heading clears the lower ones.

    A segmented scan over ranges of documents and places, so a document of any number of lines lies in many tasks.
    """
    order = ["page", "block_index", "body_index", "line"]
    own, cleared = F.struct(F.col("text").alias("v")), F.struct(F.lit(None).cast("string").alias("v"))
    names = ("section", "subsection", "clause")
    heads = {f"_h{n}": F.when(F.col("level") == n, own).when(F.col("level") < n, cleared) for n in (1, 2, 3)}
    ranged = range_blocks(lines.withColumns(heads), ["path"], order)
    out = scan(ranged, ["path"], order, [State(h, "last", F.col(h)) for h in heads], F.col("_block"))
    return out.select(*lines.drop(*names).columns, *[F.col(f"{h}.v").alias(name) for h, name in zip(heads, names, strict=True)])


def chunks(blocks: DataFrame, most: int = MAX_CHARS) -> DataFrame:
    """Chunks of normalised blocks in document order: headings, packed text between them, rows of real tables, image references.

    ``chunk_id`` counts from 0 in each document. A document is one window; documents are spread over the tasks.
    """
    lines = with_hierarchy(semantic_lines(blocks))
    spot = ["path", "page", "block_index", "body_index"]
    own = Window.partitionBy(*spot).orderBy("line")
    lines = lines.withColumn("_island", F.sum((F.col("kind") != "text").cast("int")).over(own))
    heads = lines.filter("kind <> 'text'").select(*spot, "line", F.lit(0).alias("part"), F.lit("heading").alias("content_type"), F.col("text").alias("content"), "section", "subsection", "clause")
    buffers = lines.filter("kind = 'text'").groupBy(*spot, "_island").agg(F.min("line").alias("line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("_t"), F.max_by(F.struct("section", "subsection", "clause"), "line").alias("h"))
    texts = with_chunks(buffers, "_t", "_parts", most).select(*spot, "line", F.posexplode_outer("_parts").alias("part", "content"), "h.*").filter("part IS NOT NULL").withColumn("content_type", F.lit("text"))
    body = F.coalesce("body_index", F.lit(0)).alias("body_index") if "body_index" in blocks.columns else F.lit(0).alias("body_index")
    real = blocks.filter(F.col("type") == "table").filter(real_table(F.col("cells"), F.col("row_count"), F.col("column_count")))
    tables = real.select("path", "page", "block_index", body, F.lit(0).alias("line"), F.posexplode(packed_rows(table_rows(F.col("cells")), "\n", most)).alias("part", "content"))
    tables = tables.withColumn("content_type", F.lit("table"))
    images = blocks.filter(F.col("type") == "image").select("path", "page", "block_index", body, F.lit(0).alias("line"), F.lit(0).alias("part"), F.concat(F.lit("Image reference: "), F.coalesce(*[F.col(c) for c in ("image_path", "text") if c in blocks.columns])).alias("content")).withColumn("content_type", F.lit("image"))
    every = heads.unionByName(texts).unionByName(tables, allowMissingColumns=True).unionByName(images, allowMissingColumns=True)
    order = ["page", "block_index", "body_index", "line", "part"]
    whole = Window.partitionBy("path").orderBy(*order)
    run = whole.rowsBetween(Window.unboundedPreceding, 0)
    # tables and images stand under the headings last seen before them
    mark = F.when(F.col("content_type").isin("heading", "text"), F.struct("section", "subsection", "clause"))
    placed = every.filter(tx.strip("content") != "").withColumn("_h", F.last(mark, True).over(run)).withColumn("_i", F.row_number().over(whole) - 1)
    names = F.format_string("chunk_%06d_page_%s_block_%s", F.col("_i").cast("int"), F.col("page").cast("string"), F.col("block_index").cast("string"))
    return placed.select("path", names.alias("chunk_id"), F.col("page").alias("document_page"), "block_index", "content_type", F.col("_h.section").alias("section"), F.col("_h.subsection").alias("subsection"), F.col("_h.clause").alias("clause"), "content")


def chunk_violations(made: DataFrame, most: int = MAX_CHARS) -> DataFrame:
    """(path, chunk_id, problem): empty contents, unknown types, text chunks without any heading, over-long ones."""
    problems = [(tx.strip(F.coalesce("content", F.lit(""))) == "", "empty"), (~F.col("content_type").isin("text", "table", "heading", "image"), "type"), ((F.col("content_type") == "text") & F.col("section").isNull(), "no section"), (F.length("content") > most, "long")]
    return made.select("path", "chunk_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in problems]))).alias("problem"))


def block_statistics(blocks: DataFrame) -> DataFrame:
    """(type, n) of blocks, ignored ones too."""
    return blocks.groupBy("type").agg(F.count("*").alias("n"))
