"""Elements of JSON arrays from files of any size: Spark reads ranges of a file, and where its elements lie follows from prefix scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.scan import State, scan
from tablewright.sources.tables import cut

BLOCK_PIECES = 1 << 16
"""Pieces of a range of a file that are scanned together at most."""

# A complete string, what a string leaves open at the end, and the rest of one at the start.
WHOLE = r'"(?:[^"\\]|\\.)*+"'
OPEN = r'(?s)"(?:[^"\\]|\\.)*+$'
REST = r'(?s)^(?:[^"\\]|\\.)*+(?:"|$)'


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def json_pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text of files of a path or pattern, cut behind each closing brace: ``path``, ``at`` (order within the file), ``piece`` and its ``depth``s.

    Spark parts each file in ranges that end at a brace, so a file of any size is read by as many tasks as it has ranges. Whether a
    piece begins within a string is the parity of the quotes before it, and how deep it begins the sum of the brackets before it that stand in no
    string: two prefix scans over the pieces of a file. ``before`` and ``after`` are the depths at a piece's begin and end,
    its brace included; ``ends`` tells whether that brace stands in no string.
    """
    raw = spark.read.option("lineSep", "}").text(path)
    own = raw.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("piece")
    )
    own = own.withColumn("quotes", _count(F.regexp_replace("piece", r"\\.", ""), '"') % 2)
    own = cut(own.withColumn("run", F.struct("block", F.floor(F.col("seq") / BLOCK_PIECES).alias("n"))), "pieces")
    order = ["block", "seq"]
    odd = scan(own, ["path"], order, [State("odd", "xor", F.col("quotes"))], F.col("run"))
    started = F.col("odd").bitwiseXOR(F.col("quotes"))
    bare = F.when(started == 1, F.regexp_replace("piece", REST, "")).otherwise(F.col("piece"))
    bare = F.regexp_replace(F.regexp_replace(bare, WHOLE, "0"), OPEN, "0")
    marked = odd.withColumns({"inside": started == 1, "ends": F.col("odd") == 0, "bare": bare})
    step = _count(F.col("bare"), r"[\[{]") - _count(F.col("bare"), r"[\]}]") - F.col("ends").cast("long")
    deep = scan(marked.withColumn("step", step), ["path"], order, [State("after", "sum", F.col("step"))], F.col("run"))
    return deep.select("path", *order, "run", "piece", "inside", "ends", (F.col("after") - F.col("step")).alias("before"), "after", "bare")


def json_elements(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """``path``, ``ord`` (from 0) and ``json`` of each element of an array: that of ``key`` in the root object, or without ``key`` the root itself.

    Files whose root has no such array give no row. Elements may be of any kind; scalars that follow the last object of the array must not be
    arrays. A file is read by as many tasks as Spark gives it ranges; an element, not a file, must fit in a row. Of repeated keys the
    first counts. Null elements are the text ``null``. The pieces are written to the shared folder once.
    """
    pieces = json_pieces(spark, path)
    mark = r"^\s*\[" if key is None else rf'"{key}"\s*:\s*\['
    outer = 0 if key is None else 1
    begin = F.regexp_instr("piece", F.lit(mark))
    ahead = F.substr("piece", F.lit(1), begin - 1)
    plain = F.regexp_replace(F.regexp_replace(F.when(F.col("inside"), F.regexp_replace(ahead, REST, "")).otherwise(ahead), WHOLE, "0"), OPEN, "0")
    depth = F.col("before") + _count(plain, r"[\[{]") - _count(plain, r"[\]}]")
    first = (begin > 0) & (depth == outer) & (F.lit(True) if key else (F.col("block") == 0) & (F.col("before") == 0))
    text = F.when(first, F.regexp_replace("piece", rf"(?s)^.*?{mark[1:] if key is None else mark}", "")).otherwise(F.col("piece"))
    order = ["block", "seq"]
    opened = scan(pieces.withColumns({"first": F.coalesce(first, F.lit(False)).cast("long"), "text": text}), ["path"], order, [State("open", "sum", F.col("first"))], F.col("run"))
    # the array's own bracket closes in the first piece that begins in the array and meets it outside of all elements, or in that which opens it
    tail = rf'(?s)^((?:[^"\[\]{{}}]|{WHOLE})*)\].*$'
    closes = (F.col("open") > 0) & ((F.col("first") == 1) | (F.col("before") == outer + 1)) & F.col("text").rlike(tail)
    closing = scan(opened.withColumn("closes", closes.cast("long")), ["path"], order, [State("closed", "sum", F.col("closes"))], F.col("run"))
    inside = closing.filter((F.col("open") > 0) & ((F.col("closed") == 0) | ((F.col("closed") == 1) & (F.col("closes") == 1))))
    done = (F.col("ends") & (F.col("after") == outer + 1) & (F.col("closes") == 0)).cast("long")
    numbered = scan(inside.withColumn("done", done), ["path"], order, [State("upto", "sum", F.col("done"))], F.col("run"))
    said = F.when(F.col("closes") == 1, F.regexp_replace("text", tail, "$1")).otherwise(F.concat("text", F.lit("}")))
    group = numbered.groupBy("path", (F.col("upto") - F.col("done")).alias("n"))
    whole = group.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "seq", said.alias("s")))), lambda p: p["s"]), "").alias("t"))
    bare = F.trim(F.regexp_replace("t", r"^\s*,", ""), F.lit(" \t\r\n"))
    whole = whole.withColumn("t", bare)
    # a group is one object, unless scalars or lists stand before it
    every = F.concat(F.lit("["), F.col("t"), F.lit("]"))
    spelt = F.zip_with(F.from_json(every, "array<string>"), F.from_json(every, "array<variant>"), lambda s, v: F.when(F.schema_of_variant(v) == "STRING", F.to_json(v)).otherwise(s))
    list_of = F.when(F.startswith("t", F.lit("{")), F.array("t")).otherwise(spelt)
    listed = cut(whole.filter("t <> ''").select("path", "n", list_of.alias("l")), "elements")
    placed = scan(listed.withColumn("size", F.size("l").cast("long")), ["path"], ["n"], [State("upto", "sum", F.col("size"))], F.floor(F.col("n") / BLOCK_PIECES))
    spread = placed.select("path", (F.col("upto") - F.col("size")).alias("start"), F.posexplode("l").alias("k", "json"))
    return spread.select("path", (F.col("start") + F.col("k")).alias("ord"), F.coalesce("json", F.lit("null")).alias("json"))
