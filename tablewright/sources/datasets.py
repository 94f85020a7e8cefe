"""Sources and sinks of JSON artifacts, read whole by Spark and opened lazily."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tablewright.sources.json_split import json_elements

# The schema name and keys of dataset files.
DATASET_NAME = "complex-table-rag-dataset"
ROOT_KEYS = ("schema", "dataset", "pages")
PAGE_KEYS = ("page", "table_id", "title", "equipment", "row_count", "rows", "notes")
ROW_KEYS = ("no", "parameter")

DATASET = "struct<schema:struct<name:string,version:string>,dataset:struct<dataset_name:string,document_name:string,page_count:long,total_rows:long>,pages:array<string>>"
PAGE = "struct<page:int,table_id:string,title:string,equipment:string,row_count:long,rows:array<string>,notes:string>"
RECORD = (
    "struct<record_id:string,page:int,table_id:string,row_number:int,section:string,subsection:string,parameter:string,sub_parameter:string,"
    "sub_sub_parameter:string,side:string,item:string,values:map<string,variant>,retrieval_text:string,document:string>"
)
RECORD_ROOTS = ("records", "data", "items", "retrieval_records")


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(path, json) of each file of a path or pattern."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))


def _keys(c: Column) -> Column:
    return F.coalesce(F.json_object_keys(c), F.array().cast("array<string>"))


def dataset(files: DataFrame) -> DataFrame:
    """One row per dataset file: its parsed root and the page objects as JSON."""
    return files.select("path", "json", F.from_json("json", DATASET).alias("root"))


def dataset_pages(files: DataFrame) -> DataFrame:
    """One row per page, in order (``page_pos``), with its rows as JSON texts."""
    pages = dataset(files).select("path", F.posexplode("root.pages").alias("page_pos", "page_json"))
    return pages.select("path", "page_pos", "page_json", F.from_json("page_json", PAGE).alias("p")).select("path", "page_pos", "page_json", "p.*")


def dataset_page(files: DataFrame, number: int) -> DataFrame:
    """The pages with a given number; empty if there is none."""
    return dataset_pages(files).filter(F.col("page") == number)


def dataset_rows(files: DataFrame) -> DataFrame:
    """One row per source row with its page, in order (``page_pos``, ``row_pos``)."""
    return page_rows(dataset_pages(files))


def dataset_statistics(files: DataFrame) -> DataFrame:
    """Pages, tables and rows of each file; a page is a table."""
    sizes = dataset_pages(files).groupBy("path").agg(F.count("*").alias("pages"), F.sum(F.size("rows")).cast("long").alias("rows"))
    return sizes.select("path", "pages", F.col("pages").alias("tables"), "rows")


def dataset_violations(files: DataFrame, schema_name: str = DATASET_NAME) -> DataFrame:
    """(path, rule, page_pos, row_pos, message) of every broken rule; nothing is raised."""
    root = dataset(files)
    keys = _keys(F.col("json"))
    pages = dataset_pages(files)
    rows = dataset_rows(files)

    def broken(df: DataFrame, rule: str, bad: Column, message: Column | str, page: bool = False, row: bool = False) -> DataFrame:
        none = F.lit(None).cast("int")
        said = F.lit(message) if isinstance(message, str) else message
        return df.filter(F.coalesce(bad, F.lit(True))).select("path", F.lit(rule).alias("rule"), (F.col("page_pos") if page else none).alias("page_pos"), (F.col("row_pos") if row else none).alias("row_pos"), said.alias("message"))

    kind = lambda json, key: F.schema_of_variant(F.try_variant_get(F.try_parse_json(json), f"$.{key}", "variant"))
    lacks = lambda c, names: F.array_except(F.array(*[F.lit(n) for n in names]), _keys(c))
    count = F.size("root.pages")
    counted = root.join(dataset_statistics(files).withColumnRenamed("rows", "_rows"), "path", "left")
    listed = F.col("root.dataset.page_count"), F.col("root.dataset.total_rows")
    return reduce(
        DataFrame.unionByName,
        [
            broken(root, "root_object", F.json_object_keys("json").isNull(), "the root is not an object"),
            broken(root, "root_keys", F.size(F.array_except(F.array(*[F.lit(k) for k in ROOT_KEYS]), keys)) > 0, F.concat(F.lit("missing root keys: "), F.array_join(F.array_except(F.array(*[F.lit(k) for k in ROOT_KEYS]), keys), ", "))),
            broken(root, "schema_object", ~kind("json", "schema").startswith("OBJECT"), "schema is not an object"),
            broken(root, "schema_name", F.col("root.schema.name") != schema_name, "unknown schema name"),
            broken(root, "pages_list", ~kind("json", "pages").startswith("ARRAY"), "pages is not a list"),
            broken(root, "pages_empty", count == 0, "there are no pages"),
            broken(pages, "page_keys", F.size(lacks(F.col("page_json"), PAGE_KEYS)) > 0, F.concat(F.lit("missing page keys: "), F.array_join(lacks(F.col("page_json"), PAGE_KEYS), ", ")), page=True),
            broken(pages, "rows_list", ~kind("page_json", "rows").startswith("ARRAY"), "rows is not a list", page=True),
            broken(pages, "row_count", F.col("row_count") != F.size("rows"), "row_count differs from the rows", page=True),
            broken(rows, "row_object", F.json_object_keys("row_json").isNull(), "a row is not an object", page=True, row=True),
            broken(rows.filter(F.json_object_keys("row_json").isNotNull()), "row_keys", F.size(lacks(F.col("row_json"), ROW_KEYS)) > 0, F.concat(F.lit("missing row keys: "), F.array_join(lacks(F.col("row_json"), ROW_KEYS), ", ")), page=True, row=True),
            broken(counted, "page_count", listed[0].isNotNull() & (listed[0] != count), "page_count differs from the pages"),
            broken(counted, "total_rows", listed[1].isNotNull() & (listed[1] != F.coalesce("_rows", F.lit(0))), "total_rows differs from the rows"),
        ],
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Retrieval records of JSON files, be the root a list or an object with one of the known keys; ``ord`` is the source order."""
    listed = F.coalesce(*[F.from_json(F.get_json_object("json", f"$.{k}"), f"array<{RECORD}>") for k in RECORD_ROOTS], F.when(F.trim("json").startswith("["), F.from_json("json", f"array<{RECORD}>")))
    rows = read_whole(spark, path).select("path", F.posexplode(listed).alias("ord", "r")).select("path", F.col("ord").cast("long").alias("ord"), "r.*")
    return _with_values(rows)


def read_split_records(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """As ``read_records`` for files of any size, whose list is that of ``key``, or without it the root: a file is read by many tasks."""
    own = json_elements(spark, path, key).select("path", "ord", F.from_json("json", RECORD).alias("r"))
    return _with_values(own.select("path", "ord", "r.*"))


def split_pages(spark: SparkSession, path: str) -> DataFrame:
    """As ``dataset_pages`` for files of any size: a page, not a file, must fit in a row."""
    pages = json_elements(spark, path, "pages").select("path", F.col("ord").cast("int").alias("page_pos"), F.col("json").alias("page_json"))
    return pages.select("path", "page_pos", "page_json", F.from_json("page_json", PAGE).alias("p")).select("path", "page_pos", "page_json", "p.*")


def page_rows(pages: DataFrame) -> DataFrame:
    """One row per source row of ``dataset_pages`` or ``split_pages``, in order (``page_pos``, ``row_pos``)."""
    return pages.select("path", "page_pos", "page", "table_id", "equipment", F.posexplode("rows").alias("row_pos", "row_json"))


def _with_values(rows: DataFrame) -> DataFrame:
    return rows.withColumn("values_json", F.transform_values("values", lambda k, v: F.to_json(v))).withColumn("values", F.transform_values("values", lambda k, v: v.cast("string")))


def write_records(records: DataFrame, path: str, form: str = "parquet", counters: dict[str, Column] | None = None) -> dict[str, object]:
    """Write records, replacing what is there; ``form`` is parquet or json. Returns ``counters`` (aggregates by name) over what was written.

    They are observed in the job that writes, so the records are made once. Aggregates of distinct values cannot be observed.
    """
    if not counters:
        records.write.mode("overwrite").format(form).save(path)
        return {}
    seen = Observation()
    records.observe(seen, *[c.alias(name) for name, c in counters.items()]).write.mode("overwrite").format(form).save(path)
    return seen.get


def read_by_page(spark: SparkSession, pattern: str, wanted: DataFrame, page_col: str = "page_number") -> DataFrame:
    """One JSON file per page, by the number in its name, beside the wanted pages; ``found`` is false where there is none."""
    files = read_whole(spark, pattern).select(F.regexp_extract("path", r"(\d+)[^/]*$", 1).cast("int").alias("_page"), "json")
    return wanted.join(files, wanted[page_col] == files["_page"], "left").withColumn("found", F.col("_page").isNotNull()).drop("_page")


def read_binary_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files of any kind."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def file_violations(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """(path, rule) of files that cannot be read as a dataset: ``missing`` where nothing is there, ``suffix``, ``utf8``, ``root_object``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path) if _exists(spark, path) else None
    if files is None:
        return spark.createDataFrame([(path, "missing")], "path string, rule string")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    rules = {
        "suffix": ~F.endswith(F.lower("path"), F.lit(suffix)),
        "utf8": text.isNull(),
        "root_object": F.endswith(F.lower("path"), F.lit(suffix)) & text.isNotNull() & F.json_object_keys(text).isNull(),
    }
    return files.select("path", F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(rule)) for rule, bad in rules.items()]))).alias("rule"))


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern meets any file, on any file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def artifact_violations(catalogue: DataFrame, index: DataFrame, records: DataFrame) -> DataFrame:
    """(rule) of artifacts (``json``, one row each) of a wrong shape: catalogue and index must be objects, records a list, or an object with one, not empty."""
    listed = F.coalesce(*[F.get_json_object("json", f"$.{k}") for k in ("records", "retrieval_records")], F.when(F.startswith(F.ltrim("json"), F.lit("[")), F.col("json")))
    size = F.json_array_length(listed)
    return reduce(
        DataFrame.unionByName,
        [
            catalogue.filter(F.json_object_keys("json").isNull()).select(F.lit("catalogue_object").alias("rule")),
            index.filter(F.json_object_keys("json").isNull()).select(F.lit("index_object").alias("rule")),
            records.filter(size.isNull()).select(F.lit("records_list").alias("rule")),
            records.filter(size == 0).select(F.lit("records_empty").alias("rule")),
        ],
    )
