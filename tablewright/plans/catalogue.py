"""Queries over the shared tables that exercise the engine's operators, with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions import text as tx
from tablewright.operators import catalog, context, evaluate, inverted, layout, nearest, pages, questions, records, retrieve
from tablewright.sources.tables import cut, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _null(kind: str = "string"):
    return F.lit(None).cast(kind)


def _part_records(spark: SparkSession, d: str) -> DataFrame:
    """Parts as retrieval records."""
    p = table(spark, d, "part")
    words = F.split("p_name", " ")
    return p.select(
        F.col("p_partkey").cast("string").alias("record_id"), F.col("p_partkey").alias("ord"), F.col("p_size").alias("page"), F.lit("parts").alias("table_id"), F.col("p_brand").alias("item"), F.col("p_type").alias("section"), _null().alias("subsection"),
        words[1].alias("parameter"), words[0].alias("sub_parameter"), _null().alias("sub_sub_parameter"), F.when(F.col("p_partkey") % 2 == 0, "inlet").otherwise("outlet").alias("side"), F.col("p_name"),
        F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string")).alias("values"),
    )


@query("""
WITH e AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events)
, f AS (SELECT event_id, user_id, event_type,
  last_value(CASE WHEN event_type = 'signup' THEN CAST(event_id AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section,
  last_value(CASE WHEN event_type = 'error' THEN CAST(event_id AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS subsection FROM e)
SELECT event_id, user_id, section, subsection FROM f WHERE event_type NOT IN ('signup', 'error')
""")
def records_filldown(spark, d):
    kind = F.col("event_type")
    filled = records.fill_down(table(spark, d, "events").select("event_id", "user_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], kind == "signup", kind == "error", F.col("event_id").cast("string"))
    return filled.filter(~kind.isin("signup", "error")).select("event_id", "user_id", "section", "subsection")


@query("""
SELECT 'p' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || '_r' || CAST(l_orderkey AS VARCHAR) || '_inlet' AS record_id, 'inlet' AS side, l_quantity AS a, l_extendedprice AS b FROM lineitem
UNION ALL
SELECT 'p' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || '_r' || CAST(l_orderkey AS VARCHAR) || '_outlet', 'outlet', l_discount, l_tax FROM lineitem WHERE l_discount <> 0 OR l_tax <> 0
""")
def records_side_explode(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    out = records.explode_sides(rows, pair("l_quantity", "l_extendedprice"), pair("l_discount", "l_tax"), F.lit(True), (F.col("l_discount") != 0) | (F.col("l_tax") != 0))
    return out.select(records.record_id(F.col("l_linenumber"), F.col("l_orderkey"), F.col("side")).alias("record_id"), "side", F.col("side_value.a").alias("a"), F.col("side_value.b").alias("b"))


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS record_id, t AS retrieval_text, CAST(length(t) AS BIGINT) AS retrieval_text_length FROM (
  SELECT p_partkey, 'Section: ' || p_type || '. Parameter: ' || string_split(p_name, ' ')[2] || '. Sub-parameter: ' || string_split(p_name, ' ')[1] || '. Side: '
    || CASE WHEN p_partkey % 2 = 0 THEN 'Inlet' ELSE 'Outlet' END || '. Brand: ' || p_brand || '. Size: ' || CAST(p_size AS VARCHAR) || '.' AS t FROM part)
""")
def records_scalar_text(spark, d):
    out = records.retrieval_text(_part_records(spark, d), "values", lambda v: v)
    return out.select("record_id", "retrieval_text", F.col("retrieval_text_length").cast("long").alias("retrieval_text_length"))


@query("""
WITH items AS (SELECT p_size, arg_max(p_brand, p_partkey) AS item FROM part GROUP BY p_size)
SELECT CAST(p_partkey AS VARCHAR) AS record_id, item, upper(item) AS item_normalized, upper(p_type) AS section_normalized FROM part JOIN items USING (p_size)
""")
def enrich_page_item(spark, d):
    own = _part_records(spark, d).withColumn("parameter", F.lit(" item ")).withColumn("values", F.create_map(F.lit("value"), F.col("item")))
    return records.enrich(own).select("record_id", "item", "item_normalized", "section_normalized")


@query("""
WITH p AS (SELECT p_type AS section, string_split(p_name, ' ')[2] AS parameter, string_split(p_name, ' ')[1] AS sub_parameter, p_brand AS item, CASE WHEN p_partkey % 2 = 0 THEN 'inlet' ELSE 'outlet' END AS side FROM part)
SELECT DISTINCT 'section' AS kind, CAST(NULL AS VARCHAR) AS parent, section AS value FROM p UNION SELECT 'parameter', NULL, parameter FROM p UNION SELECT 'sub_parameter', NULL, sub_parameter FROM p
UNION SELECT 'item', NULL, item FROM p UNION SELECT 'side', NULL, side FROM p UNION SELECT 'value_field', NULL, unnest(['brand', 'size'])
UNION SELECT 'parameter_hierarchy', parameter, sub_parameter FROM p UNION SELECT 'section_hierarchy', section, parameter FROM p UNION SELECT 'parameter_sections', parameter, section FROM p UNION SELECT 'parameter_sides', parameter, side FROM p
""")
def schema_catalog(spark, d):
    own = _part_records(spark, d)
    return catalog.vocabulary(own).select("kind", _null().alias("parent"), "value").unionByName(catalog.hierarchy(own).select("kind", "parent", F.col("child").alias("value")))


@query("""
WITH p AS (SELECT p_type AS section, string_split(p_name, ' ')[2] AS parameter, string_split(p_name, ' ')[1] AS sub_parameter, p_brand AS item FROM part)
SELECT 'record' AS kind, count(*) AS n FROM p UNION ALL SELECT 'section', count(DISTINCT section) FROM p UNION ALL SELECT 'parameter', count(DISTINCT parameter) FROM p
UNION ALL SELECT 'sub_parameter', count(DISTINCT sub_parameter) FROM p UNION ALL SELECT 'item', count(DISTINCT item) FROM p UNION ALL SELECT 'side', 2 UNION ALL SELECT 'value_field', 2
""")
def schema_counts(spark, d):
    return catalog.catalogue_counts(_part_records(spark, d))


@query("""
SELECT lower(c_mktsegment) AS norm, arg_min(c_mktsegment, c_custkey) AS value, count(*) AS occurrences, count(DISTINCT c_nationkey) AS pages, CAST(min(c_custkey) AS VARCHAR) AS first_id FROM customer GROUP BY 1
""")
def entity_items(spark, d):
    own = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("record_id"), F.col("c_custkey").alias("ord"), F.col("c_mktsegment").alias("item"), F.col("c_nationkey").alias("page"), _null().alias("section"), _null().alias("parameter"))
    return catalog.item_index(own).select("norm", "value", "occurrences", F.size("pages").cast("long").alias("pages"), F.col("record_ids")[0].alias("first_id"))


@query("""
WITH v AS (SELECT 'segment' AS parameter, 'name' AS field, c_name AS value, c_custkey AS k FROM customer UNION ALL SELECT 'segment', 'segment', c_mktsegment, c_custkey FROM customer)
SELECT parameter, field, lower(trim(value)) AS norm, count(*) AS occurrences, CAST(min(k) AS VARCHAR) AS first_id FROM v WHERE length(value) <= 150 AND regexp_matches(value, '[A-Za-z0-9]') GROUP BY ALL
""")
def entity_index(spark, d):
    text = lambda c: F.to_json(F.struct(F.col(c).alias("v")))
    quoted = lambda c: F.regexp_extract(text(c), r'^\{"v":(.*)\}$', 1)
    own = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("record_id"), F.col("c_custkey").alias("ord"), _null().alias("item"), F.col("c_nationkey").alias("page"), _null().alias("section"), F.lit("segment").alias("parameter"), F.create_map(F.lit("name"), quoted("c_name"), F.lit("segment"), quoted("c_mktsegment"), F.lit("balance"), F.col("c_acctbal").cast("string")).alias("values_json"))
    return catalog.value_index(catalog.value_entries(own)).select("parameter", "field", "norm", "occurrences", F.col("record_ids")[0].alias("first_id"))


def _part_queries(spark, d, item: bool = True) -> DataFrame:
    """One query for each brand: the fields of its first part, the section only for every other."""
    first = table(spark, d, "part").groupBy("p_brand").agg(F.min_by(F.struct("p_name", "p_type", "p_partkey"), "p_partkey").alias("f"))
    odd = F.col("f.p_partkey") % 2 == 1
    return first.select(
        F.col("p_brand").alias("query_id"), F.when(F.lit(item) | odd, F.lower("p_brand")).alias("q_item"), F.when(odd, F.col("f.p_type")).alias("q_section"), _null().alias("q_subsection"), F.substring(F.split("f.p_name", " ")[1], 1, 3).alias("_stem"),
        F.split("f.p_name", " ")[1].alias("q_parameter"), _null().alias("q_sub_parameter"), _null().alias("q_side"),
    )


@query("""
WITH f AS (SELECT p_brand, arg_min(p_name, p_partkey) AS p_name, arg_min(p_type, p_partkey) AS p_type, min(p_partkey) AS k FROM part GROUP BY p_brand)
, hits AS (SELECT f.p_brand AS query_id, p.p_partkey, row_number() OVER (PARTITION BY f.p_brand ORDER BY p.p_partkey) AS rank FROM f JOIN part p ON p.p_brand = f.p_brand
  AND contains(upper(string_split(p.p_name, ' ')[2]), upper(substr(string_split(f.p_name, ' ')[2], 1, 3))) AND (f.k % 2 = 0 OR p.p_type = f.p_type))
SELECT query_id, CAST(p_partkey AS VARCHAR) AS record_id, CAST(rank AS BIGINT) AS rank FROM hits WHERE rank <= 10
""")
def structured_topk(spark, d):
    asked = _part_queries(spark, d).withColumn("q_parameter", F.col("_stem"))
    return retrieve.structured(_part_records(spark, d), asked).select("query_id", "record_id", F.col("rank").cast("long").alias("rank"))


@query("""
WITH f AS (SELECT p_brand, arg_min(p_name, p_partkey) AS p_name, arg_min(p_type, p_partkey) AS p_type, min(p_partkey) AS k FROM part GROUP BY p_brand)
, hits AS (SELECT f.p_brand AS query_id, p.p_partkey, row_number() OVER (PARTITION BY f.p_brand ORDER BY p.p_partkey) AS rank FROM f JOIN part p ON string_split(p.p_name, ' ')[2] = string_split(f.p_name, ' ')[2]
  AND (f.k % 2 = 0 OR (p.p_type = f.p_type AND p.p_brand = f.p_brand)))
SELECT query_id, CAST(p_partkey AS VARCHAR) AS record_id, CAST(rank AS BIGINT) AS rank FROM hits WHERE rank <= 10
""")
def exact_wildcard_filter(spark, d):
    return retrieve.exact(_part_records(spark, d), _part_queries(spark, d, item=False)).select("query_id", "record_id", F.col("rank").cast("long").alias("rank"))


def _documents(spark, d) -> DataFrame:
    """Documents as records: language as item, source as section."""
    return spread(table(spark, d, "documents")).select(F.col("doc_id").cast("string").alias("record_id"), F.col("doc_id").alias("ord"), F.col("lang").alias("item"), F.col("source").alias("section"), F.lit("text").alias("parameter"), F.col("text"))


def _bench_queries(spark, d) -> DataFrame:
    """A query of all tokens of each benchmark item, for English documents of one source."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), tx.search_tokens("text").alias("terms"), F.lit("en").alias("q_item"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("q_section"), F.lit("text").alias("q_parameter"))


_DOCS = "SELECT doc_id, lang AS item, source AS section, text FROM documents"


def bm25_sql(asked: str = "SELECT item_id AS query_id, text FROM benchmark", k: int = 10, docs: str = _DOCS) -> str:
    """The best ``k`` documents of each of the ``asked`` queries as ``bm25``."""
    norm = """trim(regexp_replace(translate(lower(coalesce(text, '')), '“”’', '""'''''), '[^a-z0-9"''./+\\-]+', ' ', 'g'))"""
    return f"""
docs AS (SELECT doc_id, item, section, list_filter(string_split(n, ' '), lambda t: t <> '') AS ts FROM (SELECT doc_id, item, section, {norm} AS n FROM ({docs}))),
stats AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM docs),
posts AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM docs) GROUP BY ALL),
raw AS (SELECT term, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM posts, stats GROUP BY term, n),
idfs AS (SELECT term, CASE WHEN idf < 0 THEN (SELECT 0.25 * avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(list_filter(string_split(n, ' '), lambda t: t <> '')) AS term FROM (SELECT query_id, {norm} AS n FROM ({asked}))) GROUP BY ALL),
scored AS (SELECT query_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM asked JOIN idfs USING (term) JOIN posts USING (term), stats GROUP BY ALL),
filled AS (SELECT q.query_id, d.doc_id, coalesce(s.score, 0) AS score FROM (SELECT DISTINCT query_id FROM asked) q CROSS JOIN docs d LEFT JOIN scored s ON s.query_id = q.query_id AND s.doc_id = d.doc_id),
bm25 AS (SELECT query_id, doc_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM filled QUALIFY rank <= {k})"""


@query(f"WITH {bm25_sql()} SELECT query_id, CAST(doc_id AS VARCHAR) AS record_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM bm25")
def bm25_topk(spark, d):
    index = inverted.bm25_index(_documents(spark, d), tx.search_tokens("text"))
    return inverted.bm25(index, _bench_queries(spark, d), 10).select("query_id", "record_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


_STRUCTURED = """
structured AS (SELECT b.item_id AS query_id, d.doc_id, row_number() OVER (PARTITION BY b.item_id ORDER BY d.doc_id) AS rank FROM benchmark b JOIN documents d ON d.lang = 'en' AND d.source = 'src' || CAST(b.item_id % 20 AS VARCHAR) QUALIFY rank <= 10)"""
_FUSE = """
both_lists AS (SELECT query_id, doc_id, rank AS s, NULL AS b FROM structured UNION ALL SELECT query_id, doc_id, NULL, rank FROM bm25 {keep}),
one AS (SELECT query_id, doc_id, min(s) AS s, min(b) AS b, coalesce(1.0 / (60 + min(s)), 0) + coalesce(1.0 / (60 + min(b)), 0) AS score FROM both_lists GROUP BY ALL),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, s NULLS LAST, b NULLS LAST, CAST(doc_id AS VARCHAR)) AS r FROM one QUALIFY r <= 5)
SELECT query_id, CAST(doc_id AS VARCHAR) AS record_id, CAST(r AS BIGINT) AS hybrid_rank, CAST(s AS BIGINT) AS structured_rank, CAST(b AS BIGINT) AS bm25_rank, round(score, 8) AS hybrid_score FROM fused"""


def _fused(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "record_id", *[F.col(c).cast("long").alias(c) for c in ("hybrid_rank", "structured_rank", "bm25_rank")], F.round("hybrid_score", 8).alias("hybrid_score"))


def _asking(spark, d) -> DataFrame:
    return _bench_queries(spark, d).withColumns({"q_subsection": _null(), "q_sub_parameter": _null(), "q_side": _null()})


@query(f"WITH {bm25_sql()}, {_STRUCTURED}, {_FUSE.format(keep='')}")
def rrf_hybrid(spark, d):
    own = _documents(spark, d)
    return _fused(retrieve.hybrid_v1(own.drop("text"), inverted.bm25_index(own, tx.search_tokens("text")), _asking(spark, d)))


@query(f"WITH {bm25_sql()}, {_STRUCTURED}, {_FUSE.format(keep=chr(32) + 'SEMI JOIN (SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON d.lang = ' + repr('en') + ' AND d.source = ' + repr('src') + ' || CAST(b.item_id % 20 AS VARCHAR)) g ON g.item_id = bm25.query_id AND g.doc_id = bm25.doc_id')}")
def hybrid_v2(spark, d):
    own = _documents(spark, d)
    return _fused(retrieve.hybrid_v2(own.drop("text"), inverted.bm25_index(own, tx.search_tokens("text")), _asking(spark, d)))


_SPLIT = r"""
SELECT conv_id, turn, i - 1 AS intent_index, x AS intent FROM (
  SELECT conv_id, turn, unnest(xs) AS x, unnest(range(1, len(xs) + 1)) AS i FROM (
    SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(regexp_replace(replace(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '^(what is|what are|tell me|show me)\s+', '', 'i'), '?', ''), '\bas well as\b', 'and', 'gi'),
      '(?i)\s*,\s*|\s+and\b\s+'), lambda p: trim(regexp_replace(p, '^and\s+', '', 'i'))), lambda p: p <> '') AS xs FROM conversations))"""


@query(_SPLIT)
def split_intents(spark, d):
    asked = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("query"))
    return questions.split_intents(asked).select("conv_id", "turn", F.col("intent_index").cast("long").alias("intent_index"), "intent")


@query(r"""
WITH q AS (SELECT p_partkey AS query_id, ' SHOW ' || upper(p_name) || ' FOR ' || upper(coalesce(lead(p_name) OVER (ORDER BY p_partkey), 'none')) || ' ' AS t FROM part)
, v AS (SELECT DISTINCT p_name FROM part)
, hits AS (SELECT query_id, p_name, row_number() OVER (PARTITION BY query_id ORDER BY len(string_split(p_name, ' ')) DESC, length(p_name) DESC, p_name) AS k FROM q JOIN v ON contains(t, ' ' || upper(p_name) || ' '))
SELECT query_id, p_name AS term FROM hits WHERE k = 1
""")
def best_schema_term(spark, d):
    own = table(spark, d, "part").select("p_partkey", "p_name")
    after = own.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("_next"))
    asked = own.join(after, "p_partkey", "left").select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("show "), "p_name", F.lit(" for "), F.coalesce("_next", F.lit("none"))).alias("query")).withColumn("_t", tx.phrase_tokens("query"))
    vocabulary = own.select("p_name").distinct().select(F.lit("parameter").alias("kind"), F.col("p_name").alias("value")).withColumn("tokens", tx.phrase_tokens("value")).withColumn("n_tokens", F.size("tokens")).withColumn("n_chars", F.length("value"))
    return questions.best_term(asked, vocabulary, "_t", {"parameter": "term"}).filter("term IS NOT NULL").select("query_id", "term")


@query("""
WITH q AS (SELECT conv_id, turn, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM conversations)
SELECT conv_id, turn, contains(t, ' the ') AS has_the, contains(t, ' to be ') AS has_to_be FROM q
""")
def phrase_match(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.has_term("text", F.lit("The")).alias("has_the"), tx.has_term("text", F.lit("to-be")).alias("has_to_be"))


@query("""
SELECT lower(p_brand) AS query_id, count(DISTINCT l_orderkey) AS orders, count(*) AS line_items FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
""")
def entity_scope(spark, d):
    own = _part_records(spark, d)
    brands = own.select(tx.norm_entity("item").alias("id_norm")).distinct().select(F.col("id_norm").alias("query_id"), "id_norm", F.lit("item").alias("id_kind"))
    none = own.limit(0).select(F.lit("").alias("norm"), F.array("record_id").alias("record_ids"))
    scoped = questions.entity_scope(brands, own, none)
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("record_id"), "l_orderkey")
    return scoped.join(lines, "record_id").groupBy("query_id").agg(F.countDistinct("l_orderkey").alias("orders"), F.count("*").alias("line_items"))


@query("SELECT conv_id, role, min(turn) AS turn, arg_min(text, turn) AS text FROM conversations GROUP BY conv_id, role")
def dedup_first(spark, d):
    return retrieve.first_of_each(table(spark, d, "conversations"), ["conv_id", "role"], ["turn"]).select("conv_id", "role", "turn", "text")


@query("SELECT c_custkey AS query_id, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_totalprice > 300000)")
def abstain(spark, d):
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), "c_name")
    return retrieve.abstained(asked, table(spark, d, "orders").filter("o_orderpriority = '1-URGENT' AND o_totalprice > 300000").select(F.col("o_custkey").alias("query_id")))


@query("""
WITH a AS (SELECT o_custkey AS q, o_orderkey AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 3)
, b AS (SELECT o_custkey AS q, o_orderkey AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank FROM orders QUALIFY rank <= 3)
, u AS (SELECT q, r, 0 AS source, rank FROM a UNION ALL SELECT q, r, 1, rank FROM b)
, f AS (SELECT *, row_number() OVER (PARTITION BY q, r ORDER BY source, rank) AS k FROM u QUALIFY k = 1)
SELECT q AS query_id, r AS record_id, CAST(n AS BIGINT) AS rank FROM (SELECT q, r, row_number() OVER (PARTITION BY q ORDER BY source, rank) AS n FROM f) WHERE n <= 5
""")
def ordered_union(spark, d):
    own = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("record_id"), "o_totalprice", "o_orderdate")
    lists = [retrieve.top(own, [F.desc("o_totalprice"), "record_id"], 3), retrieve.top(own, ["o_orderdate", "record_id"], 3)]
    return retrieve.ordered_union(lists, 5).select("query_id", "record_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT conv_id, count(*) AS n_blocks, string_agg('Role: ' || role || chr(10) || 'Text: ' || text, chr(10) || chr(10) ORDER BY turn) AS context_text FROM conversations GROUP BY conv_id")
def context_text(spark, d):
    said = table(spark, d, "conversations").withColumn("_t", F.array_join(context.value_lines(F.create_map(F.lit("role"), F.col("role"), F.lit("text"), F.col("text"))), "\n"))
    return context.joined(said, "conv_id", "turn", "_t", "context_text")


@query("""
WITH c AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS t, arg_max(text, turn) AS q FROM conversations GROUP BY conv_id)
SELECT conv_id AS query_id, sha256('Context:' || chr(10) || chr(10) || t || chr(10) || chr(10) || 'Question:' || chr(10) || chr(10) || q || chr(10) || chr(10) || 'Answer using only the context above.') AS user_sha256 FROM c
""")
def prompt(spark, d):
    own = table(spark, d, "conversations").withColumn("query_id", F.col("conv_id"))
    asked = own.groupBy("query_id").agg(F.max_by("text", "turn").alias("query"))
    return context.prompts(asked, context.joined(own, "query_id", "turn", "text", "context_text")).select("query_id", F.sha2("user", 256).alias("user_sha256"))


_VECTORS = """
hits AS (SELECT q.vec_id AS query_id, v.vec_id AS record_id, q.label AS ql, v.label AS vl, round(list_inner_product(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(v.embedding, lambda x: CAST(x AS DOUBLE))) / (sqrt(list_inner_product(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(q.embedding, lambda x: CAST(x AS DOUBLE)))) * sqrt(list_inner_product(list_transform(v.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(v.embedding, lambda x: CAST(x AS DOUBLE))))), 9) AS score
  FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rank FROM hits QUALIFY rank <= 5)"""


def _vector_hits(spark, d) -> DataFrame:
    own = retrieve.unit(spread(table(spark, d, "embeddings"))).select(F.col("vec_id").alias("record_id"), "embedding", "label")
    asked = own.filter("record_id % 100 = 0").select(F.col("record_id").alias("query_id"), F.col("embedding").alias("q_embedding"))
    hits = nearest.vector_top(nearest.vector_index(own.select("record_id", "embedding")), asked, 6).filter("record_id <> query_id")
    return retrieve.top(hits.drop("rank"), [F.desc("score"), "record_id"], 5)


@query(f"WITH {_VECTORS} SELECT query_id, record_id, CAST(rank AS BIGINT) AS rank, round(score, 5) AS score FROM best")
def vector_topk(spark, d):
    return _vector_hits(spark, d).select("query_id", "record_id", F.col("rank").cast("long").alias("rank"), F.round("score", 5).alias("score"))


_METRICS = """
golden AS (SELECT q.vec_id AS query_id, q.label, count(*) AS size FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 AND v.label = q.label AND v.vec_id <> q.vec_id GROUP BY ALL),
m AS (SELECT g.query_id, 'label ' || CAST(g.label AS VARCHAR) AS category, count(*) AS returned, sum(CASE WHEN ql = vl THEN 1 ELSE 0 END) AS found, coalesce(1.0 / min(CASE WHEN ql = vl THEN rank END), 0) AS rr,
  max(CASE WHEN ql = vl AND rank <= 1 THEN 1.0 ELSE 0.0 END) AS hit1, max(CASE WHEN ql = vl AND rank <= 3 THEN 1.0 ELSE 0.0 END) AS hit3, sum(CASE WHEN ql = vl AND rank <= 3 THEN 1 ELSE 0 END) / 3.0 AS p3,
  sum(CASE WHEN ql = vl THEN 1 ELSE 0 END) / count(*) AS p, sum(CASE WHEN ql = vl THEN 1 ELSE 0 END) / any_value(size) AS r FROM golden g JOIN best b ON b.query_id = g.query_id GROUP BY g.query_id, g.label)"""


def _scores(spark, d) -> DataFrame:
    """Metrics of the vector search, records of the query's label being relevant: told hit by hit, and how many there are by counts."""
    own = table(spark, d, "embeddings").select("vec_id", "label")
    sizes = own.groupBy("label").agg((F.count("*") - 1).alias("expected_count"))
    named = F.concat(F.lit("label "), F.col("label").cast("string")).alias("category")
    golden = own.filter("vec_id % 100 = 0").join(sizes, "label").select(F.col("vec_id").alias("query_id"), named, "expected_count")
    hits = _vector_hits(spark, d).join(own.select(F.col("vec_id").alias("record_id"), F.col("label").alias("_own")), "record_id")
    hits = hits.join(own.select(F.col("vec_id").alias("query_id"), F.col("label").alias("_asked")), "query_id")
    return evaluate.metrics(golden, hits.select("query_id", "record_id", "rank", (F.col("_own") == F.col("_asked")).alias("relevant")))


@query(f"WITH {_VECTORS}, {_METRICS} SELECT query_id, category, returned, CAST(found AS BIGINT) AS found, round(rr, 6) AS reciprocal_rank, hit1 AS hit_at_1, hit3 AS hit_at_3, round(p3, 6) AS precision_at_3, round(p, 6) AS precision, round(r, 6) AS recall FROM m".replace("hit1 AS", "CAST(hit1 AS DOUBLE) AS").replace("hit3 AS", "CAST(hit3 AS DOUBLE) AS"))
def eval_metrics(spark, d):
    rounded = [F.round(c, 6).alias(c) for c in ("reciprocal_rank", "precision_at_3", "precision", "recall")]
    return _scores(spark, d).select("query_id", "category", "returned", "found", "hit_at_1", "hit_at_3", *rounded)


@query(f"WITH {_VECTORS}, {_METRICS} SELECT coalesce(category, 'ALL') AS category, count(*) AS queries, round(avg(rr), 6) AS reciprocal_rank, round(avg(p), 6) AS precision, round(CAST(avg(hit3) AS DOUBLE), 6) AS hit_at_3 FROM m GROUP BY ROLLUP (category)")
def eval_by_category(spark, d):
    return evaluate.by_category(_scores(spark, d), ["reciprocal_rank", "precision", "hit_at_3"])


def _count(pattern: str):
    return F.regexp_count("html", F.lit(pattern)).cast("long")


def _page_metrics(spark, d) -> DataFrame:
    """Pages of HTML as if they were measured page layouts."""
    own = table(spark, d, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    return own.select(
        F.col("page_id").alias("page_number"), F.length("html").cast("long").alias("characters"), _count("[^ ]+").alias("words"), _count("\n").alias("lines"), (_count("<p") * 3 + _count("<li")).alias("blocks"), _count("<").alias("spans"), (_count("<") / F.length("html")).alias("text_density"),
        _count("<a ").alias("images"), F.least(_count("<a "), F.lit(4)).cast("long").alias("unique_images"), (_count("<a ") / 10.0).alias("image_coverage"), (_count("e") * 1).alias("drawings"), _count("<b>").alias("rectangles"), _count("[aeiou]").alias("curves"), _count("<h1").alias("horizontal_lines"), _count("<p><b>").alias("vertical_lines"),
    )


_PAGE_METRICS = """
base AS (SELECT page_id AS page_number, coalesce(html, '') AS html FROM pages),
m AS (SELECT page_number, CAST(length(html) AS BIGINT) AS characters, len(regexp_extract_all(html, '[^ ]+')) AS words, len(regexp_extract_all(html, chr(10))) AS lines, len(regexp_extract_all(html, '<p')) * 3 + len(regexp_extract_all(html, '<li')) AS blocks, len(regexp_extract_all(html, '<')) AS spans,
  len(regexp_extract_all(html, '<')) / length(html) AS text_density, len(regexp_extract_all(html, '<a ')) AS images, least(len(regexp_extract_all(html, '<a ')), 4) AS unique_images, len(regexp_extract_all(html, '<a ')) / 10.0 AS image_coverage, len(regexp_extract_all(html, 'e')) AS drawings, len(regexp_extract_all(html, '<b>')) AS rectangles,
  len(regexp_extract_all(html, '[aeiou]')) AS curves, len(regexp_extract_all(html, '<h1')) AS horizontal_lines, len(regexp_extract_all(html, '<p><b>')) AS vertical_lines FROM base),
c AS (SELECT *, CASE WHEN characters = 0 AND images = 0 THEN 'EMPTY' WHEN characters = 0 THEN 'IMAGE_ONLY' WHEN images > 0 THEN 'MIXED_TEXT_IMAGE' ELSE 'TEXT_ONLY' END AS page_state,
  CASE WHEN characters < 1000 THEN 'LOW' WHEN characters < 3000 THEN 'MEDIUM' ELSE 'HIGH' END AS text_complexity, CASE WHEN blocks < 15 THEN 'SIMPLE' WHEN blocks < 40 THEN 'MODERATE' WHEN blocks < 70 THEN 'COMPLEX' ELSE 'EXTREME' END AS layout_complexity,
  CASE WHEN drawings < 100 THEN 'LOW' WHEN drawings < 500 THEN 'MEDIUM' WHEN drawings < 2000 THEN 'HIGH' ELSE 'EXTREME' END AS vector_complexity, CASE WHEN rectangles < 5 THEN 'LOW' WHEN rectangles < 25 THEN 'MEDIUM' WHEN rectangles < 75 THEN 'HIGH' ELSE 'EXTREME' END AS rectangle_complexity,
  CASE WHEN curves < 100 THEN 'LOW' WHEN curves < 1000 THEN 'MEDIUM' WHEN curves < 10000 THEN 'HIGH' ELSE 'EXTREME' END AS curve_complexity, CASE WHEN images < 1 THEN 'NONE' WHEN images < 3 THEN 'LOW' WHEN images < 5 THEN 'MEDIUM' ELSE 'HIGH' END AS image_complexity,
  horizontal_lines >= 2 AND vertical_lines >= 2 AS possible_grid FROM m)"""
_CLASS_NAMES = ("page_state", *pages.CLASSES)


@query(f"WITH {_PAGE_METRICS} SELECT page_number, {', '.join(_CLASS_NAMES)}, possible_grid FROM c")
def page_classes(spark, d):
    return pages.classify(_page_metrics(spark, d)).select("page_number", *_CLASS_NAMES, "possible_grid")


@query(f"""WITH {_PAGE_METRICS} SELECT page_number,
  array_to_string(list_filter([CASE WHEN page_state = 'IMAGE_ONLY' THEN 'requires_ocr' END, CASE WHEN page_state = 'MIXED_TEXT_IMAGE' THEN 'mixed_content' END, CASE WHEN images > 0 THEN 'contains_images' END, CASE WHEN images > 0 AND image_coverage >= 0.9 THEN 'full_page_image' END, CASE WHEN images > 0 AND image_coverage >= 0.5 THEN 'large_image' END,
    CASE WHEN characters < 1000 THEN 'low_text_content' END, CASE WHEN blocks >= 40 THEN 'dense_layout' END, CASE WHEN blocks >= 70 THEN 'extreme_layout_density' END, CASE WHEN drawings >= 500 THEN 'high_vector_complexity' END, CASE WHEN drawings >= 2000 THEN 'extreme_vector_complexity' END, CASE WHEN possible_grid THEN 'grid_evidence' END,
    CASE WHEN horizontal_lines >= 3 AND vertical_lines >= 2 AND rectangles >= 5 THEN 'strong_grid_evidence' END, CASE WHEN page_state = 'MIXED_TEXT_IMAGE' OR possible_grid OR blocks >= 40 THEN 'requires_layout_analysis' END], lambda x: x IS NOT NULL), ',') AS routing_signals,
  array_to_string(list_filter([CASE WHEN characters = 0 THEN 'no_native_text' END, CASE WHEN characters > 0 AND characters < 1000 THEN 'low_text_content' END, CASE WHEN characters >= 3000 THEN 'high_text_content' END, CASE WHEN blocks >= 40 THEN 'dense_text_blocks' END, CASE WHEN blocks >= 70 THEN 'extreme_text_block_density' END,
    CASE WHEN lines >= 100 THEN 'many_text_lines' END, CASE WHEN spans >= 100 THEN 'many_text_spans' END, CASE WHEN text_density >= 0.05 THEN 'high_text_density' END, CASE WHEN text_density <= 0.01 AND characters > 0 THEN 'low_text_density' END], lambda x: x IS NOT NULL), ',') AS text_signals FROM c""")
def page_signals(spark, d):
    return pages.classify(_page_metrics(spark, d)).select("page_number", F.array_join("routing_signals", ",").alias("routing_signals"), F.array_join("text_signals", ",").alias("text_signals"))


@query(f"WITH {_PAGE_METRICS} " + " UNION ALL ".join(f"SELECT '{k}' AS kind, {k} AS value, count(*) AS n FROM c GROUP BY 2" for k in _CLASS_NAMES))
def page_summary(spark, d):
    return pages.class_summary(pages.classify(_page_metrics(spark, d))).filter(F.col("kind").isin(*_CLASS_NAMES))


@query(f"WITH {_PAGE_METRICS}, u AS ({' UNION ALL '.join(f'''SELECT '{k}' AS metric, CAST({k} AS DOUBLE) AS v FROM c''' for k in ('characters', 'words', 'images', 'drawings'))}) SELECT metric, min(v) AS least, max(v) AS most, round(avg(v), 4) AS mean, round(median(v), 4) AS median FROM u GROUP BY metric")
def page_figures(spark, d):
    return pages.document_summary(_page_metrics(spark, d))


_CHECKS = {
    "page_type": "CASE WHEN i_state <> page_state THEN 'CONTRADICTION' ELSE 'CONSISTENT' END",
    "character_count": "'CONSISTENT'",
    "word_count": "CASE WHEN i_words <> words THEN 'WARNING' ELSE 'CONSISTENT' END",
    "block_count": "CASE WHEN abs(i_blocks - blocks) > 10 THEN 'WARNING' ELSE 'CONSISTENT' END",
    "image_count": "CASE WHEN i_images <> images THEN 'CONTRADICTION' ELSE 'CONSISTENT' END",
    "drawing_count": "CASE WHEN i_drawings <> drawings THEN 'CONTRADICTION' ELSE 'CONSISTENT' END",
    "vector_class": "CASE WHEN vector_complexity <> CASE WHEN i_drawings < 100 THEN 'LOW' WHEN i_drawings < 500 THEN 'MEDIUM' WHEN i_drawings < 2000 THEN 'HIGH' ELSE 'EXTREME' END THEN 'CONTRADICTION' ELSE 'CONSISTENT' END",
    "image_class": "CASE WHEN image_complexity <> CASE WHEN i_images = 0 THEN 'NONE' WHEN i_images <= 3 THEN 'LOW' WHEN i_images <= 5 THEN 'MEDIUM' ELSE 'HIGH' END THEN 'CONTRADICTION' ELSE 'CONSISTENT' END",
}


@query(f"""WITH {_PAGE_METRICS}, i AS (SELECT page_number AS p, words + CASE WHEN page_number % 5 = 0 THEN 1 ELSE 0 END AS i_words, images + CASE WHEN page_number % 7 = 0 THEN 1 ELSE 0 END AS i_images,
  drawings + CASE WHEN page_number % 13 = 0 THEN 100 ELSE 0 END AS i_drawings, blocks + page_number % 21 AS i_blocks, characters AS i_characters FROM c WHERE page_number % 11 <> 0)
, s AS (SELECT *, CASE WHEN i_characters = 0 AND i_images = 0 THEN 'EMPTY' WHEN i_characters = 0 THEN 'IMAGE_ONLY' WHEN i_images > 0 THEN 'MIXED_TEXT_IMAGE' ELSE 'TEXT_ONLY' END AS i_state FROM c LEFT JOIN i ON p = page_number)
, k AS (SELECT page_number, p, {", ".join(f"{v} AS {n}" for n, v in _CHECKS.items())} FROM s)
SELECT page_number, {", ".join(f"CASE WHEN p IS NOT NULL THEN {n} END AS {n}" for n in _CHECKS)}, CASE WHEN p IS NULL OR 'CONTRADICTION' IN ({", ".join(_CHECKS)}) THEN 'CONTRADICTION' ELSE 'OTHER' END AS kind FROM k""")
def reconcile(spark, d):
    own = _page_metrics(spark, d)
    n = F.col("page_number")
    changed = {"words": (n % 5 == 0).cast("int"), "images": (n % 7 == 0).cast("int"), "drawings": (n % 13 == 0).cast("int") * 100, "blocks": n % 21}
    other = own.filter(n % 11 != 0).withColumns({c: F.col(c) + more for c, more in changed.items()})
    found = pages.reconcile(pages.classify(own), other)
    return found.select("page_number", *_CHECKS, F.when(F.col("overall_status") == "CONTRADICTION", "CONTRADICTION").otherwise("OTHER").alias("kind"))


@query("""
SELECT s_suppkey AS rect_id, count(*) AS spans FROM supplier JOIN lineitem ON l_linenumber = s_suppkey % 7 + 1 AND l_quantity >= s_suppkey % 50 AND l_tax * 1000 >= s_suppkey % 80 AND l_quantity + 1 <= s_suppkey % 50 + 5 AND l_tax * 1000 + 1 <= s_suppkey % 80 + 10 GROUP BY 1
""")
def rect_containment(spark, d):
    x, y = F.col("l_quantity"), F.col("l_tax") * 1000
    spans = table(spark, d, "lineitem").select(F.col("l_linenumber").cast("long").alias("page_number"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("span_id"), x.alias("x0"), y.alias("y0"), (x + 1).alias("x1"), (y + 1).alias("y1"))
    k = F.col("s_suppkey")
    rects = table(spark, d, "supplier").select((k % 7 + 1).alias("page_number"), k.alias("rect_id"), (k % 50).cast("double").alias("x0"), (k % 80).cast("double").alias("y0"), (k % 50 + 5).cast("double").alias("x1"), (k % 80 + 10).cast("double").alias("y1"))
    return pages.contained_counts(spans, rects)


@query(r"""
SELECT page_id, CAST(length(t) AS BIGINT) AS characters, sha256(t) AS text_sha256 FROM (SELECT page_id, trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) AS t FROM pages)
""")
def html_clean(spark, d):
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", " "), r"[ \t\n\r]+", " "))
    return table(spark, d, "pages").select("page_id", plain.alias("t")).select("page_id", F.length("t").cast("long").alias("characters"), F.sha2("t", 256).alias("text_sha256"))


@query(r"""
SELECT conv_id, turn, trim(regexp_replace(lower(text), '[^a-z0-9"''./+\-]+', ' ', 'g')) AS search, len(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9"''./+\-]+', ' ', 'g')), ' '), lambda t: t <> '')) AS tokens FROM conversations
""")
def normalise_text(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.norm_search("text").alias("search"), F.size(tx.search_tokens("text")).cast("long").alias("tokens"))


@query(r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), c AS (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS one,
  trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t]+', ' ', 'g'), '\n[ \t]+', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10)) AS chunk FROM t)
SELECT doc_id, sha256(lower(one)) AS parser_sha256, sha256(lower(one)) AS query_sha256, sha256(chunk) AS chunk_sha256, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS words,
  chunk = '' OR (length(chunk) <= 8 AND len(regexp_extract_all(chunk, '[A-Za-z]')) <= 3) AS noise, regexp_matches(chunk, '(?i)^(Page\s+\d+\s+of\s+\d+|Rev\.?\s*No\.?\s*\d+|TC\s*\d+)$') AS label
FROM c
""")
def document_text_rules(spark, d):
    own = spread(table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    digest = lambda c: F.sha2(c, 256)
    return own.select("doc_id", digest(tx.norm_parser("text")).alias("parser_sha256"), digest(tx.norm_query("text")).alias("query_sha256"), digest(tx.clean_chunk("text")).alias("chunk_sha256"), tx.count_words("text").cast("long").alias("words"), tx.layout_noise("text").alias("noise"), tx.page_label("text").alias("label"))


@query(f"""WITH {_PAGE_METRICS}, given AS (SELECT page_number AS p, CASE WHEN page_number % 3 = 0 THEN 'MIXED_TEXT_IMAGE' ELSE page_state END AS g_state, CASE WHEN page_number % 4 = 0 THEN 'LOW' ELSE text_complexity END AS g_text FROM c WHERE page_number % 10 <> 0)
SELECT page_number, 'page' AS field, 'present' AS expected, 'missing' AS actual FROM c WHERE page_number % 10 = 0
UNION ALL SELECT page_number, 'page_state', page_state, g_state FROM c JOIN given ON p = page_number AND g_state <> page_state
UNION ALL SELECT page_number, 'text_complexity', text_complexity, g_text FROM c JOIN given ON p = page_number AND g_text <> text_complexity""")
def page_rederive(spark, d):
    own = _page_metrics(spark, d)
    n = F.col("page_number")
    given = pages.classify(own).filter(n % 10 != 0)
    given = given.withColumn("page_state", F.when(n % 3 == 0, "MIXED_TEXT_IMAGE").otherwise(F.col("page_state"))).withColumn("text_complexity", F.when(n % 4 == 0, "LOW").otherwise(F.col("text_complexity")))
    return pages.rederive(own, given)


@query("""
WITH p AS (SELECT DISTINCT string_split(p_name, ' ')[2] AS parent, string_split(p_name, ' ')[1] AS child FROM part)
SELECT 'parameter' AS kind, parent AS value, CAST(NULL AS VARCHAR) AS parent, 1 AS n_tokens FROM (SELECT DISTINCT parent FROM p) UNION ALL SELECT 'sub_parameter', child, parent, 1 FROM p
UNION ALL SELECT 'section', p_type, NULL, CAST(len(string_split(p_type, ' ')) AS INTEGER) FROM (SELECT DISTINCT p_type FROM part) UNION ALL SELECT 'side', unnest(['inlet', 'outlet']), NULL, 1
""")
def schema_terms(spark, d):
    return catalog.schema_terms(_part_records(spark, d)).select("kind", "value", "parent", F.col("n_tokens").cast("int").alias("n_tokens"))


@query("""
WITH q AS (SELECT p_partkey AS query_id, string_split(p_name, ' ')[1] AS w1, string_split(p_name, ' ')[2] AS w2 FROM part), h AS (SELECT DISTINCT string_split(p_name, ' ')[2] AS parent, string_split(p_name, ' ')[1] AS child FROM part)
, direct AS (SELECT query_id, w1, w2, greatest(CASE WHEN w1 IN (SELECT parent FROM h) THEN length(w1) ELSE 0 END, CASE WHEN w2 IN (SELECT parent FROM h) THEN length(w2) ELSE 0 END) AS longest FROM q)
, named AS (SELECT *, CASE WHEN longest > 0 THEN (SELECT min(x) FROM (SELECT unnest([w1, w2]) AS x) WHERE length(x) = longest AND x IN (SELECT parent FROM h)) END AS parameter FROM direct)
, hits AS (SELECT query_id, parent, child, row_number() OVER (PARTITION BY query_id ORDER BY length(child) DESC, parent, child) AS k FROM named JOIN h ON child IN (w1, w2) AND (parameter IS NULL OR parameter = parent))
SELECT query_id, coalesce(parameter, parent) AS parameter, child AS sub_parameter FROM named LEFT JOIN hits USING (query_id) WHERE coalesce(k, 1) = 1
""")
def schema_resolution(spark, d):
    own = _part_records(spark, d)
    terms = cut(catalog.schema_terms(own), "terms")
    asked = table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("what is "), F.element_at(F.split("p_name", " "), 1), F.lit(" of "), F.element_at(F.split("p_name", " "), 2)).alias("query"))
    none = spark.createDataFrame([], "norm string, parameter string")
    found = questions.understand(asked, terms, none.select("norm"), none, none.select("parameter"), repair=False)
    return found.select("query_id", "parameter", "sub_parameter")


def _clean_sql(text: str) -> str:
    plain = f"replace(replace(replace({text}, chr(160), ' '), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    lines = f"regexp_replace(regexp_replace(regexp_replace({plain}, '[ \\t]+', ' ', 'g'), '\\n[ \\t]+', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace({lines}, '^[\\s\\pZ\\x0B\\x85]+|[\\s\\pZ\\x0B\\x85]+$', '', 'g')"


def _packed_sql(parts: str, separator: str) -> str:
    """Texts joined greedily up to 1800 characters; the ones that are full are parted by a control character."""
    return f"string_split(list_reduce({parts}, lambda a, x: a || CASE WHEN length(split_part(a, chr(30), -1)) + length({separator}) + length(x) > 1800 THEN chr(30) ELSE {separator} END || x), chr(30))"


@query(rf"""
WITH d AS (SELECT doc_id, {_clean_sql("coalesce(text, '')")} AS t FROM documents)
, paragraphs AS (SELECT doc_id, t, list_filter(list_transform(string_split_regex(t, '\n\s*\n'), lambda p: {_clean_sql("p")}), lambda p: p <> '') AS ps FROM d WHERE t <> '')
, pieces AS (SELECT doc_id, CASE WHEN length(t) <= 1800 THEN [t] ELSE {_packed_sql("ps", "(chr(10) || chr(10))")} END AS xs FROM paragraphs)
, one AS (SELECT doc_id, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM pieces)
, chunks AS (SELECT doc_id, i, CASE WHEN length(x) <= 1800 THEN [x] ELSE {_packed_sql("string_split(regexp_replace(x, '([.!?])[\\x09-\\x0D ]+', '\\1' || chr(31), 'g'), chr(31))", "' '")} END AS cs FROM one)
, listed AS (SELECT doc_id, i, unnest(cs) AS content, generate_subscripts(cs, 1) AS j FROM chunks)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS part, length(content) AS characters, sha256(content) AS content_sha256 FROM listed
""".replace("\\\\", "\\"))
def chunk_pack(spark, d):
    own = spread(table(spark, d, "documents")).select("doc_id", "text")
    own = layout.with_chunks(own, "text", "chunks").select("doc_id", F.posexplode_outer("chunks").alias("part", "content")).filter("part IS NOT NULL")
    return own.select("doc_id", F.col("part").cast("long").alias("part"), F.length("content").cast("long").alias("characters"), F.sha2("content", 256).alias("content_sha256"))


_INTENTS = _SPLIT.replace("conv_id, turn", "item_id").replace("FROM conversations", "FROM benchmark")


@query(f"""
WITH intents AS ({_INTENTS}), {bm25_sql("SELECT item_id || '#' || intent_index AS query_id, intent AS text FROM intents", 5)}
, own AS (SELECT item_id, intent_index, b.doc_id, rank AS r, row_number() OVER (PARTITION BY item_id, b.doc_id ORDER BY intent_index, rank) AS seen FROM bm25 b JOIN intents i ON b.query_id = i.item_id || '#' || i.intent_index)
SELECT item_id AS query_id, CAST(doc_id AS VARCHAR) AS record_id, CAST(intent_index AS BIGINT) AS intent_index, row_number() OVER (PARTITION BY item_id ORDER BY intent_index, r) AS rank FROM own WHERE seen = 1
""")
def multi_intent_search(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("_q"), F.col("text").alias("query"))
    intents = questions.split_intents(asked.withColumn("query_id", F.col("_q"))).withColumn("query_id", F.concat_ws("#", F.col("_q").cast("string"), "intent_index")).withColumn("terms", tx.search_tokens("intent"))
    hits = inverted.bm25(inverted.bm25_index(_documents(spark, d), tx.search_tokens("text")), intents, 5)
    own = hits.join(intents.select("query_id", "_q", "intent_index"), "query_id").select(F.col("_q").alias("query_id"), "intent_index", "record_id", F.col("rank").alias("hybrid_rank"))
    return retrieve.multi_intent(own, None).select("query_id", "record_id", F.col("intent_index").cast("long").alias("intent_index"), F.col("rank").cast("long").alias("rank"))


@query("""
WITH r AS (SELECT p_partkey, p_brand, CASE p_partkey % 3 WHEN 0 THEN 'line size' WHEN 1 THEN 'flow' ELSE 'material code' END AS parameter FROM part)
, q AS (SELECT DISTINCT p_brand, CAST(substr(p_brand, 7) AS BIGINT) AS query_id FROM part)
, i AS (SELECT query_id, p_brand, unnest([0, 1, 2]) AS k, unnest(['line size', 'flow', 'unknown thing of ' || p_brand]) AS intent FROM q)
, hits AS (SELECT p_brand, parameter, p_partkey, row_number() OVER (PARTITION BY p_brand, parameter ORDER BY p_partkey) AS rank FROM r QUALIFY rank <= 10)
SELECT query_id, CAST(k AS BIGINT) AS intent_index, intent, CAST(p_partkey AS VARCHAR) AS record_id, rank FROM i LEFT JOIN hits ON hits.p_brand = i.p_brand AND hits.parameter = i.intent
""")
def structured_multi_intent(spark, d):
    part = table(spark, d, "part")
    named = F.when(F.col("p_partkey") % 3 == 0, "Line Size").when(F.col("p_partkey") % 3 == 1, "Flow").otherwise("Material Code")
    none = [_null().alias(c) for c in ("section", "subsection", "sub_parameter", "side")]
    own = part.select(F.col("p_partkey").cast("string").alias("record_id"), F.col("p_partkey").alias("ord"), F.col("p_brand").alias("item"), named.alias("parameter"), *none)
    asked = part.select("p_brand").distinct().select(F.substring("p_brand", 7, 2).cast("long").alias("query_id"), F.concat(F.lit("Show me line size and flow, unknown thing of "), F.col("p_brand"), F.lit("?")).alias("query"))
    found = questions.structured_multi_intent(own, asked)
    return found.select("query_id", F.col("intent_index").cast("long").alias("intent_index"), "intent", "record_id", F.col("rank").cast("long").alias("rank"))
