"""Search, name resolution, semantic units and route queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import columns as C
from lodestone.operators import search as SE
from lodestone.queries import sql as S
from lodestone.sources import warehouse as W

KEYS = ["repository_id", "snapshot_id"]


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return W.table(spark, sf, "embeddings").select(
        *W.keys("vec_id"), F.format_string("%08d", "vec_id").alias("entity_id"),
        F.when(F.col("label") % 2 == 0, "Function").otherwise("Class").alias("entity_type"), "embedding")


def vector_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest units to the vector of unit 0, classes left out."""
    query = W.table(spark, sf, "embeddings").where(F.col("vec_id") == 0).select("embedding").first()[0]
    out = SE.vector_top_k(_vectors(spark, sf), query, 10, ["Function"])
    return out.select("entity_id", "entity_type", F.round("cosine", 6).alias("cosine"), "similarity")


VECTOR_TOP_K = """WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0),
 s AS (SELECT printf('%08d', vec_id) AS entity_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT v FROM q)) AS c FROM embeddings WHERE label % 2 = 0)
SELECT entity_id, 'Function' AS entity_type, round(c, 6) AS cosine, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, c)), 3) AS similarity FROM s ORDER BY c DESC, entity_id LIMIT 10"""


def cosine_by_label(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity of every unit to unit 1, summarised per label."""
    query = W.table(spark, sf, "embeddings").where(F.col("vec_id") == 1).select("embedding").first()[0]
    target = F.array(*[F.lit(float(x)) for x in query])
    scored = W.table(spark, sf, "embeddings").select("label", C.cosine_similarity(F.col("embedding"), target).alias("c"))
    return scored.groupBy("label").agg(F.count(F.lit(1)).alias("units"), F.round(F.max("c"), 6).alias("best"),
                                       F.round(F.avg("c"), 6).alias("mean"))


COSINE_BY_LABEL = """WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 1)
SELECT label, count(*) AS units, round(max(c), 6) AS best, round(avg(c), 6) AS mean FROM
 (SELECT label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT v FROM q)) AS c FROM embeddings) GROUP BY 1"""


def text_search(spark: SparkSession, sf: str) -> DataFrame:
    units = W.table(spark, sf, "documents").select(
        *W.keys("doc_id"), F.concat(F.col("source"), F.lit("."), F.col("doc_id").cast("string")).alias("entity_id"),
        F.col("lang").alias("entity_type"), F.col("text").alias("source_text"))
    return SE.text_matches(units, "LICENSE", ["en", "de"]).select("entity_id", "entity_type", "similarity")


TEXT_SEARCH = """SELECT concat(source, '.', doc_id) AS entity_id, lang AS entity_type, 0.85::DOUBLE AS similarity FROM documents
 WHERE lang IN ('en', 'de') AND (contains(lower(concat(source, '.', doc_id)), 'license') OR contains(lower(text), 'license'))"""


def _symbols(spark: SparkSession, sf: str) -> DataFrame:
    part = W.table(spark, sf, "part").select(
        *W.keys("p_partkey"), W.module_name(F.col("p_partkey")).alias("qualified_name"), F.col("p_name").alias("name"),
        W.module_path(F.col("p_partkey")).alias("path"),
        F.when(F.col("p_type") == "PROMO", "Repository").otherwise(F.col("p_type")).alias("label"))
    return part


def symbol_search(spark: SparkSession, sf: str) -> DataFrame:
    return SE.symbol_matches(_symbols(spark, sf), "GEAR").select("qualified_name", "name", "label")


SYMBOL_SEARCH = f"""SELECT {S.module('p_partkey')} AS qualified_name, p_name AS name, p_type AS label FROM part
 WHERE p_type <> 'PROMO' AND contains(lower(p_name), 'gear')"""


def display_labels(spark: SparkSession, sf: str) -> DataFrame:
    nodes = _symbols(spark, sf).withColumn("name", F.when(F.col("label") == "SMALL", F.col("name")))
    out = SE.display_node(nodes.withColumn("path", F.when(F.col("label") != "LARGE", F.col("path"))))
    return out.select("qualified_name", "display_label")


DISPLAY_LABELS = f"""SELECT {S.module('p_partkey')} AS qualified_name, CASE p_type WHEN 'SMALL' THEN p_name WHEN 'LARGE' THEN {S.module('p_partkey')}
 ELSE {S.path('p_partkey')} END AS display_label FROM part"""


def entity_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Every supplier asks four ways: full name, endpoint, short name, and file suffix."""
    part = W.table(spark, sf, "part").select(
        *W.keys("p_partkey"), W.module_name(F.col("p_partkey")).alias("qualified_name"),
        W.module_path(F.col("p_partkey")).alias("file_path"), F.lit(None).cast("string").alias("module_name"))
    nation = W.table(spark, sf, "nation").select(
        *W.keys("n_nationkey"), W.ident("endpoint:GET:/nations", "n_nationkey").alias("qualified_name"),
        F.lit(None).cast("string").alias("file_path"),
        F.concat(F.lit("geo."), F.lower("n_name")).alias("module_name"))
    key = F.col("s_suppkey")
    asked = F.array(W.module_name(key), F.concat(F.lit("get nations:"), F.col("s_nationkey").cast("string")),
                    F.concat(F.lit("f"), key.cast("string")), F.concat(F.lit("/f"), key.cast("string"), F.lit(".py")),
                    F.concat(F.lit("nation_"), F.col("s_nationkey").cast("string")), F.concat(F.lit("absent"), key.cast("string")))
    queries = W.table(spark, sf, "supplier").select(*W.keys("s_suppkey"), F.explode(asked).alias("query")).distinct()
    return SE.resolve_entities(queries, part.unionByName(nation)).select("query", "status", "match_count", "qualified_name")


ENTITY_RESOLUTION = f"""WITH ents AS (SELECT {S.module('p_partkey')} AS q, {S.path('p_partkey')} AS fp, NULL AS mn, concat('f', CAST(p_partkey AS VARCHAR)) AS sn FROM part
  UNION ALL SELECT {S.ident('endpoint:GET:/nations','n_nationkey')}, NULL, concat('geo.', lower(n_name)), {S.ident('nations','n_nationkey')} FROM nation),
 asked AS (SELECT DISTINCT unnest([{S.module('s_suppkey')}, concat('get nations:', s_nationkey), concat('f', s_suppkey), concat('/f', s_suppkey, '.py'), concat('nation_', s_nationkey), concat('absent', s_suppkey)]) AS query FROM supplier),
 c AS (SELECT query, 1 AS st, q FROM asked JOIN ents ON q = query
  UNION ALL SELECT query, 2, q FROM asked JOIN ents ON starts_with(query, 'get ') AND q = concat('endpoint:GET:/', query[5:])
  UNION ALL SELECT query, 3, q FROM asked JOIN ents ON sn = query
  UNION ALL SELECT query, 4, q FROM asked JOIN ents ON CASE WHEN fp IS NOT NULL THEN ends_with(fp, trim(query, '/')) ELSE mn = query OR ends_with(mn, concat('.', query)) END),
 g AS (SELECT query, st, count(*) AS n, min(q) AS q FROM c GROUP BY 1, 2),
 f AS (SELECT query, arg_min(n, st) AS n, arg_min(q, st) AS q FROM g GROUP BY 1)
SELECT query, CASE WHEN n IS NULL THEN 'not_found' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, coalesce(n, 0) AS match_count, CASE WHEN n = 1 THEN q END AS qualified_name
FROM asked LEFT JOIN f USING (query)"""


def semantic_units(spark: SparkSession, sf: str) -> DataFrame:
    """Nations are modules, parts classes whose name words are methods, suppliers functions."""
    files = W.table(spark, sf, "nation").select(
        *W.keys("n_nationkey"), F.col("n_nationkey").alias("k"), F.concat(F.lit("geo/"), F.lower("n_name"), F.lit(".py")).alias("path"),
        F.lower("n_name").alias("module_name"),
        F.when(F.col("n_regionkey") > 0, F.concat(F.lit("Region "), F.col("n_regionkey").cast("string"))).alias("docstring"))
    key = F.col("p_partkey")
    classes = W.table(spark, sf, "part").select(
        *W.keys("p_partkey"), W.module_path(key).alias("path"), W.module_name(key).alias("module_name"), F.col("p_name").alias("name"),
        W.ident("part", "p_partkey").alias("qualified_name"), "p_brand",
        F.when(F.col("p_size") > 25, F.array("p_type", "p_brand")).otherwise(F.array().cast("array<string>")).alias("base_classes"),
        F.split("p_name", " ").alias("method_names"), F.lit(None).cast("string").alias("docstring"))
    methods = classes.select(*KEYS, "path", "module_name", F.col("name").alias("class_name"), F.explode("method_names").alias("name"),
                             "qualified_name", F.col("p_brand").alias("docstring"))
    place = files.drop("docstring")
    functions = W.table(spark, sf, "supplier").withColumnRenamed("s_nationkey", "k").join(place, "k").select(
        *KEYS, "path", "module_name", F.col("s_name").alias("name"), W.ident("supplier", "s_suppkey").alias("qualified_name"),
        F.lit("").alias("docstring"))
    return SE.semantic_units(files, classes, methods, functions).drop(*KEYS)


SEMANTIC_UNITS = f"""WITH f AS (SELECT n_nationkey AS k, concat('geo/', lower(n_name), '.py') AS path, lower(n_name) AS m, CASE WHEN n_regionkey > 0 THEN concat('Region ', n_regionkey) END AS doc,
   concat('Module: ', lower(n_name), chr(10), 'File: geo/', lower(n_name), '.py', chr(10)) AS w FROM nation),
 p AS (SELECT *, {S.path('p_partkey')} AS path, concat('Module: ', {S.module('p_partkey')}, chr(10), 'File: ', {S.path('p_partkey')}, chr(10)) AS w FROM part)
SELECT m AS entity_id, 'Module' AS entity_type, path AS file_path, concat(w, chr(10), 'Docstring:', chr(10), coalesce(doc, 'No module docstring provided.')) AS source_text FROM f
UNION ALL SELECT {S.ident('part','p_partkey')}, 'Class', path, concat('Class: ', p_name, chr(10), w, CASE WHEN p_size > 25 THEN concat('Inherits from: ', p_type, ', ', p_brand) ELSE 'No base classes.' END, chr(10),
  'Methods: ', replace(p_name, ' ', ', '), chr(10), chr(10), 'Docstring:', chr(10), 'No class docstring provided.') FROM p
UNION ALL SELECT {S.ident('part','p_partkey')}, 'Method', path, concat('Method: ', word, chr(10), 'Class: ', p_name, chr(10), w, chr(10), 'Docstring:', chr(10), p_brand) FROM (SELECT *, unnest(string_split(p_name, ' ')) AS word FROM p)
UNION ALL SELECT {S.ident('supplier','s_suppkey')}, 'Function', path, concat('Function: ', s_name, chr(10), w, chr(10), 'Docstring:', chr(10), 'No function docstring provided.') FROM supplier JOIN f ON k = s_nationkey"""


# ------------------------------------------------------------------------------- routes

def _page_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Path of every page with its numeric last segment written as a route parameter."""
    path = F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1)
    return W.table(spark, sf, "pages").select(
        "page_id", path.alias("path"), F.regexp_replace(path, r"/([0-9]+)(\.html)?(/?)$", "//:id$2$3").alias("template"))


def route_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return _page_paths(spark, sf).select("page_id", C.http_path(F.col("path")).alias("path"),
                                         C.http_path_key(F.col("template")).alias("route_key"))


_PAGES = r"""pp AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS p FROM pages),
 pt AS (SELECT page_id, p, CASE WHEN length(p) > 1 THEN regexp_replace(p, '/$', '') ELSE p END AS np, regexp_replace(regexp_replace(p, '/([0-9]+)(\.html)?(/?)$', '/{_}\2\3'), '(.)/$', '\1') AS k FROM pp)"""
ROUTE_NORMALIZE = f"WITH {_PAGES} SELECT page_id, np AS path, k AS route_key FROM pt"


def route_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Pages per route key, with the keys that name exactly one page."""
    keyed = _page_paths(spark, sf).select("page_id", C.http_path_key(F.col("path")).alias("route_key"))
    return keyed.groupBy("route_key").agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first_page")).withColumn(
        "unique_route", F.col("pages") == 1)


ROUTE_GROUPS = f"WITH {_PAGES} SELECT np AS route_key, count(*) AS pages, min(page_id) AS first_page, count(*) = 1 AS unique_route FROM pt GROUP BY 1"

QUERIES = {
    "vector_top_k": (vector_top_k, VECTOR_TOP_K),
    "cosine_by_label": (cosine_by_label, COSINE_BY_LABEL),
    "text_search": (text_search, TEXT_SEARCH),
    "symbol_search": (symbol_search, SYMBOL_SEARCH),
    "display_labels": (display_labels, DISPLAY_LABELS),
    "entity_resolution": (entity_resolution, ENTITY_RESOLUTION),
    "semantic_units": (semantic_units, SEMANTIC_UNITS),
    "route_normalize": (route_normalize, ROUTE_NORMALIZE),
    "route_groups": (route_groups, ROUTE_GROUPS),
}
