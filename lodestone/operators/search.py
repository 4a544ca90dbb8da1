"""Search and name resolution: vectors, text fallbacks, symbols, and entity lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import vocab
from lodestone.functions import columns as C

KEYS = vocab.KEYS


def vector_top_k(vectors: DataFrame, query: list[float], k: int = 10,
                 entity_types: list[str] | None = None) -> DataFrame:
    """The k units nearest to ``query`` by cosine; similarity clamped to 0..1, three decimals.

    Plans as TakeOrderedAndProject: each task keeps k rows, nothing is sorted globally.
    """
    kept = vectors if not entity_types else vectors.where(F.col("entity_type").isin(entity_types))
    target = F.array(*[F.lit(float(x)) for x in query])
    scored = kept.withColumn("cosine", C.cosine_similarity(F.col("embedding"), target)).drop("embedding")
    best = scored.orderBy(F.col("cosine").desc_nulls_last(), "entity_id").limit(k)
    clamp = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("cosine")))
    return best.withColumn("similarity", F.round(clamp, 3))


def text_matches(units: DataFrame, query: str, entity_types: list[str] | None = None) -> DataFrame:
    """Units whose id or text contains the query, letter case ignored; fixed similarity."""
    kept = units if not entity_types else units.where(F.col("entity_type").isin(entity_types))
    needle = F.lit(query.lower())
    hit = F.contains(F.lower("entity_id"), needle) | F.contains(F.lower("source_text"), needle)
    return kept.where(hit).withColumn("similarity", F.lit(0.85))


def graph_matches(nodes: DataFrame, query: str) -> DataFrame:
    """Graph nodes by name, as a last search fallback; fixed similarity."""
    return symbol_matches(nodes, query).withColumn("similarity", F.lit(0.88))


def symbol_matches(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes with the query inside qualified name, name, path or label; repositories excluded."""
    needle = F.lit(query.lower())
    hit = None
    for field in ("qualified_name", "name", "path", "label"):
        found = F.contains(F.lower(F.coalesce(F.col(field), F.lit(""))), needle)
        hit = found if hit is None else hit | found
    return nodes.where((F.col("label") != "Repository") & hit)


def semantic_search(vectors: DataFrame, units: DataFrame, nodes: DataFrame, query: str, vector: list[float] | None,
                    k: int = 10) -> DataFrame:
    """Vector search, or the text fallbacks when there is no usable query vector.

    The text fallback wins if it finds anything; one probing action decides, as it must.
    """
    if vector and any(vector):
        return vector_top_k(vectors, vector, k)
    by_text = text_matches(units, query).orderBy("entity_id").limit(k)
    if not by_text.isEmpty():
        return by_text
    return graph_matches(nodes, query).orderBy("id").limit(k)


def display_node(nodes: DataFrame) -> DataFrame:
    """Node plus its display label: name, else path, else qualified name."""
    return nodes.withColumn("display_label", F.coalesce("name", "path", "qualified_name", F.lit("Unnamed")))


# ------------------------------------------------------------------------ entity lookup

def simple_name(qualified: Column) -> Column:
    return C.last_segment(qualified, (".", "::", "/"))


def endpoint_id(query: Column) -> Column:
    """``post api/x`` -> ``endpoint:POST:/api/x``; NULL when it is not a verb and a path."""
    verbs = "|".join(vocab.HTTP_VERBS)
    pattern = rf"(?is)^({verbs})\s+(\S.*)$"
    verb, path = F.upper(F.regexp_extract(query, pattern, 1)), F.trim(F.regexp_extract(query, pattern, 2))
    rooted = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))
    return F.when(verb != "", F.concat(F.lit("endpoint:"), verb, F.lit(":"), rooted))


def _clean_path(path: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+|/+$", ""))


def entity_candidates(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """Every (query, entity) match with its stage: 1 name, 2 endpoint, 3 short name, 4 path or module.

    All stages are equi-joins. A path matches by any suffix, so each path is cut to the lengths
    that occur among the queries and compared for equality.
    """
    q = queries.select(*KEYS, "query", F.trim("query").alias("clean")).where(F.col("clean") != "").distinct()
    e = entities.select(*KEYS, "qualified_name", "file_path", "module_name")

    def stage(number: int, left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right, ["key", *KEYS]).select(*KEYS, "query", F.lit(number).alias("stage"), "qualified_name")

    names = e.select(*KEYS, F.col("qualified_name").alias("key"), "qualified_name")
    exact = stage(1, q.withColumn("key", F.col("clean")), names)
    routes = stage(2, q.withColumn("key", endpoint_id(F.col("clean"))).where(F.col("key").isNotNull()), names)
    short = stage(3, q.withColumn("key", F.col("clean")),
                  e.select(*KEYS, simple_name(F.col("qualified_name")).alias("key"), "qualified_name"))

    paths = q.withColumn("key", _clean_path(F.col("clean"))).where(F.col("key") != "")
    lengths = paths.groupBy(*KEYS).agg(F.collect_set(F.length("key")).alias("lengths"))
    cut = (e.where(F.col("file_path").isNotNull()).withColumn("path", _clean_path(F.col("file_path")))
           .join(lengths, KEYS).withColumn("n", F.explode("lengths")).where(F.length("path") >= F.col("n"))
           .select(*KEYS, F.expr("right(path, n)").alias("key"), "qualified_name"))
    modules = (e.where(F.col("file_path").isNull() & F.col("module_name").isNotNull())
               .select(*KEYS, F.explode(C.dotted_suffixes(F.col("module_name"))).alias("key"), "qualified_name"))
    by_path = stage(4, paths, cut).unionByName(stage(4, q.withColumn("key", F.col("clean")), modules))
    return exact.unionByName(routes).unionByName(short).unionByName(by_path).distinct()


def resolve_entities(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """Per query: resolved, ambiguous or not_found, decided by the first stage with a match.

    Ambiguous candidates are counted here; ``entity_candidates`` lists them as rows.
    """
    per_stage = entity_candidates(queries, entities).groupBy(*KEYS, "query", "stage").agg(
        F.count(F.lit(1)).alias("n"), F.min("qualified_name").alias("name"))
    first = per_stage.groupBy(*KEYS, "query").agg(
        F.min("stage").alias("stage"), F.min_by(F.struct("n", "name"), "stage").alias("best"))
    joined = queries.select(*KEYS, "query").distinct().join(first, ["query", *KEYS], "left")
    n = F.coalesce("best.n", F.lit(0).cast("bigint"))
    status = F.when(n == 0, "not_found").when(n == 1, "resolved").otherwise("ambiguous")
    message = (
        F.when(F.trim("query") == "", "Empty query string provided.")
        .when(n == 0, F.concat(F.lit("Entity '"), F.trim("query"), F.lit("' not found in snapshot '"),
                               F.col(vocab.SNAP), F.lit("' of repository '"), F.col(vocab.REPO), F.lit("'.")))
        .when(n > 1, F.concat(F.lit("Ambiguous query '"), F.trim("query"), F.lit("' matched "), n.cast("string"),
                              F.lit(" candidates.")))
        .when(F.col("stage") == 1, F.concat(F.lit("Exact match found for '"), F.trim("query"), F.lit("'.")))
        .when(F.col("stage") == 2, F.concat(F.lit("Exact HTTP endpoint match found for '"), "best.name", F.lit("'.")))
        .otherwise(F.concat(F.lit("Unambiguous match for '"), F.trim("query"), F.lit("' -> '"), "best.name",
                            F.lit("'."))))
    return joined.select(*KEYS, "query", status.alias("status"), n.alias("match_count"),
                         F.when(n == 1, F.col("best.name")).alias("qualified_name"), message.alias("message"))


# ----------------------------------------------------------------------- semantic units

def _lines(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def semantic_units(files: DataFrame, classes: DataFrame, methods: DataFrame, functions: DataFrame) -> DataFrame:
    """Text units for the embedder: one per module, class, method and function.

    files: path, module_name, docstring; classes: + qualified_name, name, base_classes,
    method_names; methods: + class_name; functions: qualified_name, name.
    """
    def doc(kind: str) -> Column:
        text = F.when(F.coalesce("docstring", F.lit("")) != "", F.col("docstring"))
        return _lines("Docstring:\n", F.coalesce(text, F.lit(f"No {kind} docstring provided.")))

    module = F.coalesce("module_name", "path")

    def place(df: DataFrame, entity_type: str, entity: Column, text: Column) -> DataFrame:
        return df.select(*KEYS, entity.alias("entity_id"), F.lit(entity_type).alias("entity_type"),
                         F.col("path").alias("file_path"), text.alias("source_text"))

    where = _lines("Module: ", module, "\nFile: ", F.col("path"), "\n")
    bases = F.when(F.size("base_classes") > 0, _lines("Inherits from: ", F.array_join("base_classes", ", "))
                   ).otherwise("No base classes.")
    names = F.when(F.size("method_names") > 0, _lines("Methods: ", F.array_join("method_names", ", "))
                   ).otherwise("No methods.")
    return (
        place(files, "Module", module, _lines(where, "\n", doc("module")))
        .unionByName(place(classes, "Class", F.col("qualified_name"), _lines(
            "Class: ", F.col("name"), "\n", where, bases, "\n", names, "\n\n", doc("class"))))
        .unionByName(place(methods, "Method", F.col("qualified_name"), _lines(
            "Method: ", F.col("name"), "\nClass: ", F.col("class_name"), "\n", where, "\n", doc("method"))))
        .unionByName(place(functions, "Function", F.col("qualified_name"), _lines(
            "Function: ", F.col("name"), "\n", where, "\n", doc("function")))))
