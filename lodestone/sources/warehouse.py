"""Domain tables read off a star-schema warehouse, so every operator can run over large tables.

Orders stand in for commits, line items for changed files and for edges between modules, parts
for functions and modules; the foreign keys of the schema form a second, acyclic graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import columns as C
from lodestone.session import small_frame

REPOSITORY = "shop"
HEAD = "head"

# How warehouse attributes read as architecture attributes.
RELATIONSHIP_OF_LINE = {1: "CALLS", 2: "DEPENDS_ON", 3: "IMPORTS", 4: "REQUESTS", 5: "HANDLED_BY",
                        6: "INHERITS", 7: "IMPLEMENTS"}
ROLE_OF_TYPE = {"STANDARD": "component", "ECONOMY": "service", "MEDIUM": "domain", "SMALL": "repository",
                "LARGE": "client"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keys(row_key: str, snapshot: Column | str = HEAD) -> list[Column]:
    """Repository and snapshot as real columns, as in stored fact tables: the optimiser would drop
    a plain literal from join keys and turn joins on them into products."""
    present = F.col(row_key).isNotNull()
    snap = F.when(present, snapshot) if isinstance(snapshot, str) else snapshot
    return [F.when(present, REPOSITORY).alias("repository_id"), snap.alias("snapshot_id")]


def module_name(key: Column) -> Column:
    return F.concat(F.lit("src.m"), F.floor(key / 20).cast("string"), F.lit(".f"), key.cast("string"))


def module_path(key: Column) -> Column:
    return F.concat(F.lit("src/m"), F.floor(key / 20).cast("string"), F.lit("/f"), key.cast("string"), F.lit(".py"))


def function_name(key: Column) -> Column:
    return F.concat(module_name(key), F.lit(".run"), key.cast("string"))


def resolution_of(flag: Column) -> Column:
    return F.when(flag == "A", "exact").when(flag == "N", "inferred").otherwise("unresolved")


def relationship_of(line: Column) -> Column:
    column = None
    for number, name in RELATIONSHIP_OF_LINE.items():
        column = F.when(line == number, name) if column is None else column.when(line == number, name)
    return column


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        *keys("o_orderkey"), F.col("o_orderkey").cast("string").alias("commit_sha"),
        F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("author_name"),
        F.concat(F.col("o_custkey").cast("string"), F.lit("@shop")).alias("author_email"),
        F.col("o_orderdate").alias("committed_at"), F.col("o_orderpriority").alias("message"))


def file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        *keys("l_orderkey"), F.col("l_orderkey").cast("string").alias("commit_sha"),
        module_path(F.col("l_partkey")).alias("file_path"), F.col("l_returnflag").alias("change_type"),
        F.col("l_quantity").cast("int").alias("insertions"), F.col("l_linenumber").alias("deletions"))


def module_edges(spark: SparkSession, sf_dir: str, snapshot: Column | str = HEAD) -> DataFrame:
    """Part -> part edges: the line's part uses the part numbered like the line's supplier."""
    return table(spark, sf_dir, "lineitem").select(
        *keys("l_partkey", snapshot), module_name(F.col("l_partkey")).alias("source_id"),
        relationship_of(F.col("l_linenumber")).alias("relationship"),
        module_name(F.col("l_suppkey")).alias("target_id"),
        resolution_of(F.col("l_returnflag")).alias("resolution"))


def status_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same edges in two snapshots, F (baseline) and O (target)."""
    return module_edges(spark, sf_dir, F.col("l_linestatus"))


def status_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``status_edges`` by the numbers their names are made of, each once with the rank of its strongest confidence."""
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy("l_linestatus", "l_partkey", relationship_of(F.col("l_linenumber")).alias("relationship"), "l_suppkey").agg(
        F.min(C.confidence_rank(resolution_of(F.col("l_returnflag")))).alias("rank"))


def named_links(links: DataFrame) -> DataFrame:
    """Rows of ``status_links`` as edges between modules."""
    return links.select(
        *keys("l_partkey", F.col("l_linestatus")), module_name(F.col("l_partkey")).alias("source_id"), "relationship",
        module_name(F.col("l_suppkey")).alias("target_id"), C.confidence_label(F.col("rank")).alias("resolution"))


def pair(spark: SparkSession, baseline: str, target: str) -> DataFrame:
    return small_frame(spark, ["repository_id", "baseline_snapshot_id", "target_snapshot_id"], [(REPOSITORY, baseline, target)])


def status_pair(spark: SparkSession) -> DataFrame:
    return pair(spark, "F", "O")


def module_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(*keys("p_partkey"), module_name(F.col("p_partkey")).alias("id"), F.lit("Module").alias("label"),
                       F.lit(None).cast("int").alias("cyclomatic_complexity"))


def function_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(*keys("p_partkey"), module_name(F.col("p_partkey")).alias("id"), F.lit("Function").alias("label"),
                       F.col("p_size").alias("cyclomatic_complexity"))


def complexity_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complexity rows of one function per part, normalised by the catalogue's largest size."""
    part = table(spark, sf_dir, "part")
    sized = part.select(*keys("p_partkey"), function_name(F.col("p_partkey")).alias("entity_name"), "p_size")
    scaled = C.max_normalised(sized, "p_size", "metric_value", ["repository_id", "snapshot_id"])
    return scaled.select("repository_id", "snapshot_id", F.lit("Function").alias("entity_type"), "entity_name",
                         F.lit("normalized_complexity").alias("metric_name"), "metric_value",
                         F.lit("deterministic").alias("metric_source"))


def role_of_type(kind: Column) -> Column:
    column = None
    for name, role in ROLE_OF_TYPE.items():
        column = F.when(kind == name, role) if column is None else column.when(kind == name, role)
    return column.otherwise("unknown")


def _edge(df: DataFrame, source: Column, relationship: str, target: Column, resolution: Column) -> DataFrame:
    return df.select(*keys(df.columns[0]), source.alias("source_id"), F.lit(relationship).alias("relationship"),
                     target.alias("target_id"), resolution.alias("resolution"))


def ident(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def schema_graph(spark: SparkSession, sf_dir: str, supply: bool = True) -> DataFrame:
    """Foreign keys as edges: order -> customer -> nation -> region, order -> part -> supplier -> nation."""
    exact = F.lit("exact")
    status = (F.when(F.col("o_orderstatus") == "F", "exact").when(F.col("o_orderstatus") == "O", "inferred")
              .otherwise("unresolved"))
    line = table(spark, sf_dir, "lineitem")
    edges = (
        _edge(table(spark, sf_dir, "nation"), ident("nation", "n_nationkey"), "IMPORTS", ident("region", "n_regionkey"), exact)
        .unionByName(_edge(table(spark, sf_dir, "customer"), ident("customer", "c_custkey"), "CALLS",
                           ident("nation", "c_nationkey"), exact))
        .unionByName(_edge(table(spark, sf_dir, "supplier"), ident("supplier", "s_suppkey"), "CALLS",
                           ident("nation", "s_nationkey"), exact))
        .unionByName(_edge(table(spark, sf_dir, "orders"), ident("order", "o_orderkey"), "CALLS",
                           ident("customer", "o_custkey"), status))
        .unionByName(_edge(line, ident("order", "l_orderkey"), "REQUESTS", ident("part", "l_partkey"),
                           resolution_of(F.col("l_returnflag")))))
    if supply:
        edges = edges.unionByName(_edge(line, ident("part", "l_partkey"), "HANDLED_BY", ident("supplier", "l_suppkey"), exact))
    return edges


def trade_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions contain nations, nations contain customers and suppliers, customers call suppliers."""
    exact = F.lit("exact")
    bought = (table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
              .join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey",
                                                            "l_returnflag"), "o_orderkey"))
    return (
        _edge(table(spark, sf_dir, "nation"), ident("region", "n_regionkey"), "CONTAINS", ident("nation", "n_nationkey"), exact)
        .unionByName(_edge(table(spark, sf_dir, "customer"), ident("nation", "c_nationkey"), "CONTAINS",
                           ident("customer", "c_custkey"), exact))
        .unionByName(_edge(table(spark, sf_dir, "supplier"), ident("nation", "s_nationkey"), "CONTAINS",
                           ident("supplier", "s_suppkey"), exact))
        .unionByName(_edge(bought, ident("customer", "o_custkey"), "CALLS", ident("supplier", "l_suppkey"),
                           resolution_of(F.col("l_returnflag")))))


def trade_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def nodes(name: str, kind: str, key: str, label: str, title: str) -> DataFrame:
        return table(spark, sf_dir, name).select(*keys(key), ident(kind, key).alias("id"), F.lit(label).alias("label"),
                                                 F.col(title).alias("name"))

    return (nodes("region", "region", "r_regionkey", "File", "r_name")
            .unionByName(nodes("nation", "nation", "n_nationkey", "Class", "n_name"))
            .unionByName(nodes("customer", "customer", "c_custkey", "Function", "c_name"))
            .unionByName(nodes("supplier", "supplier", "s_suppkey", "Function", "s_name")))


def start_nodes(spark: SparkSession, *ids: str) -> DataFrame:
    """The entities a query was asked about."""
    return small_frame(spark, ["repository_id", "snapshot_id", "start"], [(REPOSITORY, HEAD, i) for i in ids])
