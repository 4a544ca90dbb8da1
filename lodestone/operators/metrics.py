"""Static metrics over the graph, the long metric table, and repository-level summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone import vocab
from lodestone.functions import columns as C
from lodestone.operators import graph

KEYS = vocab.KEYS
METRIC_COLUMNS = ["entity_type", "entity_name", "metric_name", "metric_value", "metric_source", *KEYS]


def degrees(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Distinct in- and out-degree of every node, zero where it has no edge.

    ``pairs`` is already distinct, so both degrees are sums of ones over its two ends: one map-side
    combined aggregate and one join, and a hub never gathers its neighbours in one task.
    """
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    ends = F.array(F.struct(F.col("source_id").alias("id"), one.alias("leaving"), none.alias("entering")),
                   F.struct(F.col("target_id").alias("id"), none.alias("leaving"), one.alias("entering")))
    counted = pairs.select(*KEYS, F.explode(ends).alias("e")).groupBy(*KEYS, F.col("e.id").alias("id")).agg(
        F.sum("e.entering").alias("fan_in"), F.sum("e.leaving").alias("fan_out"))
    return (nodes.join(counted, ["id", *KEYS], "left")
            .withColumn("fan_out", F.coalesce("fan_out", none)).withColumn("fan_in", F.coalesce("fan_in", none)))


def fan_in_out(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct confirmed callers and callees of every function; both ends must be functions."""
    ids = functions.select(*KEYS, "id")
    pairs = graph.distinct_edges(edges, ["CALLS"], vocab.CONFIRMED, drop_loops=False)
    inside = (pairs.join(ids.withColumnRenamed("id", "source_id"), ["source_id", *KEYS], "left_semi")
              .join(ids.withColumnRenamed("id", "target_id"), ["target_id", *KEYS], "left_semi"))
    return degrees(functions, inside)


def module_coupling(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct importing and imported modules, the module itself excluded."""
    pairs = graph.distinct_edges(edges, ["IMPORTS"])
    ids = modules.select(*KEYS, "id")
    inside = (pairs.join(ids.withColumnRenamed("id", "source_id"), ["source_id", *KEYS], "left_semi")
              .join(ids.withColumnRenamed("id", "target_id"), ["target_id", *KEYS], "left_semi"))
    return (degrees(ids, inside).withColumnRenamed("fan_in", "incoming_coupling")
            .withColumnRenamed("fan_out", "outgoing_coupling"))


def _long(df: DataFrame, entity_type: str, names: list[str], source: str) -> DataFrame:
    values = F.array(*[F.struct(F.lit(n).alias("metric_name"), F.col(n).cast("double").alias("metric_value"))
                       for n in names])
    return df.select(*KEYS, F.col("id").alias("entity_name"), F.explode(values).alias("m")).select(
        *KEYS, F.lit(entity_type).alias("entity_type"), "entity_name", "m.metric_name", "m.metric_value",
        F.lit(source).alias("metric_source"))


def static_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The deterministic metric rows of every function and module.

    ``nodes`` carries ``id``, ``label`` and ``cyclomatic_complexity``.
    """
    functions = nodes.where(F.col("label") == "Function").select(
        *KEYS, "id", F.coalesce("cyclomatic_complexity", F.lit(0)).alias("cyclomatic_complexity"))
    modules = nodes.where(F.col("label") == "Module").select(*KEYS, "id")
    fans = C.max_normalised(fan_in_out(functions, edges), "cyclomatic_complexity", "normalized_complexity", KEYS)
    coupling = C.max_normalised(module_coupling(modules, edges), "outgoing_coupling", "normalized_coupling", KEYS)
    trails = graph.closed_trails(edges.where(F.col("relationship") == "IMPORTS")).withColumnRenamed("start", "id")
    on_cycle = trails.join(modules, ["id", *KEYS], "left_semi")
    return (
        _long(fans, "Function", ["fan_out", "fan_in", "cyclomatic_complexity", "normalized_complexity"], "deterministic")
        .unionByName(_long(coupling, "Module", ["incoming_coupling", "outgoing_coupling", "normalized_coupling"],
                           "deterministic"))
        .unionByName(_long(on_cycle, "Module", ["circular_dependencies"], "deterministic"))
    )


def risk_metrics(risk: DataFrame, source: str = "risk_heuristic_v1") -> DataFrame:
    """File risk as rows of the long metric table."""
    shaped = risk.select(*KEYS, F.col("file_path").alias("id"), "risk_score", F.col("risk_code").alias("risk_label"))
    return _long(shaped, "File", ["risk_score", "risk_label"], source)


def metric_map(metrics: DataFrame) -> DataFrame:
    """One row per entity: metric name -> value, and metric name -> source.

    Names are reduced to one row each first, so an entity's maps hold at most one entry per
    metric name however many rows the table has.
    """
    single = metrics.groupBy(*KEYS, "entity_type", "entity_name", "metric_name").agg(
        F.max("metric_value").alias("metric_value"), F.max("metric_source").alias("metric_source"))
    return single.groupBy(*KEYS, "entity_type", "entity_name").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric_name", "metric_value")))).alias("metrics"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric_name", "metric_source")))).alias("sources"))


def entity_metrics(metrics: DataFrame, entity_type: str, entity_name: str) -> DataFrame:
    """Metrics of one entity; the type is matched without regard to case."""
    wanted = metrics.where(F.col("entity_type").ilike(entity_type) & (F.col("entity_name") == entity_name))
    return metric_map(wanted)


def repository_health(metrics: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """One row per snapshot: entity counts, complexity and coupling summary.

    Rows are first reduced to one per entity, which makes the distinct counts plain counts and
    keeps a large snapshot from being counted in a single task. With ``nodes`` the class count
    comes from the graph, since classes have no metric rows.
    """
    def of(name: str, value=None):
        return F.when(F.col("metric_name") == name, F.col("metric_value") if value is None else value)

    per_entity = metrics.groupBy(*KEYS, "entity_type", "entity_name").agg(
        F.sum(of("cyclomatic_complexity")).alias("cc_sum"),
        F.count(of("cyclomatic_complexity")).alias("cc_n"),
        F.max(of("cyclomatic_complexity")).alias("cc_max"),
        F.sum(of("circular_dependencies")).alias("cycles"),
        F.count_if((F.col("metric_name") == "cyclomatic_complexity") & (F.col("metric_value") > 10)).alias("high_cc"),
        F.count_if((F.col("metric_name") == "outgoing_coupling") & (F.col("metric_value") > 5)).alias("high_coupling"),
    )
    zero = F.lit(0.0)
    health = per_entity.groupBy(*KEYS).agg(
        F.count_if(F.col("entity_type") == "Module").alias("total_modules"),
        F.count_if(F.col("entity_type") == "Class").alias("total_classes"),
        F.count_if(F.col("entity_type") == "Function").alias("total_functions"),
        F.round(F.coalesce(F.sum("cc_sum") / F.sum("cc_n"), zero), 2).alias("average_complexity"),
        F.coalesce(F.max("cc_max"), zero).alias("maximum_complexity"),
        F.coalesce(F.sum("cycles"), zero).alias("circular_dependencies"),
        F.sum("high_cc").alias("high_complexity_functions"),
        F.sum("high_coupling").alias("high_coupling_modules"),
    )
    if nodes is None:
        return health
    classes = nodes.where(F.col("label") == "Class").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_classes"))
    return (health.join(classes, KEYS, "left")
            .withColumn("total_classes", F.coalesce("_classes", "total_classes")).drop("_classes"))


def graph_health(nodes: DataFrame) -> DataFrame:
    """Health counts straight from the nodes, for snapshots without metric rows."""
    return nodes.groupBy(*KEYS).agg(
        F.count_if(F.col("label") == "Module").alias("total_modules"),
        F.count_if(F.col("label") == "Class").alias("total_classes"),
        F.count_if(F.col("label") == "Function").alias("total_functions"),
        F.round(F.avg(F.when(F.col("label") == "Function", F.coalesce("cyclomatic_complexity", F.lit(1)))), 2)
        .alias("average_complexity"))


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot per repository: a map-side combined max_by, not a window."""
    return snapshots.groupBy(vocab.REPO).agg(
        F.max_by(vocab.SNAP, F.struct("analyzed_at", vocab.SNAP)).alias(vocab.SNAP),
        F.max("analyzed_at").alias("analyzed_at"))


def flag_latest(snapshots: DataFrame) -> DataFrame:
    newest = latest_snapshot(snapshots).select(*KEYS, F.lit(True).alias("is_latest"))
    return snapshots.drop("is_latest").join(newest, KEYS, "left").na.fill(False, ["is_latest"])


def repository_listing(repositories: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Repositories, newest first, each with a flag telling whether it was ever analysed."""
    analysed = snapshots.select(vocab.REPO).distinct().withColumn("has_snapshot", F.lit(True))
    return (repositories.join(analysed, vocab.REPO, "left").na.fill(False, ["has_snapshot"])
            .orderBy(F.col("created_at").desc(), vocab.REPO))


def snapshot_timeline(snapshots: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per snapshot: files, functions, mean complexity, mean coupling and mean file risk."""
    def value(kind: str, name: str):
        return F.when((F.col("entity_type") == kind) & (F.col("metric_name") == name), F.col("metric_value"))

    zero = F.lit(0.0)
    sums = metrics.groupBy(*KEYS).agg(
        F.count(value("File", "risk_score")).alias("total_files"),
        F.count(value("Function", "cyclomatic_complexity")).alias("total_functions"),
        F.coalesce(F.avg(value("Function", "cyclomatic_complexity")), zero).alias("average_complexity"),
        F.coalesce(F.avg(value("Module", "outgoing_coupling")), zero).alias("average_coupling"),
        F.coalesce(F.avg(value("File", "risk_score")), zero).alias("repository_risk"))
    return snapshots.join(sums, KEYS, "left").na.fill(0).orderBy(vocab.REPO, "analyzed_at", vocab.SNAP)


def metric_trend(snapshots: DataFrame, metrics: DataFrame, entity_type: str, entity_name: str) -> DataFrame:
    """Metric maps of one entity over time; snapshots without metrics for it are left out."""
    maps = entity_metrics(metrics, entity_type, entity_name)
    return snapshots.join(maps, KEYS).orderBy(vocab.REPO, "analyzed_at", vocab.SNAP)


# ------------------------------------------------------------------------- series trends

def _steps(series: DataFrame, order: str, groups: list[str]) -> DataFrame:
    w = Window.partitionBy(*groups).orderBy(order)
    return series.withColumn("_delta", F.col("value") - F.lag("value").over(w))


def trend_direction(series: DataFrame, order: str, groups: list[str]) -> DataFrame:
    """Direction of each ordered series: stable, increasing, decreasing or fluctuating.

    A series is one metric of one repository, with one value per snapshot.
    """
    stepped = _steps(series, order, groups)
    stats = stepped.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("points"),
        F.min_by("value", order).alias("first_value"),
        F.max_by("value", order).alias("last_value"),
        F.coalesce(F.bool_and(F.col("_delta") == 0), F.lit(True)).alias("_flat"),
        F.coalesce(F.bool_and(F.col("_delta") >= 0), F.lit(True)).alias("_up"),
        F.coalesce(F.bool_and(F.col("_delta") <= 0), F.lit(True)).alias("_down"),
    )
    enough = F.col("points") >= 2
    direction = (
        F.when(~enough, "insufficient_data").when(F.col("_flat"), "stable")
        .when(F.col("_up") & (F.col("last_value") > F.col("first_value")), "increasing")
        .when(F.col("_down") & (F.col("last_value") < F.col("first_value")), "decreasing")
        .otherwise("fluctuating"))
    delta = F.when(enough, F.col("last_value") - F.col("first_value")).otherwise(F.col("last_value") * 0)
    name, first, last = F.col("metric_name"), F.col("first_value").cast("string"), F.col("last_value").cast("string")
    text = (
        F.when(direction == "insufficient_data", "At least two snapshots are required to evaluate trends.")
        .when(direction == "stable", F.concat(F.lit("Metric '"), name, F.lit("' is stable at "), first,
                                              F.lit(" across "), F.col("points").cast("string"), F.lit(" snapshots.")))
        .when(direction == "increasing", F.concat(F.lit("Metric '"), name, F.lit("' increased from "), first,
                                                  F.lit(" to "), last, F.lit(" (+"), delta.cast("string"), F.lit(").")))
        .when(direction == "decreasing", F.concat(F.lit("Metric '"), name, F.lit("' decreased from "), first,
                                                  F.lit(" to "), last, F.lit(" ("), delta.cast("string"), F.lit(").")))
        .otherwise(F.concat(F.lit("Metric '"), name, F.lit("' fluctuated across snapshots (start: "), first,
                            F.lit(", end: "), last, F.lit(")."))))
    return stats.select(*groups, "points", "first_value", "last_value", direction.alias("direction"),
                        delta.alias("delta_total"), text.alias("explanation"))


def strict_trend(series: DataFrame, order: str, groups: list[str]) -> DataFrame:
    """INCREASING, DECREASING or STABLE only when every step agrees; else VOLATILE."""
    stepped = _steps(series, order, groups)
    stats = stepped.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("points"),
        F.bool_and(F.col("_delta") > 0).alias("_up"),
        F.bool_and(F.col("_delta") < 0).alias("_down"),
        F.bool_and(F.col("_delta") == 0).alias("_flat"))
    trend = (F.when(F.col("points") < 2, "UNKNOWN").when(F.col("_up"), "INCREASING")
             .when(F.col("_down"), "DECREASING").when(F.col("_flat"), "STABLE").otherwise("VOLATILE"))
    return stats.select(*groups, "points", trend.alias("trend"))
