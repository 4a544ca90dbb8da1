"""Static metric, health, timeline and trend queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import graph as GR
from lodestone.operators import metrics as M
from lodestone.queries import sql as S
from lodestone.sources import warehouse as W

KEYS = ["repository_id", "snapshot_id"]


def fan_in_out(spark: SparkSession, sf: str) -> DataFrame:
    out = M.fan_in_out(W.function_nodes(spark, sf), W.module_edges(spark, sf))
    return out.select("id", "cyclomatic_complexity", "fan_in", "fan_out")


_CALLS = f"{S.EDGES}, {S.NODES}, calls AS (SELECT DISTINCT source_id, target_id FROM edges WHERE relationship = 'CALLS' AND rnk < 2)"
FAN_IN_OUT = f"""WITH {_CALLS} SELECT id, cc AS cyclomatic_complexity,
 (SELECT count(*) FROM calls WHERE target_id = id) AS fan_in, (SELECT count(*) FROM calls WHERE source_id = id) AS fan_out FROM nodes"""


def module_coupling(spark: SparkSession, sf: str) -> DataFrame:
    return M.module_coupling(W.module_nodes(spark, sf), W.module_edges(spark, sf)).select(
        "id", "incoming_coupling", "outgoing_coupling")


_IMPORTS = f"{S.EDGES}, {S.NODES}, imports AS (SELECT DISTINCT source_id, target_id FROM edges WHERE relationship = 'IMPORTS')"
MODULE_COUPLING = f"""WITH {_IMPORTS} SELECT id,
 (SELECT count(*) FROM imports WHERE target_id = id AND source_id <> id) AS incoming_coupling,
 (SELECT count(*) FROM imports WHERE source_id = id AND target_id <> id) AS outgoing_coupling FROM nodes"""


def module_cycle_counts(spark: SparkSession, sf: str) -> DataFrame:
    edges = W.module_edges(spark, sf).where(F.col("relationship") == "IMPORTS")
    return GR.closed_trails(edges).select(F.col("start").alias("id"), "circular_dependencies")


_TRAILS = """trails AS (SELECT source_id AS s, target_id AS e, [concat(source_id, '>', target_id)] AS used, 1 AS n
   FROM imports WHERE source_id IN (SELECT target_id FROM imports)
  UNION ALL SELECT t.s, i.target_id, list_append(t.used, concat(i.source_id, '>', i.target_id)), t.n + 1
   FROM trails t JOIN imports i ON i.source_id = t.e WHERE t.n < 5 AND NOT list_contains(t.used, concat(i.source_id, '>', i.target_id))),
 cyc AS (SELECT s AS id, count(*) AS circular_dependencies FROM trails WHERE s = e GROUP BY 1)"""
MODULE_CYCLES = f"WITH RECURSIVE {_IMPORTS}, {_TRAILS} SELECT * FROM cyc"


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return W.function_nodes(spark, sf).unionByName(W.module_nodes(spark, sf))


def static_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = M.static_metrics(_nodes(spark, sf), W.module_edges(spark, sf))
    return out.select("entity_type", "entity_name", "metric_name", F.round("metric_value", 6).alias("metric_value"),
                      "metric_source")


_METRICS = f"""{_IMPORTS}, calls AS (SELECT DISTINCT source_id, target_id FROM edges WHERE relationship = 'CALLS' AND rnk < 2),
 fi AS (SELECT target_id AS id, count(*) AS n FROM calls GROUP BY 1), fo AS (SELECT source_id AS id, count(*) AS n FROM calls GROUP BY 1),
 ic AS (SELECT target_id AS id, count(*) AS n FROM imports WHERE source_id <> target_id GROUP BY 1),
 oc AS (SELECT source_id AS id, count(*) AS n FROM imports WHERE source_id <> target_id GROUP BY 1),
 {_TRAILS},
 fn AS (SELECT id, cc, coalesce(fi.n, 0) AS fi, coalesce(fo.n, 0) AS fo, cc / CAST(max(cc) OVER () AS DOUBLE) AS nc
   FROM nodes LEFT JOIN fi USING (id) LEFT JOIN fo USING (id)),
 mo AS (SELECT id, coalesce(ic.n, 0) AS ic, coalesce(oc.n, 0) AS oc, coalesce(oc.n, 0) / CAST(max(coalesce(oc.n, 0)) OVER () AS DOUBLE) AS nc
   FROM nodes LEFT JOIN ic USING (id) LEFT JOIN oc USING (id)),
 metrics AS (SELECT 'Function' AS entity_type, id AS entity_name, 'fan_in' AS metric_name, CAST(fi AS DOUBLE) AS metric_value FROM fn
  UNION ALL SELECT 'Function', id, 'fan_out', fo FROM fn UNION ALL SELECT 'Function', id, 'cyclomatic_complexity', cc FROM fn
  UNION ALL SELECT 'Function', id, 'normalized_complexity', nc FROM fn
  UNION ALL SELECT 'Module', id, 'incoming_coupling', ic FROM mo UNION ALL SELECT 'Module', id, 'outgoing_coupling', oc FROM mo
  UNION ALL SELECT 'Module', id, 'normalized_coupling', nc FROM mo
  UNION ALL SELECT 'Module', id, 'circular_dependencies', circular_dependencies FROM cyc)"""
STATIC_METRICS = f"""WITH RECURSIVE {_METRICS} SELECT entity_type, entity_name, metric_name,
 round(metric_value, 6) AS metric_value, 'deterministic' AS metric_source FROM metrics"""


def repository_health(spark: SparkSession, sf: str) -> DataFrame:
    metrics = M.static_metrics(_nodes(spark, sf), W.module_edges(spark, sf))
    return M.repository_health(metrics).drop(*KEYS)


REPOSITORY_HEALTH = f"""WITH RECURSIVE {_METRICS} SELECT
 count(DISTINCT entity_name) FILTER (entity_type = 'Module') AS total_modules,
 count(DISTINCT entity_name) FILTER (entity_type = 'Class') AS total_classes,
 count(DISTINCT entity_name) FILTER (entity_type = 'Function') AS total_functions,
 round(avg(metric_value) FILTER (metric_name = 'cyclomatic_complexity'), 2) AS average_complexity,
 max(metric_value) FILTER (metric_name = 'cyclomatic_complexity') AS maximum_complexity,
 coalesce(sum(metric_value) FILTER (metric_name = 'circular_dependencies'), 0) AS circular_dependencies,
 count(*) FILTER (metric_name = 'cyclomatic_complexity' AND metric_value > 10) AS high_complexity_functions,
 count(*) FILTER (metric_name = 'outgoing_coupling' AND metric_value > 5) AS high_coupling_modules FROM metrics"""


def graph_health(spark: SparkSession, sf: str) -> DataFrame:
    return M.graph_health(_nodes(spark, sf)).drop(*KEYS)


GRAPH_HEALTH = """SELECT count(*) AS total_modules, CAST(0 AS BIGINT) AS total_classes, count(*) AS total_functions,
 round(avg(coalesce(p_size, 1)), 2) AS average_complexity FROM part"""


# --- yearly snapshots: one per calendar year of shipment, one row per (year, part, metric) ----

def yearly_metrics(spark: SparkSession, sf: str) -> DataFrame:
    line = W.table(spark, sf, "lineitem")
    year = F.year("l_shipdate").cast("string")
    per = line.groupBy(F.when(F.col("l_partkey").isNotNull(), W.REPOSITORY).alias("repository_id"), year.alias("snapshot_id"),
                       W.module_name(F.col("l_partkey")).alias("entity_name")).agg(
        F.max("l_linenumber").cast("double").alias("cyclomatic_complexity"),
        F.countDistinct("l_suppkey").cast("double").alias("outgoing_coupling"),
        F.max("l_discount").alias("risk_score"))
    kinds = {"cyclomatic_complexity": "Function", "outgoing_coupling": "Module", "risk_score": "File"}
    rows = F.array(*[F.struct(F.lit(kind).alias("entity_type"), F.lit(name).alias("metric_name"),
                              F.col(name).alias("metric_value")) for name, kind in kinds.items()])
    return per.select(*KEYS, "entity_name", F.explode(rows).alias("m")).select(
        *KEYS, "m.entity_type", "entity_name", "m.metric_name", "m.metric_value",
        F.lit("deterministic").alias("metric_source"))


def year_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    line = W.table(spark, sf, "lineitem")
    return line.groupBy(F.when(F.col("l_partkey").isNotNull(), W.REPOSITORY).alias("repository_id"),
                        F.year("l_shipdate").cast("string").alias("snapshot_id")).agg(
        F.max("l_shipdate").alias("analyzed_at"))


_YEARLY = f"""per AS (SELECT CAST(year(l_shipdate) AS VARCHAR) AS snapshot_id, {S.module('l_partkey')} AS entity_name,
  CAST(max(l_linenumber) AS DOUBLE) AS cc, CAST(count(DISTINCT l_suppkey) AS DOUBLE) AS oc, max(l_discount) AS risk,
  max(l_shipdate) AS ts FROM lineitem GROUP BY ALL),
 snaps AS (SELECT snapshot_id, max(ts) AS analyzed_at FROM per GROUP BY 1)"""


def snapshot_timeline(spark: SparkSession, sf: str) -> DataFrame:
    out = M.snapshot_timeline(year_snapshots(spark, sf), yearly_metrics(spark, sf))
    rounded = {c: F.round(c, 6) for c in ("average_complexity", "average_coupling", "repository_risk")}
    return out.withColumns(rounded).drop("repository_id")


SNAPSHOT_TIMELINE = f"""WITH {_YEARLY} SELECT snapshot_id, max(ts) AS analyzed_at, count(*) AS total_files,
 count(*) AS total_functions, round(avg(cc), 6) AS average_complexity, round(avg(oc), 6) AS average_coupling,
 round(avg(risk), 6) AS repository_risk FROM per GROUP BY 1"""


def latest_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as repositories, their orders as snapshots."""
    snaps = W.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("repository_id"), F.col("o_orderkey").alias("snapshot_id"),
        F.col("o_orderdate").alias("analyzed_at"))
    return M.latest_snapshot(snaps)


LATEST_SNAPSHOT = """SELECT o_custkey AS repository_id, o_orderkey AS snapshot_id, o_orderdate AS analyzed_at FROM orders
 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""


def snapshot_flags(spark: SparkSession, sf: str) -> DataFrame:
    snaps = W.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("repository_id"), F.col("o_orderkey").alias("snapshot_id"),
        F.col("o_orderdate").alias("analyzed_at"))
    return M.flag_latest(snaps)


SNAPSHOT_FLAGS = """SELECT o_custkey AS repository_id, o_orderkey AS snapshot_id, o_orderdate AS analyzed_at,
 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS is_latest FROM orders"""


def repository_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as repositories; those with a supplier count as analysed."""
    nation = W.table(spark, sf, "nation").select(F.col("n_nationkey").alias("repository_id"),
                                                 F.col("n_name").alias("name"), F.col("n_regionkey").alias("created_at"))
    snaps = W.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("repository_id"))
    return M.repository_listing(nation, snaps)


REPOSITORY_LISTING = """SELECT n_nationkey AS repository_id, n_name AS name, n_regionkey AS created_at,
 n_nationkey IN (SELECT s_nationkey FROM supplier) AS has_snapshot FROM nation"""


def metric_maps(spark: SparkSession, sf: str) -> DataFrame:
    maps = M.metric_map(yearly_metrics(spark, sf))
    return maps.select("snapshot_id", "entity_type", "entity_name",
                       F.array_join(F.transform(F.array_sort(F.map_entries("metrics")), lambda e: F.concat(
                           e["key"], F.lit("="), F.round(e["value"] * 100).cast("bigint").cast("string"))), ",").alias("metrics"))


METRIC_MAPS = f"""WITH {_YEARLY}, m AS (SELECT snapshot_id, 'Function' AS entity_type, entity_name, 'cyclomatic_complexity' AS k, cc AS v FROM per
 UNION ALL SELECT snapshot_id, 'Module', entity_name, 'outgoing_coupling', oc FROM per UNION ALL SELECT snapshot_id, 'File', entity_name, 'risk_score', risk FROM per)
 SELECT snapshot_id, entity_type, entity_name, string_agg(concat(k, '=', CAST(CAST(round(v * 100) AS BIGINT) AS VARCHAR)), ',' ORDER BY k) AS metrics FROM m GROUP BY ALL"""


def metric_trend(spark: SparkSession, sf: str) -> DataFrame:
    """History of one module; the entity type is given in another letter case on purpose."""
    out = M.metric_trend(year_snapshots(spark, sf), yearly_metrics(spark, sf), "MODULE", "src.m0.f7")
    return out.select("snapshot_id", "analyzed_at", F.element_at("metrics", "outgoing_coupling").alias("outgoing_coupling"))


METRIC_TREND = f"""WITH {_YEARLY} SELECT snapshot_id, analyzed_at, oc AS outgoing_coupling FROM per JOIN snaps USING (snapshot_id)
 WHERE entity_name = 'src.m0.f7'"""


def _series(spark: SparkSession, sf: str) -> DataFrame:
    line = W.table(spark, sf, "lineitem")
    return line.groupBy(W.module_name(F.col("l_partkey")).alias("repository_id"), F.lit("line_count").alias("metric_name"),
                        F.year("l_shipdate").alias("ord")).agg(F.count(F.lit(1)).alias("value"))


def trend_classify(spark: SparkSession, sf: str) -> DataFrame:
    return M.trend_direction(_series(spark, sf), "ord", ["repository_id", "metric_name"])


_SERIES = f"""s AS (SELECT {S.module('l_partkey')} AS repository_id, 'line_count' AS metric_name, year(l_shipdate) AS ord, count(*) AS value
  FROM lineitem GROUP BY ALL), d AS (SELECT *, value - lag(value) OVER (PARTITION BY repository_id ORDER BY ord) AS delta FROM s),
 a AS (SELECT repository_id, metric_name, count(*) AS points, arg_min(value, ord) AS f, arg_max(value, ord) AS l,
  bool_and(delta = 0) AS eq, bool_and(delta >= 0) AS up, bool_and(delta <= 0) AS dn, bool_and(delta > 0) AS sup, bool_and(delta < 0) AS sdn
  FROM d GROUP BY 1, 2)"""
TREND_CLASSIFY = f"""WITH {_SERIES}, c AS (SELECT *, CASE WHEN points < 2 THEN 'insufficient_data' WHEN eq THEN 'stable' WHEN up AND l > f THEN 'increasing'
  WHEN dn AND l < f THEN 'decreasing' ELSE 'fluctuating' END AS direction FROM a)
SELECT repository_id, metric_name, points, f AS first_value, l AS last_value, direction, CASE WHEN points < 2 THEN 0 ELSE l - f END AS delta_total,
 CASE direction WHEN 'insufficient_data' THEN 'At least two snapshots are required to evaluate trends.'
  WHEN 'stable' THEN concat('Metric ''', metric_name, ''' is stable at ', f, ' across ', points, ' snapshots.')
  WHEN 'increasing' THEN concat('Metric ''', metric_name, ''' increased from ', f, ' to ', l, ' (+', l - f, ').')
  WHEN 'decreasing' THEN concat('Metric ''', metric_name, ''' decreased from ', f, ' to ', l, ' (', l - f, ').')
  ELSE concat('Metric ''', metric_name, ''' fluctuated across snapshots (start: ', f, ', end: ', l, ').') END AS explanation FROM c"""


def trend_strict(spark: SparkSession, sf: str) -> DataFrame:
    return M.strict_trend(_series(spark, sf), "ord", ["repository_id", "metric_name"])


TREND_STRICT = f"""WITH {_SERIES} SELECT repository_id, metric_name, points, CASE WHEN points < 2 THEN 'UNKNOWN' WHEN sup THEN 'INCREASING'
 WHEN sdn THEN 'DECREASING' WHEN eq THEN 'STABLE' ELSE 'VOLATILE' END AS trend FROM a"""

QUERIES = {
    "fan_in_out": (fan_in_out, FAN_IN_OUT),
    "module_coupling": (module_coupling, MODULE_COUPLING),
    "module_cycle_counts": (module_cycle_counts, MODULE_CYCLES),
    "static_metrics": (static_metrics, STATIC_METRICS),
    "repository_health": (repository_health, REPOSITORY_HEALTH),
    "graph_health": (graph_health, GRAPH_HEALTH),
    "snapshot_timeline": (snapshot_timeline, SNAPSHOT_TIMELINE),
    "latest_snapshot": (latest_snapshot, LATEST_SNAPSHOT),
    "snapshot_flags": (snapshot_flags, SNAPSHOT_FLAGS),
    "repository_listing": (repository_listing, REPOSITORY_LISTING),
    "metric_maps": (metric_maps, METRIC_MAPS),
    "metric_trend": (metric_trend, METRIC_TREND),
    "trend_classify": (trend_classify, TREND_CLASSIFY),
    "trend_strict": (trend_strict, TREND_STRICT),
}
