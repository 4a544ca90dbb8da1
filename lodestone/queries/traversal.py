"""Graph queries: impact, paths, chains, closure, cycles and subgraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import architecture as A
from lodestone.operators import explain as X
from lodestone.operators import graph as GR
from lodestone.queries import sql as S
from lodestone.sources import warehouse as W

KEYS = ["repository_id", "snapshot_id"]
FOCUS = ("nation:3", "part:7", "customer:11", "order:5")


def _impact(spark: SparkSession, sf: str, direction: str) -> DataFrame:
    out = GR.impact(W.start_nodes(spark, *FOCUS), W.schema_graph(spark, sf), direction, max_depth=5)
    return out.select("start", "node", "distance", "category", "resolution")


def impact_upstream(spark: SparkSession, sf: str) -> DataFrame:
    return _impact(spark, sf, "upstream")


def impact_downstream(spark: SparkSession, sf: str) -> DataFrame:
    return _impact(spark, sf, "downstream")


def _bfs_sql(near: str, far: str) -> str:
    starts = ", ".join(f"('{f}')" for f in FOCUS)
    return f"""WITH RECURSIVE {S.schema_graph()}, nb AS (SELECT {near} AS n, {far} AS x, min(rnk) AS rnk FROM graph GROUP BY ALL),
 r AS (SELECT f AS start, f AS node, 0 AS depth, 0 AS rnk, 0 AS weak, '' AS trail FROM (VALUES {starts}) t(f)
  UNION ALL SELECT r.start, nb.x, r.depth + 1, nb.rnk, greatest(r.weak, nb.rnk), concat(r.trail, nb.rnk, nb.x, chr(1))
  FROM r JOIN nb ON nb.n = r.node WHERE r.depth < 5 AND r.rnk < 2 AND nb.x <> r.start),
 b AS (SELECT start, node, min(depth) AS distance FROM r WHERE depth > 0 GROUP BY 1, 2),
 c AS (SELECT b.start, b.node, b.distance, arg_min(r.rnk, r.trail) AS rnk, arg_min(r.weak, r.trail) AS weak
  FROM b JOIN r ON r.start = b.start AND r.node = b.node AND r.depth = b.distance GROUP BY ALL)
SELECT start, node, distance, CASE WHEN rnk = 2 THEN 'unresolved' WHEN distance = 1 THEN 'direct' ELSE 'indirect' END AS category,
 CASE weak WHEN 0 THEN 'exact' WHEN 1 THEN 'inferred' ELSE 'unresolved' END AS resolution FROM c"""


TRADE_FOCUS = ("nation:3", "region:1", "supplier:4", "customer:11")


def impact_members(spark: SparkSession, sf: str) -> DataFrame:
    """Impact through contained members: a nation reaches what its customers call."""
    out = GR.impact(W.start_nodes(spark, *TRADE_FOCUS), W.trade_graph(spark, sf), "both")
    return out.select("start", "direction", "node", "distance", "category", "resolution")


def _trade_impact(depth: int = 1) -> str:
    starts = ", ".join(f"'{f}'" for f in TRADE_FOCUS)
    return f"""{S.TRADE},
 down AS (SELECT source_id AS n, target_id AS x, rnk FROM bought UNION ALL SELECT a, target_id, rnk FROM bought JOIN members ON m = source_id WHERE target_id <> a),
 up AS (SELECT target_id AS n, source_id AS x, rnk FROM bought UNION ALL SELECT a, source_id, rnk FROM bought JOIN members ON m = target_id WHERE source_id <> a),
 imp AS (SELECT n AS start, d AS direction, x AS node, min(rnk) AS rnk FROM (SELECT 'upstream' AS d, * FROM up UNION ALL SELECT 'downstream', * FROM down)
  WHERE n IN ({starts}) AND x <> n GROUP BY ALL)"""


IMPACT_MEMBERS = f"""WITH {_trade_impact()} SELECT start, direction, node, 1 AS distance,
 CASE WHEN rnk = 2 THEN 'unresolved' ELSE 'direct' END AS category,
 CASE rnk WHEN 0 THEN 'exact' WHEN 1 THEN 'inferred' ELSE 'unresolved' END AS resolution FROM imp"""


def impact_containers(spark: SparkSession, sf: str) -> DataFrame:
    edges = W.trade_graph(spark, sf)
    found = GR.impact(W.start_nodes(spark, *TRADE_FOCUS), edges, "both")
    return GR.impact_containers(found, W.trade_nodes(spark, sf), edges).drop(*KEYS)


_KINDS = """kinds AS (SELECT DISTINCT a AS id, CASE WHEN a LIKE 'region%' THEN 'file' ELSE 'class' END AS kind FROM contains),
 cont AS (SELECT DISTINCT start, kind AS container_kind, id AS container FROM imp JOIN members ON m = node JOIN kinds ON id = a WHERE rnk < 2)"""
IMPACT_CONTAINERS = f"WITH {_trade_impact()}, {_KINDS} SELECT * FROM cont"


def impact_summary(spark: SparkSession, sf: str) -> DataFrame:
    edges = W.trade_graph(spark, sf)
    found = GR.impact(W.start_nodes(spark, *TRADE_FOCUS), edges, "both")
    return GR.impact_summary(found, GR.impact_containers(found, W.trade_nodes(spark, sf), edges)).drop(*KEYS)


IMPACT_SUMMARY = f"""WITH {_trade_impact()}, {_KINDS} SELECT start,
 count(*) FILTER (direction = 'upstream' AND rnk < 2) AS direct_callers, CAST(0 AS BIGINT) AS indirect_callers,
 count(*) FILTER (direction = 'downstream' AND rnk < 2) AS direct_callees, CAST(0 AS BIGINT) AS indirect_callees,
 1 AS actual_depth_reached, count(DISTINCT node) FILTER (rnk = 2) AS unresolved_references,
 (SELECT count(*) FROM cont c WHERE c.start = imp.start AND container_kind = 'file') AS affected_files, CAST(0 AS BIGINT) AS affected_modules,
 (SELECT count(*) FROM cont c WHERE c.start = imp.start AND container_kind = 'class') AS affected_classes,
 count(*) + 2 AS nodes_visited, (count(*) FILTER (direction = 'upstream') + 1 >= 500) OR (count(*) FILTER (direction = 'downstream') + 1 >= 500) AS truncated
FROM imp GROUP BY start"""


def impact_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Direct and indirect callers and callees of the focus entities over the whole schema graph, to the end."""
    edges = W.schema_graph(spark, sf)
    found = GR.cut_lineage(GR.impact(W.start_nodes(spark, *FOCUS), edges, "both"))
    nodes = W.trade_nodes(spark, sf)
    return GR.impact_summary(found, GR.impact_containers(found, nodes, edges)).drop(*KEYS)


IMPACT_COUNTS = f"""WITH imp AS (SELECT 'upstream' AS direction, * FROM ({_bfs_sql("target_id", "source_id")})
  UNION ALL SELECT 'downstream', * FROM ({_bfs_sql("source_id", "target_id")})),
 own AS (SELECT DISTINCT start, node FROM imp WHERE category <> 'unresolved'),
 aff AS (SELECT start, count(*) FILTER (node LIKE 'region:%') AS files, count(*) FILTER (node LIKE 'nation:%') AS classes FROM own GROUP BY 1)
SELECT start, count(*) FILTER (direction = 'upstream' AND category = 'direct') AS direct_callers, count(*) FILTER (direction = 'upstream' AND category = 'indirect') AS indirect_callers,
 count(*) FILTER (direction = 'downstream' AND category = 'direct') AS direct_callees, count(*) FILTER (direction = 'downstream' AND category = 'indirect') AS indirect_callees,
 max(distance) AS actual_depth_reached, count(DISTINCT node) FILTER (category = 'unresolved') AS unresolved_references,
 coalesce(any_value(files), 0) AS affected_files, CAST(0 AS BIGINT) AS affected_modules, coalesce(any_value(classes), 0) AS affected_classes, count(*) + 2 AS nodes_visited,
 (count(*) FILTER (direction = 'upstream') + 1 >= 500) OR (count(*) FILTER (direction = 'downstream') + 1 >= 500) AS truncated
FROM imp LEFT JOIN aff USING (start) GROUP BY start"""


def _flat(paths: DataFrame, *extra: str) -> DataFrame:
    return paths.select("start", *extra, "end", "length", "confidence", F.array_join("nodes", ">").alias("path"))


def traverse_downstream(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(GR.traverse(W.start_nodes(spark, "order:5", "customer:11"), W.schema_graph(spark, sf), "downstream", max_depth=5))


def traverse_upstream(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(GR.traverse(W.start_nodes(spark, "supplier:0", "nation:3"), W.schema_graph(spark, sf), "upstream"))


def _paths_sql(starts: tuple, near: str, far: str, depth: int) -> str:
    values = ", ".join(f"('{s}')" for s in starts)
    return f"""{S.schema_graph()}, p AS (SELECT s AS start, s AS "end", 0 AS length, 0 AS w, concat('>', s, '>') AS path FROM (VALUES {values}) t(s)
 UNION ALL SELECT p.start, g.{far}, p.length + 1, greatest(p.w, g.rnk), concat(p.path, g.{far}, '>')
 FROM p JOIN graph g ON g.{near} = p."end" WHERE p.length < {depth} AND NOT contains(p.path, concat('>', g.{far}, '>')))"""


_SELECT_PATH = """SELECT start, "end", length, CASE WHEN w > 0 THEN 'inferred' ELSE 'exact' END AS confidence,
 path[2:length(path) - 1] AS path FROM p"""
TRAVERSE_DOWN = f"WITH RECURSIVE {_paths_sql(('order:5', 'customer:11'), 'source_id', 'target_id', 5)} {_SELECT_PATH} WHERE length > 0"
TRAVERSE_UP = f"WITH RECURSIVE {_paths_sql(('supplier:0', 'nation:3'), 'target_id', 'source_id', 9)} {_SELECT_PATH} WHERE length > 0"


def dependency_paths(spark: SparkSession, sf: str) -> DataFrame:
    """All paths from three orders to every region."""
    goals = W.table(spark, sf, "region").select(W.keys("r_regionkey")[0], W.ident("region", "r_regionkey").alias("goal"))
    starts = W.start_nodes(spark, "order:5", "order:6", "order:7")
    pairs = starts.join(goals, "repository_id")
    return _flat(GR.find_paths(pairs, W.schema_graph(spark, sf), max_depth=5))


DEPENDENCY_PATHS = (f"WITH RECURSIVE {_paths_sql(('order:5', 'order:6', 'order:7'), 'source_id', 'target_id', 5)} "
                    f"{_SELECT_PATH} WHERE \"end\" LIKE 'region:%'")


def http_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Chains end at suppliers' nations: IMPORTS is no chain relation, so nations have no way on."""
    return _flat(GR.http_chains(W.start_nodes(spark, "order:5", "order:6"), W.schema_graph(spark, sf), max_depth=6))


HTTP_CHAINS = (f"WITH RECURSIVE {_paths_sql(('order:5', 'order:6'), 'source_id', 'target_id', 5)} "
               f"{_SELECT_PATH} WHERE length >= 2 AND \"end\" LIKE 'nation:%'")


def path_explanations(spark: SparkSession, sf: str) -> DataFrame:
    starts = W.start_nodes(spark, "order:5", "customer:11", "region:1")
    paths = GR.traverse(starts, W.schema_graph(spark, sf), "downstream", max_depth=5)
    out = X.explain_paths(starts, paths, "downstream_dependencies")
    return out.select("start", "path_count", "summary", "confidence", F.size("detailed_reasons").alias("reasons"))


PATH_EXPLANATIONS = f"""WITH RECURSIVE {_paths_sql(('order:5', 'customer:11', 'region:1'), 'source_id', 'target_id', 5)},
 c AS (SELECT start, count(*) FILTER (length > 0) AS n, max(w) AS w FROM p GROUP BY 1)
SELECT start, n AS path_count, CASE WHEN n = 0 THEN concat('No downstream dependencies found for entity ''', start, '''.')
 ELSE concat('Discovered ', n, ' architectural path(s) from ''', start, '''.') END AS summary,
 CASE WHEN w > 0 THEN 'inferred' ELSE 'exact' END AS confidence, CAST(CASE WHEN n = 0 THEN 1 WHEN n > 5 THEN 6 ELSE n END AS INT) AS reasons FROM c"""


def transitive_dependents(spark: SparkSession, sf: str) -> DataFrame:
    edges = GR.distinct_edges(W.schema_graph(spark, sf))
    return GR.transitive_dependents(edges).select(F.col("start").alias("id"), "transitive_dependents")


_CLOSURE = """pairs AS (SELECT target_id AS t, source_id AS n FROM links UNION SELECT p.t, l.source_id FROM pairs p JOIN links l ON l.target_id = p.n
 WHERE l.source_id <> p.t), clo AS (SELECT t AS id, count(*) AS transitive_dependents FROM pairs WHERE n <> t GROUP BY 1)"""
TRANSITIVE = (f"WITH RECURSIVE {S.schema_graph()}, links AS (SELECT DISTINCT source_id, target_id FROM graph), {_CLOSURE} "
              "SELECT * FROM clo")


def arch_hotspots(spark: SparkSession, sf: str) -> DataFrame:
    facts = W.trade_nodes(spark, sf).select(*KEYS, F.col("id").alias("qualified_name"), F.col("label").alias("node_kind"))
    out = A.hotspots(facts, W.schema_graph(spark, sf))
    return out.select("qualified_name", "node_kind", "fan_in", "fan_out", "transitive_dependents",
                      F.round("percentile", 6).alias("percentile"), "severity")


ARCH_HOTSPOTS = f"""WITH RECURSIVE {S.schema_graph()}, links AS (SELECT DISTINCT source_id, target_id FROM graph WHERE rnk < 2 AND relationship IN ('CALLS', 'DEPENDS_ON', 'REQUESTS', 'IMPORTS')), {_CLOSURE},
 kinds AS (SELECT {S.ident('region','r_regionkey')} AS id, 'File' AS k FROM region UNION ALL SELECT {S.ident('nation','n_nationkey')}, 'Class' FROM nation
  UNION ALL SELECT {S.ident('customer','c_custkey')}, 'Function' FROM customer UNION ALL SELECT {S.ident('supplier','s_suppkey')}, 'Function' FROM supplier),
 ids AS (SELECT id FROM kinds UNION SELECT source_id FROM links UNION SELECT target_id FROM links),
 fi AS (SELECT target_id AS id, count(*) AS n FROM links GROUP BY 1), fo AS (SELECT source_id AS id, count(*) AS n FROM links GROUP BY 1),
 d AS (SELECT ids.id, coalesce(fi.n, 0) AS fan_in, coalesce(fo.n, 0) AS fan_out FROM ids LEFT JOIN fi USING (id) LEFT JOIN fo USING (id)),
 p AS (SELECT *, cume_dist() OVER (ORDER BY fan_in) * 100 AS pct FROM d),
 s AS (SELECT *, CASE WHEN fan_in >= 5 OR (fan_in >= 3 AND pct >= 85) THEN 'high' WHEN fan_in >= 2 OR pct >= 70 THEN 'medium' ELSE 'low' END AS severity FROM p)
SELECT s.id AS qualified_name, coalesce(k, 'Node') AS node_kind, fan_in, fan_out, coalesce(transitive_dependents, 0) AS transitive_dependents,
 round(pct, 6) AS percentile, severity FROM s LEFT JOIN kinds USING (id) LEFT JOIN clo USING (id) WHERE fan_in >= 2 OR severity <> 'low'"""


def cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Cycles of any length: the shortest one for each closing edge."""
    out = GR.closing_cycles(W.module_edges(spark, sf))
    return out.select("cycle_id", F.array_join("relationship_types", ",").alias("relationship_types"), "severity", "description")


CYCLES = f"""WITH RECURSIVE {S.EDGES}, e AS (SELECT source_id AS s, target_id AS t, list_sort(list(DISTINCT relationship)) AS types FROM edges
  WHERE relationship IN ('CALLS', 'DEPENDS_ON', 'IMPORTS') AND rnk < 2 AND source_id <> target_id GROUP BY 1, 2), {S.closing_paths('p', 'e')}
SELECT concat('cycle:', array_to_string(members, '->')) AS cycle_id, array_to_string(list_sort(list_distinct(list_concat(p.types, e.types))), ',') AS relationship_types,
 CASE WHEN len(members) = 2 THEN 'medium' ELSE 'high' END AS severity,
 concat('Circular dependency involving ', len(members), ' components: ', array_to_string(members, ' -> '), ' -> ', members[1]) AS description
FROM p JOIN e ON e.s = p.node AND e.t = p.start"""


def elementary_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """All cycles of at most four modules: here the length asked for is the feature."""
    out = GR.cycles(W.module_edges(spark, sf), max_length=4)
    return out.select("cycle_id", F.array_join("relationship_types", ",").alias("relationship_types"), "severity", "description")


ELEMENTARY_CYCLES = f"""WITH RECURSIVE {S.EDGES}, e AS (SELECT source_id AS s, target_id AS t, list_sort(list(DISTINCT relationship)) AS types FROM edges
  WHERE relationship IN ('CALLS', 'DEPENDS_ON', 'IMPORTS') AND rnk < 2 AND source_id <> target_id AND source_id IN (SELECT target_id FROM edges) GROUP BY 1, 2),
 p AS (SELECT s AS start, t AS e, [s, t] AS members, types, false AS done FROM e WHERE s < t
  UNION ALL SELECT p.start, e.t, CASE WHEN e.t = p.start THEN p.members ELSE list_append(p.members, e.t) END,
   list_concat(p.types, e.types), e.t = p.start FROM p JOIN e ON e.s = p.e
   WHERE NOT p.done AND (e.t = p.start OR (e.t > p.start AND len(p.members) < 4 AND NOT list_contains(p.members, e.t))))
SELECT concat('cycle:', array_to_string(members, '->')) AS cycle_id, array_to_string(list_sort(list_distinct(types)), ',') AS relationship_types,
 CASE WHEN len(members) = 2 THEN 'medium' ELSE 'high' END AS severity,
 concat('Circular dependency involving ', len(members), ' components: ', array_to_string(members, ' -> '), ' -> ', members[1]) AS description FROM p WHERE done"""


def overview_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    """Regions read as files; nations and the rest are not top level, so relabel nations as modules."""
    nodes = W.trade_nodes(spark, sf).withColumn("label", F.when(F.col("label") == "Class", "Module").otherwise(F.col("label")))
    return GR.overview_subgraph(nodes, W.trade_graph(spark, sf)).select("id", "label", "relationship", "target_id", "resolution")


OVERVIEW = f"""SELECT {S.ident('region','r_regionkey')} AS id, 'File' AS label, CASE WHEN n_nationkey IS NOT NULL THEN 'CONTAINS' END AS relationship,
 CASE WHEN n_nationkey IS NOT NULL THEN {S.ident('nation','n_nationkey')} END AS target_id, CASE WHEN n_nationkey IS NOT NULL THEN 'exact' END AS resolution
 FROM region LEFT JOIN nation ON n_regionkey = r_regionkey
UNION ALL SELECT {S.ident('nation','n_nationkey')}, 'Module', NULL, NULL, NULL FROM nation"""


def expand_node(spark: SparkSession, sf: str) -> DataFrame:
    focus = W.start_nodes(spark, *TRADE_FOCUS)
    return GR.neighbourhood(focus, GR.strongest_edges(GR.edges_at(focus, W.trade_graph(spark, sf)))).drop(*KEYS)


_ALL_TRADE = f"""{S.TRADE}, alledges AS (SELECT a AS source_id, 'CONTAINS' AS relationship, m AS target_id, 0 AS rnk FROM contains
 UNION ALL SELECT source_id, 'CALLS', target_id, rnk FROM bought)"""
_FOCUS_VALUES = ", ".join(f"('{f}')" for f in TRADE_FOCUS)
EXPAND_NODE = f"""WITH {_ALL_TRADE} SELECT f AS focus, source_id, relationship, target_id,
 CASE rnk WHEN 0 THEN 'exact' WHEN 1 THEN 'inferred' ELSE 'unresolved' END AS resolution
 FROM alledges JOIN (VALUES {_FOCUS_VALUES}) t(f) ON f = source_id OR f = target_id"""


def graph_context(spark: SparkSession, sf: str) -> DataFrame:
    allowed = GR.relation_whitelist(["CALLS", "DROP TABLE"])
    focus = W.start_nodes(spark, *TRADE_FOCUS)
    return GR.neighbourhood(focus, GR.strongest_edges(GR.edges_at(focus, W.trade_graph(spark, sf))), allowed).drop(*KEYS)


GRAPH_CONTEXT = EXPAND_NODE + " WHERE relationship = 'CALLS'"


def callers(spark: SparkSession, sf: str) -> DataFrame:
    """Direct confirmed callers of one supplier."""
    out = GR.impact(W.start_nodes(spark, "supplier:4"), W.trade_graph(spark, sf), "upstream", max_depth=1)
    return out.where(F.col("category") != "unresolved").select("node", "resolution")


CALLERS = f"""WITH {_trade_impact()} SELECT node, CASE rnk WHEN 0 THEN 'exact' ELSE 'inferred' END AS resolution FROM imp
 WHERE start = 'supplier:4' AND direction = 'upstream' AND rnk < 2"""


def callees(spark: SparkSession, sf: str) -> DataFrame:
    """Direct confirmed callees of one customer."""
    out = GR.impact(W.start_nodes(spark, "customer:11"), W.trade_graph(spark, sf), "downstream", max_depth=1)
    return out.where(F.col("category") != "unresolved").select("node", "resolution")


CALLEES = f"""WITH {_trade_impact()} SELECT node, CASE rnk WHEN 0 THEN 'exact' ELSE 'inferred' END AS resolution FROM imp
 WHERE start = 'customer:11' AND direction = 'downstream' AND rnk < 2"""


def subgraph_filter(spark: SparkSession, sf: str) -> DataFrame:
    return GR.filter_subgraph(W.trade_nodes(spark, sf), GR.strongest_edges(W.trade_graph(spark, sf)),
                              ["Class", "File"], ["CONTAINS", "CALLS"]).select("source_id", "relationship", "target_id")


SUBGRAPH_FILTER = f"SELECT {S.ident('region','n_regionkey')} AS source_id, 'CONTAINS' AS relationship, {S.ident('nation','n_nationkey')} AS target_id FROM nation"


def edge_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return GR.strongest_edges(W.module_edges(spark, sf)).drop(*KEYS)


EDGE_CONFIDENCE = f"""WITH {S.EDGES} SELECT source_id, relationship, target_id, CASE min(rnk) WHEN 0 THEN 'exact' WHEN 1 THEN 'inferred' ELSE 'unresolved' END AS resolution
 FROM edges GROUP BY 1, 2, 3"""

QUERIES = {
    "impact_upstream": (impact_upstream, _bfs_sql("target_id", "source_id")),
    "impact_downstream": (impact_downstream, _bfs_sql("source_id", "target_id")),
    "impact_members": (impact_members, IMPACT_MEMBERS),
    "impact_containers": (impact_containers, IMPACT_CONTAINERS),
    "impact_summary": (impact_summary, IMPACT_SUMMARY),
    "impact_counts": (impact_counts, IMPACT_COUNTS),
    "callers": (callers, CALLERS),
    "callees": (callees, CALLEES),
    "traverse_downstream": (traverse_downstream, TRAVERSE_DOWN),
    "traverse_upstream": (traverse_upstream, TRAVERSE_UP),
    "dependency_paths": (dependency_paths, DEPENDENCY_PATHS),
    "http_chains": (http_chains, HTTP_CHAINS),
    "path_explanations": (path_explanations, PATH_EXPLANATIONS),
    "transitive_dependents": (transitive_dependents, TRANSITIVE),
    "arch_hotspots": (arch_hotspots, ARCH_HOTSPOTS),
    "cycles": (cycles, CYCLES),
    "elementary_cycles": (elementary_cycles, ELEMENTARY_CYCLES),
    "overview_subgraph": (overview_subgraph, OVERVIEW),
    "expand_node": (expand_node, EXPAND_NODE),
    "graph_context": (graph_context, GRAPH_CONTEXT),
    "subgraph_filter": (subgraph_filter, SUBGRAPH_FILTER),
    "edge_confidence": (edge_confidence, EDGE_CONFIDENCE),
}
