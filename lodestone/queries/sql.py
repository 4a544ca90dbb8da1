"""SQL fragments the reference statements share; they mirror ``lodestone.sources.warehouse``."""

from __future__ import annotations

from lodestone.sources.warehouse import RELATIONSHIP_OF_LINE, ROLE_OF_TYPE
from lodestone import vocab


def module(key: str) -> str:
    return f"concat('src.m', CAST(CAST(floor({key}/20) AS BIGINT) AS VARCHAR), '.f', CAST({key} AS VARCHAR))"


def path(key: str) -> str:
    return f"concat('src/m', CAST(CAST(floor({key}/20) AS BIGINT) AS VARCHAR), '/f', CAST({key} AS VARCHAR), '.py')"


def ident(kind: str, key: str) -> str:
    return f"concat('{kind}:', CAST({key} AS VARCHAR))"


def case(column: str, mapping: dict, otherwise: str | None = None) -> str:
    arms = " ".join(f"WHEN {k if isinstance(k, int) else repr(k)} THEN '{v}'" for k, v in mapping.items())
    tail = f" ELSE '{otherwise}'" if otherwise else ""
    return f"CASE {column} {arms}{tail} END"


RESOLUTION = "CASE l_returnflag WHEN 'A' THEN 'exact' WHEN 'N' THEN 'inferred' ELSE 'unresolved' END"
RANK = "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"
RELATIONSHIP = case("l_linenumber", RELATIONSHIP_OF_LINE)
ROLE = case("p_type", ROLE_OF_TYPE, "unknown")


def layer(role: str) -> str:
    return case(role, vocab.ROLE_TO_LAYER, "unknown")


CHANGES = f"""changes AS (SELECT CAST(l_orderkey AS VARCHAR) AS commit_sha, {path('l_partkey')} AS file_path,
  l_returnflag AS change_type, CAST(l_quantity AS INT) AS insertions, l_linenumber AS deletions FROM lineitem)"""
COMMITS = """commits AS (SELECT CAST(o_orderkey AS VARCHAR) AS commit_sha,
  concat('Customer ', CAST(o_custkey AS VARCHAR)) AS author_name, concat(CAST(o_custkey AS VARCHAR), '@shop') AS author_email,
  o_orderdate AS committed_at, o_orderpriority AS message FROM orders)"""
EDGES = f"""edges AS (SELECT l_linestatus AS snapshot_id, {module('l_partkey')} AS source_id, {RELATIONSHIP} AS relationship,
  {module('l_suppkey')} AS target_id, {RESOLUTION} AS resolution, {RANK} AS rnk FROM lineitem)"""
NODES = f"nodes AS (SELECT {module('p_partkey')} AS id, p_size AS cc FROM part)"


def schema_graph(supply: bool = True) -> str:
    parts = [
        f"SELECT {ident('nation','n_nationkey')} AS source_id, 'IMPORTS' AS relationship, {ident('region','n_regionkey')} AS target_id, 0 AS rnk FROM nation",
        f"SELECT {ident('customer','c_custkey')}, 'CALLS', {ident('nation','c_nationkey')}, 0 FROM customer",
        f"SELECT {ident('supplier','s_suppkey')}, 'CALLS', {ident('nation','s_nationkey')}, 0 FROM supplier",
        f"SELECT {ident('order','o_orderkey')}, 'CALLS', {ident('customer','o_custkey')}, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END FROM orders",
        f"SELECT {ident('order','l_orderkey')}, 'REQUESTS', {ident('part','l_partkey')}, {RANK} FROM lineitem",
    ]
    if supply:
        parts.append(f"SELECT {ident('part','l_partkey')}, 'HANDLED_BY', {ident('supplier','l_suppkey')}, 0 FROM lineitem")
    return ("raw_graph AS (" + " UNION ALL ".join(parts) + "), graph AS (SELECT source_id, relationship, target_id, "
            "min(rnk) AS rnk FROM raw_graph GROUP BY ALL)")


TRADE = f"""bought AS (SELECT {ident('customer','o_custkey')} AS source_id, {ident('supplier','l_suppkey')} AS target_id,
   min({RANK}) AS rnk FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
 contains AS (SELECT {ident('region','n_regionkey')} AS a, {ident('nation','n_nationkey')} AS m FROM nation
   UNION ALL SELECT {ident('nation','c_nationkey')}, {ident('customer','c_custkey')} FROM customer
   UNION ALL SELECT {ident('nation','s_nationkey')}, {ident('supplier','s_suppkey')} FROM supplier),
 members AS (SELECT a, m FROM contains UNION SELECT x.a, y.m FROM contains x JOIN contains y ON x.m = y.a)"""


def closing_paths(name: str, links: str) -> str:
    """Recursive part: the first shortest path (start, node, members, types) through nodes above its start.

    ``links`` has s, t and the list ``types``; a path is wanted only where an edge can come back to its start.
    """
    return f"""{name}(start, node, members, types) USING KEY (start, node) AS (
 SELECT s, t, [s, t], types FROM {links} WHERE s < t AND s IN (SELECT t FROM {links} WHERE s > t)
 UNION SELECT start, node, best.members, best.types FROM (
  SELECT g.start, l.t AS node, min(struct_pack(members := list_append(g.members, l.t), types := list_concat(g.types, l.types))) AS best
  FROM {name} g JOIN {links} l ON l.s = g.node LEFT JOIN recurring.{name} k ON k.start = g.start AND k.node = l.t
  WHERE l.t > g.start AND k.start IS NULL GROUP BY 1, 2))"""
