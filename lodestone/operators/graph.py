"""Graph operators over an edge table: breadth-first impact, closure, simple paths, cycles.

Every operator works on all snapshots at once. Iterations are frontier joins; each level is
written to the reliable checkpoint folder, so plans stay short and a lost executor costs one
level, not the whole loop. Sizes are only read back as row counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import count

from functools import partial, reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from lodestone import vocab
from lodestone.functions import columns as C
from lodestone.operators import reach, shortest
from lodestone.session import cut_lineage

KEYS = vocab.KEYS

# Frontiers up to this many bytes go to every task; a larger one meets the edges by a shuffle.
SMALL_FRONTIER = 8 << 20
# So many ranges of ids at most are tested one by one.
MAX_RANGES = 16


def distinct_edges(edges: DataFrame, relationships: list[str] | None = None,
                   confidences: list[str] | None = None, drop_loops: bool = True) -> DataFrame:
    """Distinct (source, target) pairs, filtered before the shuffle."""
    kept = edges
    if relationships is not None:
        kept = kept.where(F.col("relationship").isin(relationships))
    if confidences is not None:
        kept = kept.where(F.col("resolution").isin(confidences))
    if drop_loops:
        kept = kept.where(F.col("source_id") != F.col("target_id"))
    return kept.select(*KEYS, "source_id", "target_id").distinct()


def strongest_edges(edges: DataFrame) -> DataFrame:
    """One row per edge identity, with its strongest confidence."""
    return edges.groupBy(*KEYS, "source_id", "relationship", "target_id").agg(
        F.min(C.confidence_rank(F.col("resolution"))).alias("rank")
    ).withColumn("resolution", C.confidence_label(F.col("rank"))).drop("rank")


def _unite(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# ----------------------------------------------------------------------------- frontiers

class Frontier(NamedTuple):
    """Nodes a level starts from, in at most two parts: one counted small enough to broadcast, one that meets edges by a shuffle.

    Each part carries the ranges its ids lie in, so edges between other kinds of ids leave at the scan, before any join or shuffle.
    """
    parts: list[tuple[DataFrame, Callable[[Column], Column]]]
    shuffled: bool


def _within(ranges: list[Row]) -> Callable[[Column], Column]:
    """Test for ids inside one of the ranges; inside the span of all where these are many."""
    spans = [(r.low, r.high) for r in ranges]
    if len(spans) > MAX_RANGES:
        spans = [(min(ranges, key=lambda r: r.first).low, max(ranges, key=lambda r: r.first).high)]
    return lambda c: reduce(Column.__or__, [c.between(F.lit(low), F.lit(high)) for low, high in spans])


def _frontier(level: DataFrame, column: str) -> tuple[Frontier, int]:
    """Nodes of a written level and its number of rows; broadcast only where their bytes were counted to be few.

    Ids are counted by their first character, a handful of rows: a kind with few ids is broadcast although another has many.
    """
    nodes = level.select(*KEYS, F.col(column).alias("node"))
    first = F.least(F.ascii("node"), F.lit(255))
    kinds = nodes.groupBy(first.alias("first")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("node")).alias("b"),
        F.min("node").alias("low"), F.max("node").alias("high")).collect()
    small, large, size = [], [], 0
    # A null id meets no edge.
    for kind in sorted((k for k in kinds if k.low is not None), key=lambda k: (k.b + 64 * k.n, k.first)):
        size += kind.b + 64 * kind.n
        (small if size <= SMALL_FRONTIER else large).append(kind)
    parts = []
    if small:
        parts.append((F.broadcast(nodes.where(first.isin([k.first for k in small])) if large else nodes), _within(small)))
    if large:
        parts.append(((nodes.where(first.isin([k.first for k in large])) if small else nodes).distinct(), _within(large)))
    return Frontier(parts, bool(large)), sum(k.n for k in kinds)


def _touching(edges: DataFrame, nodes: Frontier, side: str) -> DataFrame:
    """Edges whose ``side`` end is one of ``nodes``: only these leave the scan where the nodes are few."""
    found = [edges.where(within(F.col(side))).join(ids.withColumnRenamed("node", side), [side, *KEYS], "left_semi")
             for ids, within in nodes.parts]
    return _unite(found) if found else edges.limit(0)


def _may_meet(edges: DataFrame, nodes: Frontier, side: str) -> bool:
    """False only where no edge's ``side`` end lies in the ranges of a frontier that would be shuffled: a scan that ends at
    the first such edge, so a last, largest level is not moved to find nothing."""
    if not nodes.shuffled:
        return True
    return not edges.where(reduce(Column.__or__, [within(F.col(side)) for _, within in nodes.parts])).isEmpty()


# ------------------------------------------------------------------ impact (breadth first)

def _members_of(contains: DataFrame, nodes: Frontier) -> DataFrame | None:
    """(ancestor, member) pairs one or two CONTAINS hops below the given nodes; None where these contain nothing."""
    one = cut_lineage(_touching(contains, nodes, "source_id").select(
        *KEYS, F.col("source_id").alias("ancestor"), F.col("target_id").alias("member")))
    below, found = _frontier(one, "member")
    if not found:
        return None
    two = (_touching(contains, below, "source_id").select(*KEYS, F.col("source_id").alias("member"), "target_id")
           .join(one, ["member", *KEYS]).select(*KEYS, "ancestor", F.col("target_id").alias("member")))
    return cut_lineage(one.unionByName(two).distinct())


def containment_pairs(contains: DataFrame) -> DataFrame:
    """(ancestor, member) pairs one or two CONTAINS hops apart."""
    one = contains.select(*KEYS, F.col("source_id").alias("ancestor"), F.col("target_id").alias("member"))
    two = (one.join(contains.select(*KEYS, F.col("source_id").alias("member"), "target_id"), ["member", *KEYS])
           .select(*KEYS, "ancestor", F.col("target_id").alias("member")))
    return one.unionByName(two).distinct()


def impact_neighbours(edges: DataFrame, direction: str, nodes: Frontier) -> DataFrame | None:
    """(node, neighbour, rank) of the given nodes: their direct edges, and edges of what they contain; None where there are none."""
    near, far = ("target_id", "source_id") if direction == "upstream" else ("source_id", "target_id")
    rank = C.confidence_rank(F.col("resolution")).alias("rank")
    direct, contains = edges.where(F.col("relationship").isin(vocab.IMPACT_RELATIONSHIPS)), edges.where(F.col("relationship") == "CONTAINS")
    holds = _may_meet(contains, nodes, "source_id")
    if not holds and not _may_meet(direct, nodes, near):
        return None
    found = (_touching(direct, nodes, near)
             .select(*KEYS, F.col(near).alias("node"), F.col(far).alias("neighbour"), rank))
    members = _members_of(contains, nodes) if holds else None
    if members is not None:
        inner, _ = _frontier(members, "member")
        found = found.unionByName(
            _touching(edges.where(F.col("relationship").isin(vocab.MEMBER_IMPACT_RELATIONSHIPS)), inner, near)
            .select(*KEYS, F.col(near).alias("member"), F.col(far).alias("neighbour"), rank)
            .join(members, ["member", *KEYS])
            .where((F.col("neighbour") != F.col("ancestor")) & (F.col("neighbour") != F.col("member")))
            .select(*KEYS, F.col("ancestor").alias("node"), "neighbour", "rank"))
    # The strongest of parallel edges is met first, so the weaker ones can never matter.
    return found.groupBy(*KEYS, "node", "neighbour").agg(F.min("rank").alias("rank"))


def _depths(bound: int | None) -> Iterable[int]:
    """1, 2, ... up to the caller's bound; without one the caller's loop ends when nothing new is found."""
    if bound is not None and bound < 0:
        raise ValueError("a depth cannot be below zero")
    return count(1) if bound is None else range(1, bound + 1)


def breadth_first(starts: DataFrame, neighbours: Callable[[Frontier], DataFrame | None], max_depth: int | None = None) -> DataFrame:
    """First visit of every node reachable from each start.

    ``neighbours`` gives (node, neighbour, rank) of the nodes it is handed, or None: each level reads edges of its frontier only.
    ``trail`` lists (rank, node) per hop. Comparing trails compares queue positions level by
    level, so the smallest trail is the visit a queue would make first. A node first met through
    an unresolved edge is reported but not expanded. Returns ``start, node, distance, edge_rank,
    path_rank, trail`` without the start itself.
    """
    trail_type = "array<struct<rank:int,node:string>>"
    frontier = starts.select(
        *KEYS, "start", F.col("start").alias("node"),
        F.lit(0).alias("path_rank"), F.array().cast(trail_type).alias("trail"))
    visited = starts.select(*KEYS, "start", F.col("start").alias("node"))
    levels: list[DataFrame] = []
    for depth in _depths(max_depth):
        nodes, found = _frontier(frontier, "node")
        around = neighbours(nodes) if found else None
        if around is None:
            break
        step = (
            frontier.join(around, ["node", *KEYS])
            .select(*KEYS, "start", F.col("neighbour").alias("node"), F.col("rank").alias("edge_rank"),
                    F.greatest("path_rank", "rank").alias("path_rank"),
                    F.concat("trail", F.array(F.struct(F.col("rank").cast("int").alias("rank"),
                                                       F.col("neighbour").alias("node")))).alias("trail"))
            .join(visited, ["start", "node", *KEYS], "left_anti")
            .groupBy(*KEYS, "start", "node")
            .agg(F.min_by(F.struct("edge_rank", "path_rank", "trail"), "trail").alias("first"))
            .select(*KEYS, "start", "node", F.lit(depth).alias("distance"), "first.*")
        )
        level = cut_lineage(step)
        if level.isEmpty():
            break
        levels.append(level)
        visited = visited.unionByName(level.select(*KEYS, "start", "node"))
        frontier = level.where(F.col("edge_rank") < 2).select(*KEYS, "start", "node", "path_rank", "trail")
    if not levels:
        return cut_lineage(frontier.limit(0).select(
            *KEYS, "start", "node", F.lit(0).alias("distance"), F.lit(0).alias("edge_rank"), "path_rank", "trail"))
    return _unite(levels)


def impact(starts: DataFrame, edges: DataFrame, direction: str = "both", max_depth: int | None = None) -> DataFrame:
    """Blast radius of each start: one row per (start, direction, node).

    ``category`` is direct, indirect or unresolved; ``resolution`` is the weakest along the path.
    """
    sides = ["upstream", "downstream"] if direction == "both" else [direction]
    found = []
    for side in sides:
        visits = breadth_first(starts, partial(impact_neighbours, edges, side), max_depth)
        category = (F.when(F.col("edge_rank") == 2, "unresolved")
                    .when(F.col("distance") == 1, "direct").otherwise("indirect"))
        found.append(visits.select(
            *KEYS, "start", F.lit(side).alias("direction"), "node", "distance", category.alias("category"),
            C.confidence_label(F.col("path_rank")).alias("resolution"),
            F.col("trail.node").alias("path")))
    return _unite(found)


def impact_containers(impacted: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (start, container kind, container) of the confirmed impacted nodes."""
    ids = impacted.where(F.col("category") != "unresolved").select(*KEYS, "start", "node").distinct()
    kinds = nodes.where(F.col("label").isin("File", "Module", "Class")).select(
        *KEYS, F.col("id").alias("container"), F.lower("label").alias("container_kind"))
    around = containment_pairs(edges.where(F.col("relationship") == "CONTAINS")).select(
        *KEYS, F.col("ancestor").alias("container"), F.col("member").alias("node"))
    outer = ids.join(around, ["node", *KEYS]).select(*KEYS, "start", "node", "container")
    enclosed = outer.join(kinds, ["container", *KEYS])
    own = ids.select(*KEYS, "start", "node", F.col("node").alias("container")).join(kinds, ["container", *KEYS])
    # A node that is itself a container counts only where no container of that kind encloses it.
    alone = own.join(enclosed.select(*KEYS, "start", "node", "container_kind").distinct(),
                     ["start", "node", "container_kind", *KEYS], "left_anti")
    columns = ["start", "container_kind", "container", *KEYS]
    return enclosed.select(*columns).unionByName(alone.select(*columns)).distinct()


def impact_summary(impacted: DataFrame, containers: DataFrame, max_nodes: int = 500, directions: int = 2) -> DataFrame:
    """One row per start: counts per category and container kind, depth reached, truncation flag.

    All rows are kept; ``truncated`` only reports that a search bounded to ``max_nodes`` visits
    (start included) would have stopped early.
    """
    def count_of(direction: str, category: str) -> Column:
        return F.count_if((F.col("direction") == direction) & (F.col("category") == category))

    counts = impacted.groupBy(*KEYS, "start").agg(
        count_of("upstream", "direct").alias("direct_callers"),
        count_of("upstream", "indirect").alias("indirect_callers"),
        count_of("downstream", "direct").alias("direct_callees"),
        count_of("downstream", "indirect").alias("indirect_callees"),
        F.max("distance").alias("actual_depth_reached"),
        F.count_if(F.col("direction") == "upstream").alias("_up"),
        F.count_if(F.col("direction") == "downstream").alias("_down"),
    )
    unresolved = (impacted.where(F.col("category") == "unresolved").select(*KEYS, "start", "node").distinct()
                  .groupBy(*KEYS, "start").agg(F.count(F.lit(1)).alias("unresolved_references")))
    affected = containers.groupBy(*KEYS, "start").agg(
        *[F.count_if(F.col("container_kind") == kind).alias(name)
          for kind, name in (("file", "affected_files"), ("module", "affected_modules"), ("class", "affected_classes"))])
    joined = counts.join(unresolved, ["start", *KEYS], "left").join(affected, ["start", *KEYS], "left")
    filled = joined.na.fill(0, ["unresolved_references", "affected_files", "affected_modules", "affected_classes"])
    return filled.withColumn("nodes_visited", F.col("_up") + F.col("_down") + F.lit(directions)).withColumn(
        "truncated", (F.col("_up") + 1 >= max_nodes) | (F.col("_down") + 1 >= max_nodes)).drop("_up", "_down")


# ---------------------------------------------------------------------- reachability

def reachable_pairs(starts: DataFrame, links: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Distinct (start, node) with node reachable from start along ``links(node, neighbour)``.

    Semi-naive: each round joins only the pairs found in the round before, removes the pairs
    already seen, and stops when nothing is new. The start itself is not reported.
    """
    delta = starts.select(*KEYS, "start", F.col("start").alias("node")).distinct()
    seen = delta
    found: list[DataFrame] = []
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = (delta.join(links, ["node", *KEYS])
                .select(*KEYS, "start", F.col("neighbour").alias("node")).distinct()
                .join(seen, ["start", "node", *KEYS], "left_anti"))
        delta = cut_lineage(step)
        if delta.isEmpty():
            break
        found.append(delta)
        seen = seen.unionByName(delta)
    if not found:
        return delta
    return _unite(found)


def transitive_dependents(edges: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Number of nodes that reach each target, by components and compressed sets; ``targets`` restricts what is reported."""
    nodes, links = reach.numbered(edges)
    named = (reach.reaching_counts(links).join(nodes, "node")
             .select(*KEYS, F.col("id").alias("start"), F.col("n").alias("transitive_dependents")))
    return named if targets is None else named.join(targets.select(*KEYS, "start"), ["start", *KEYS], "left_semi")


# --------------------------------------------------------------------------- simple paths

def _path_edges(edges: DataFrame, upstream: bool, nodes: Frontier | None = None) -> DataFrame:
    """Edges as steps from ``end`` to ``_next``, one per edge identity; those that leave ``nodes`` where given."""
    near, far = ("target_id", "source_id") if upstream else ("source_id", "target_id")
    kept = edges if nodes is None else _touching(edges, nodes, near)
    return strongest_edges(kept).select(
        *KEYS, F.col(near).alias("end"), F.col(far).alias("_next"),
        F.struct(F.col("source_id").alias("source"), F.col("relationship").alias("relationship"),
                 F.col("target_id").alias("target"), F.col("resolution").alias("resolution")).alias("_step"))


def _extend(level: DataFrame, links: DataFrame) -> DataFrame:
    return (level.join(links, ["end", *KEYS])
            .where(~F.array_contains("nodes", F.col("_next")))
            .select(*KEYS, "start", F.col("_next").alias("end"),
                    F.concat("nodes", F.array("_next")).alias("nodes"),
                    F.concat("steps", F.array("_step")).alias("steps")))


_STEPS = "array<struct<source:string,relationship:string,target:string,resolution:string>>"


def _first_level(starts: DataFrame) -> DataFrame:
    return starts.select(*KEYS, "start", F.col("start").alias("end"), F.array("start").alias("nodes"),
                         F.array().cast(_STEPS).alias("steps"))


def _finish(paths: DataFrame) -> DataFrame:
    weak = F.exists("steps", lambda s: s["resolution"] != "exact")
    extra = ["direction"] if "direction" in paths.columns else []
    return paths.select(
        *KEYS, "start", *extra, "end", F.size("steps").alias("length"),
        F.when(weak, "inferred").otherwise("exact").alias("confidence"), "nodes", "steps")


def traverse(starts: DataFrame, edges: DataFrame, direction: str = "downstream",
             relationships: list[str] | None = None, max_depth: int | None = None) -> DataFrame:
    """Every simple path (no repeated node) from each start, of at most ``max_depth`` edges where that is given."""
    kept = edges.where(F.col("relationship").isin(relationships or vocab.TRAVERSAL_RELATIONSHIPS))
    sides = ["downstream", "upstream"] if direction == "both" else [direction]
    levels = []
    for side in sides:
        level = _first_level(starts)
        for _ in _depths(max_depth):
            nodes, found = _frontier(level, "end")
            if not found or not _may_meet(kept, nodes, "target_id" if side == "upstream" else "source_id"):
                break
            level = cut_lineage(_extend(level, _path_edges(kept, side == "upstream", nodes)))
            levels.append(level.withColumn("direction", F.lit(side)))
    if not levels:
        return _finish(_first_level(starts).limit(0).withColumn("direction", F.lit(sides[0])))
    return _finish(_unite(levels))


def edges_between(pairs: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Edges that may lie on a path from a start to a goal, found from both ends.

    The end with fewer nodes at its frontier advances by one edge, until both together have gone ``max_depth`` edges, or one end has
    nothing left. An edge of a path of that length is then out of a node the starts' end has opened, or into one the goals' end has.
    """
    frontier, size, opened, gone = {}, {}, {}, 0
    for near, column in (("source_id", "start"), ("target_id", "goal")):
        opened[near] = [cut_lineage(pairs.select(*KEYS, F.col(column).alias("node")).distinct())]
        frontier[near], size[near] = _frontier(opened[near][0], "node")
    met = []
    while min(size.values()) > 0 and (max_depth is None or gone < max_depth):
        near = min(size, key=size.get)
        far = "target_id" if near == "source_id" else "source_id"
        met.append(cut_lineage(strongest_edges(_touching(edges, frontier[near], near))))
        reached = met[-1].select(*KEYS, F.col(far).alias("node")).distinct().join(
            _unite(opened[near]), ["node", *KEYS], "left_anti")
        opened[near].append(cut_lineage(reached))
        frontier[near], size[near] = _frontier(opened[near][-1], "node")
        gone += 1
    return _unite(met) if met else strongest_edges(edges.limit(0))


def find_paths(pairs: DataFrame, edges: DataFrame, relationships: list[str] | None = None,
               max_depth: int | None = None) -> DataFrame:
    """Every simple path between each (start, goal) pair; a path ends at its goal.

    Only edges met from both ends are searched. Partial paths are kept only while their end can still reach the goal within the
    remaining hops, which a backward search over these edges decides first.
    """
    if max_depth is not None and max_depth < 0:
        raise ValueError("a depth cannot be below zero")
    wanted = cut_lineage(pairs.where(F.col("start") != F.col("goal")).select(*KEYS, "start", "goal").distinct())
    kept = edges if relationships is None else edges.where(F.col("relationship").isin(relationships))
    links = cut_lineage(_path_edges(edges_between(wanted, kept, max_depth), upstream=False))
    useful = _hops_to_goal(wanted, links, max_depth)
    open_paths = _first_level(wanted.select(*KEYS, "start").distinct()).join(wanted, ["start", *KEYS])
    hits = []
    for depth in _depths(max_depth):
        grown = (open_paths.join(links, ["end", *KEYS])
                 .where(~F.array_contains("nodes", F.col("_next")))
                 .select(*KEYS, "start", "goal", F.col("_next").alias("end"),
                         F.concat("nodes", F.array("_next")).alias("nodes"),
                         F.concat("steps", F.array("_step")).alias("steps")))
        near = useful if max_depth is None else useful.where(F.col("hops") <= max_depth - depth)
        grown = grown.join(near.select(*KEYS, "goal", "end"),
                           ["goal", "end", *KEYS], "left_semi")
        level = cut_lineage(grown)
        if level.isEmpty():
            break
        hits.append(level.where(F.col("end") == F.col("goal")).drop("goal"))
        open_paths = level.where(F.col("end") != F.col("goal"))
    if not hits:
        return _finish(_first_level(pairs).limit(0))
    return _finish(_unite(hits))


def _hops_to_goal(pairs: DataFrame, links: DataFrame, max_depth: int | None) -> DataFrame:
    backward = links.select(*KEYS, F.col("_next").alias("end"), F.col("end").alias("previous")).distinct()
    level = pairs.select(*KEYS, "goal", F.col("goal").alias("end"), F.lit(0).alias("hops")).distinct()
    reached = [level]
    for hop in _depths(None if max_depth is None else max_depth - 1):
        seen = _unite(reached).select(*KEYS, "goal", "end")
        level = cut_lineage(
            level.join(backward, ["end", *KEYS])
            .select(*KEYS, "goal", F.col("previous").alias("end"), F.lit(hop).alias("hops")).distinct()
            .join(seen, ["goal", "end", *KEYS], "left_anti"))
        if level.isEmpty():
            break
        reached.append(level)
    return _unite(reached)


def http_chains(starts: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Request chains: simple paths over the chain relations that end at a node with no way on.

    A chain needs at least two edges; a path cut off at ``max_depth`` or ending among visited
    nodes is not a chain.
    """
    if max_depth is not None and max_depth < 1:
        raise ValueError("a chain cannot be that short")
    kept = edges.where(F.col("relationship").isin(vocab.HTTP_CHAIN_RELATIONSHIPS))
    level, chains, depth = _first_level(starts), [], 0
    while True:
        nodes, found = _frontier(level, "end")
        if not found:
            break
        links = cut_lineage(_path_edges(kept, False, nodes))
        if depth >= 2:
            chains.append(level.join(links.select(*KEYS, "end").distinct(), ["end", *KEYS], "left_anti"))
        depth += 1
        if depth == max_depth:
            break
        level = cut_lineage(_extend(level, links))
    if not chains:
        return _finish(_first_level(starts).limit(0))
    return _finish(_unite(chains))


# --------------------------------------------------------------------------------- cycles

def cyclic_core(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """Drop edges that cannot lie on a cycle: source never entered, or target never left.

    Pruning only; a fixed number of rounds keeps the plan short and changes no result.
    """
    core = edges
    for _ in range(rounds):
        entered = core.select(*KEYS, F.col("target_id").alias("source_id")).distinct()
        left = core.select(*KEYS, F.col("source_id").alias("target_id")).distinct()
        core = cut_lineage(core.join(entered, ["source_id", *KEYS], "left_semi")
                           .join(left, ["target_id", *KEYS], "left_semi"))
    return core


def _cycle_rows(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("relationship").isin(vocab.CYCLE_RELATIONSHIPS)
                       & F.col("resolution").isin(vocab.CONFIRMED)
                       & (F.col("source_id") != F.col("target_id")))


def _turning(edges: DataFrame) -> DataFrame:
    """Edges cycles are made of whose source such an edge enters: the others are dropped before anything is grouped or moved."""
    rows = _cycle_rows(edges)
    entered, _ = _frontier(cut_lineage(rows.select(*KEYS, "target_id").distinct()), "target_id")
    return _touching(rows, entered, "source_id")


def cycle_edges(edges: DataFrame) -> DataFrame:
    """Confirmed edges of the relationships cycles are made of, one row per pair, without loops."""
    return _cycle_rows(edges).groupBy(*KEYS, "source_id", "target_id").agg(F.collect_set("relationship").alias("_types"))


def _described_cycles(closed: DataFrame) -> DataFrame:
    path = F.array_join("members", "->")
    arrows = F.array_join(F.concat("members", F.array(F.element_at("members", 1))), " -> ")
    size = F.size("members")
    return closed.select(
        *KEYS, F.concat(F.lit("cycle:"), path).alias("cycle_id"), "members",
        F.array_sort("types").alias("relationship_types"),
        F.when(size == 2, "medium").otherwise("high").alias("severity"),
        F.concat(F.lit("Circular dependency involving "), size.cast("string"), F.lit(" components: "), arrows)
        .alias("description"))


def cycles(edges: DataFrame, max_length: int | None = 5) -> DataFrame:
    """Elementary cycles of at least two nodes, each once, its smallest node first.

    Paths grow only through nodes greater than their start, so a cycle is found exactly once, in
    canonical rotation. ``max_length=None`` searches until no path can grow.
    """
    core = cyclic_core(cut_lineage(cycle_edges(edges)))
    links = core.select(*KEYS, F.col("source_id").alias("end"), F.col("target_id").alias("_next"), "_types")
    level = core.where(F.col("source_id") < F.col("target_id")).select(
        *KEYS, F.col("source_id").alias("start"), F.col("target_id").alias("end"),
        F.array("source_id", "target_id").alias("members"), F.col("_types").alias("types"))
    closed = []
    length = 2
    while True:
        step = cut_lineage(
            level.join(links, ["end", *KEYS])
            .where((F.col("_next") == F.col("start"))
                   | ((F.col("_next") > F.col("start")) & ~F.array_contains("members", F.col("_next"))))
            .select(*KEYS, "start", F.col("_next").alias("end"), "members",
                    F.array_union("types", "_types").alias("types")))
        closed.append(step.where(F.col("end") == F.col("start")).drop("end"))
        length += 1
        level = step.where(F.col("end") != F.col("start")).withColumn(
            "members", F.concat("members", F.array("end")))
        if (max_length is not None and length > max_length) or level.isEmpty():
            break
    return _described_cycles(_unite(closed))


def closing_cycles(edges: DataFrame) -> DataFrame:
    """One shortest cycle for every closing edge, of whatever length: cycles without an enumeration of all.

    Every cycle has a smallest node, and an edge that comes back to it from a greater one. For each
    such edge the result holds the shortest cycle it closes among the nodes from its target up;
    of equally short ones the first in the order of their nodes. Each cycle appears once, its
    smallest node first. Every cycle of the graph has its closing edge among the rows, so a graph
    has rows exactly where it has cycles.

    Strongly connected components are found first, and only edges inside one are followed, as numbers that keep the order of ids.
    Searches run from both ends of what a closing edge asks for, its target and its source, a side of fewer rows first, and stop for
    an edge when they meet: neither goes through the whole component where a cycle is short. Components of few edges, which are
    counted, go to every task for that.
    """
    typed = cut_lineage(cycle_edges(_turning(edges)))
    nodes, numbers = reach.numbered(typed)
    members = cut_lineage(nodes.join(reach.components(numbers), "node").select(*KEYS, "id"))
    ordered = cut_lineage(members.orderBy(*KEYS, "id").withColumn("node", F.monotonically_increasing_id()))
    inside = cut_lineage(
        typed.join(ordered.select(*KEYS, F.col("id").alias("source_id"), F.col("node").alias("s")), ["source_id", *KEYS])
        .join(ordered.select(*KEYS, F.col("id").alias("target_id"), F.col("node").alias("t")), ["target_id", *KEYS])
        .select("s", "t", "_types"))
    links = inside.select("s", "t")
    wanted = cut_lineage(inside.where("s > t").select(F.col("t").alias("start"), F.col("s").alias("end")))
    small = links.count() <= shortest.MOST_EDGES
    found = cut_lineage(shortest.paths(wanted, links) if small else shortest_above(wanted, links))
    # Ids and relationships of the members, put back by their place in the cycle.
    placed = found.select("start", "end", F.posexplode("members").alias("place", "node"))
    named = (placed.join(ordered, "node").groupBy(*KEYS, "start", "end")
             .agg(F.array_sort(F.collect_list(F.struct("place", "id"))).alias("_places"))
             .select(*KEYS, "start", "end", F.col("_places.id").alias("members")))
    hops = found.select("start", "end", F.explode(F.arrays_zip(
        F.col("members").alias("s"), F.concat(F.slice("members", F.lit(2), F.size("members") - 1), F.array("start")).alias("t"))).alias("hop"))
    types = (hops.select("start", "end", "hop.s", "hop.t").join(inside, ["s", "t"])
             .groupBy("start", "end").agg(F.array_distinct(F.flatten(F.collect_list("_types"))).alias("types")))
    return _described_cycles(named.join(types, ["start", "end"]).select(*KEYS, "members", "types"))


def shortest_above(wanted: DataFrame, links: DataFrame) -> DataFrame:
    """``start, end, members``: the first shortest path of ``links`` (s, t) from start to end whose other nodes are greater than start.

    Of equally short paths the first is that of the smallest nodes in order. The side of the starts holds the first path to each node,
    shared by all ends of a start; the side of the ends the first path from each node to its end. All paths of one level are
    equally long, so the first path over a node is the first one to it and the first one from it.
    """
    ahead = wanted.select("start").distinct().select("start", F.col("start").alias("node"), F.array("start").alias("way"))
    back = wanted.select("start", "end", F.col("end").alias("node"), F.array("end").alias("way"))
    ahead, back, pending = cut_lineage(ahead), cut_lineage(back), wanted
    seen, known, found = ahead.select("start", "node"), back.select("start", "end", "node"), []
    here, there = ahead.count(), back.count()
    while here and there:
        if here <= there:
            grown = (ahead.withColumnRenamed("node", "s").join(links, "s").where("t > start")
                     .select("start", F.col("t").alias("node"), F.concat("way", F.array("t")).alias("way"))
                     .join(seen, ["start", "node"], "left_anti"))
            ahead = cut_lineage(grown.groupBy("start", "node").agg(F.min("way").alias("way")))
            seen = seen.unionByName(ahead.select("start", "node"))
        else:
            grown = (back.withColumnRenamed("node", "t").join(links, "t").where("s >= start")
                     .select("start", "end", F.col("s").alias("node"), F.concat(F.array("s"), "way").alias("way"))
                     .join(known, ["start", "end", "node"], "left_anti"))
            back = cut_lineage(grown.groupBy("start", "end", "node").agg(F.min("way").alias("way")))
            known = known.unionByName(back.select("start", "end", "node"))
        over = (back.select("start", "end", "node", F.col("way").alias("rest")).join(ahead, ["start", "node"])
                .select("start", "end", F.concat("way", F.slice("rest", F.lit(2), F.size("rest"))).alias("members")))
        met = cut_lineage(over.groupBy("start", "end").agg(F.min("members").alias("members")))
        found.append(met)
        # A start and an end go on while they wait for each other and neither side is exhausted.
        pending = cut_lineage(pending.join(met, ["start", "end"], "left_anti").join(ahead.select("start").distinct(), "start", "left_semi")
                              .join(back.select("start", "end").distinct(), ["start", "end"], "left_semi"))
        ahead = ahead.join(pending.select("start").distinct(), "start", "left_semi")
        back = back.join(pending, ["start", "end"], "left_semi")
        here, there = ahead.count(), back.count()
    return _unite(found) if found else wanted.select("start", "end", F.array("start").alias("members"))


def closed_trails(edges: DataFrame, max_length: int = 5) -> DataFrame:
    """Number of closed walks of 1..max_length edges per node that use no edge twice.

    A self-loop is a closed walk of length one. Nodes on no such walk are absent.
    """
    core = cyclic_core(cut_lineage(edges.select(*KEYS, "source_id", "target_id").distinct()))
    links = core.select(*KEYS, F.col("source_id").alias("end"), F.col("target_id").alias("_next"))
    level = core.select(
        *KEYS, F.col("source_id").alias("start"), F.col("target_id").alias("end"),
        F.array(F.struct(F.col("source_id").alias("s"), F.col("target_id").alias("t"))).alias("used"))
    counts = [level.where(F.col("start") == F.col("end")).groupBy(*KEYS, "start").agg(F.count(F.lit(1)).alias("n"))]
    for length in range(2, max_length + 1):
        edge = F.struct(F.col("end").alias("s"), F.col("_next").alias("t"))
        grown = level.join(links, ["end", *KEYS]).where(~F.array_contains("used", edge))
        if length == max_length:
            # The last hop only has to close, so it needs no materialised paths.
            closing = grown.where(F.col("_next") == F.col("start"))
        else:
            level = cut_lineage(grown.select(
                *KEYS, "start", F.col("_next").alias("end"), F.concat("used", F.array(edge)).alias("used")))
            closing = level.where(F.col("end") == F.col("start"))
        counts.append(closing.groupBy(*KEYS, "start").agg(F.count(F.lit(1)).alias("n")))
    return _unite(counts).groupBy(*KEYS, "start").agg(F.sum("n").alias("circular_dependencies"))


# -------------------------------------------------------------------- subgraph retrieval

def overview_subgraph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Top-level nodes and the edges between them; a node without such edges appears once."""
    top = nodes.where(F.col("label").isin(vocab.OVERVIEW_LABELS)).select(*KEYS, "id", "label")
    between = (edges.join(top.select(*KEYS, F.col("id").alias("target_id")), ["target_id", *KEYS], "left_semi")
               .select(*KEYS, F.col("source_id").alias("id"), "relationship", "target_id",
                       F.coalesce("resolution", F.lit("exact")).alias("resolution"))
               .dropDuplicates(["id", "relationship", "target_id", *KEYS]))
    return top.join(between, ["id", *KEYS], "left")


def edges_at(focus: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with a focus node at either end, found before anything is grouped; one between two of them comes twice."""
    nodes, _ = _frontier(focus, "start")
    return _touching(edges, nodes, "source_id").unionByName(_touching(edges, nodes, "target_id"))


def neighbourhood(focus: DataFrame, edges: DataFrame, relationships: list[str] | None = None) -> DataFrame:
    """Edges touching each focus node in either direction: two equi-joins instead of an OR join."""
    kept = edges if relationships is None else edges.where(F.col("relationship").isin(relationships))
    kept = kept.select(*KEYS, "source_id", "relationship", "target_id",
                       F.coalesce("resolution", F.lit("exact")).alias("resolution"))
    ids = focus.select(*KEYS, F.col("start").alias("focus"))
    outgoing = kept.join(ids.withColumn("source_id", F.col("focus")), ["source_id", *KEYS])
    incoming = kept.join(ids.withColumn("target_id", F.col("focus")), ["target_id", *KEYS])
    columns = ["focus", "source_id", "relationship", "target_id", "resolution", *KEYS]
    return outgoing.select(*columns).unionByName(incoming.select(*columns)).dropDuplicates(
        ["focus", "source_id", "relationship", "target_id", *KEYS])


def relation_whitelist(requested: list[str] | None) -> list[str]:
    allowed = vocab.GRAPH_CONTEXT_RELATIONSHIPS
    return allowed if not requested else [r for r in requested if r in allowed]


def filter_subgraph(nodes: DataFrame, edges: DataFrame, labels: list[str], relationships: list[str]) -> DataFrame:
    """Edges of the chosen types whose both ends have one of the chosen labels."""
    kept = nodes.where(F.col("label").isin(labels)).select(*KEYS, "id")
    return (edges.where(F.col("relationship").isin(relationships))
            .join(kept.withColumnRenamed("id", "source_id"), ["source_id", *KEYS], "left_semi")
            .join(kept.withColumnRenamed("id", "target_id"), ["target_id", *KEYS], "left_semi"))
