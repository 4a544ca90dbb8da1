import itertools
import random

import pytest

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import graph as GR
from lodestone.operators import reach as RE
from lodestone.operators import reach, shortest


def ends(df):
    return sorted((r.start, r.end, r.length) for r in df.collect())


def test_traverse_downstream(edge_frame, start):
    edges = edge_frame("Controller CALLS Service", "Service DEPENDS_ON Repository")
    assert ends(GR.traverse(start("Controller"), edges)) == [("Controller", "Repository", 2), ("Controller", "Service", 1)]
    up = GR.traverse(start("Repository"), edges, "upstream").collect()
    assert {r.end for r in up} == {"Service", "Controller"}
    assert [(s.source, s.target) for r in up if r.length == 2 for s in r.steps] == [("Service", "Repository"), ("Controller", "Service")]


def test_traverse_cycle_has_one_path(edge_frame, start):
    assert ends(GR.traverse(start("A"), edge_frame("A CALLS B", "B CALLS A"))) == [("A", "B", 1)]


def test_traverse_confidence_and_filter(edge_frame, start):
    edges = edge_frame("A CALLS B", "B CALLS C inferred", "A INHERITS D", "A IMPORTS E")
    got = {r.end: r.confidence for r in GR.traverse(start("A"), edges).collect()}
    assert got == {"B": "exact", "C": "inferred", "E": "exact"}
    assert {r.end for r in GR.traverse(start("A"), edges, relationships=["IMPORTS"]).collect()} == {"E"}


def test_traverse_depth(edge_frame, start):
    edges = edge_frame(*[f"n{i} CALLS n{i + 1}" for i in range(8)])
    assert max(r.length for r in GR.traverse(start("n0"), edges, max_depth=5).collect()) == 5
    assert max(r.length for r in GR.traverse(start("n0"), edges).collect()) == 8
    assert max(r.distance for r in GR.impact(start("n0"), edge_frame(*[f"n{i} CALLS n{i + 1}" for i in range(13)]), "downstream").collect()) == 13


def test_find_paths(edge_frame, facts):
    pairs = facts("start string, goal string", [("A", "D")])
    rows = GR.find_paths(pairs, edge_frame("A CALLS B", "B CALLS C", "C CALLS D", "B CALLS X")).collect()
    assert [(r.length, r.nodes[1:]) for r in rows] == [(3, ["B", "C", "D"])]
    both = GR.find_paths(pairs, edge_frame("A CALLS B", "B CALLS D", "A CALLS D")).collect()
    assert sorted(r.length for r in both) == [1, 2]
    assert GR.find_paths(facts("start string, goal string", [("A", "A")]), edge_frame("A CALLS B", "B CALLS A")).count() == 0


@pytest.mark.parametrize("small", [8 << 20, 0])
def test_paths_meet_between_the_ends(edge_frame, facts, monkeypatch, small):
    """A hub on either side is not opened; a frontier too large to broadcast gives the same paths."""
    monkeypatch.setattr(GR, "SMALL_FRONTIER", small)
    lines = ["A CALLS B", "A CALLS B inferred", "B CALLS C", "C CALLS D", "B CALLS X", "X CALLS D", "D CALLS A", "C CALLS B"]
    edges = edge_frame(*lines, *[f"n{i} CALLS D" for i in range(20)], *[f"m{i} CALLS n{i}" for i in range(20)])
    pairs = facts("start string, goal string", [("A", "D"), ("A", "D"), ("D", "B")])
    rows = sorted((r.start, r.end, r.nodes[1:], r.confidence) for r in GR.find_paths(pairs, edges, max_depth=3).collect())
    assert rows == [("A", "D", ["B", "C", "D"], "exact"), ("A", "D", ["B", "X", "D"], "exact"), ("D", "B", ["A", "B"], "exact")]
    met = {(r.source_id, r.target_id) for r in GR.edges_between(pairs.where("start = 'A'"), edges, 3).collect()}
    assert {("A", "B"), ("B", "C"), ("B", "X"), ("C", "D"), ("X", "D")} <= met and not any(s.startswith("m") for s, _ in met)


def test_http_chain(edge_frame, start):
    edges = edge_frame(
        "CheckoutButton CALLS checkoutClient", "checkoutClient REQUESTS endpoint:POST:/api/v1/orders",
        "endpoint:POST:/api/v1/orders HANDLED_BY OrderController", "OrderController CALLS OrderService",
        "OrderService DEPENDS_ON OrderRepository")
    rows = GR.http_chains(start("CheckoutButton"), edges, max_depth=6).collect()
    assert [(r.length, r.end) for r in rows] == [(5, "OrderRepository")]
    assert GR.http_chains(start("CheckoutButton"), edges, max_depth=5).count() == 0


def impact_of(edge_frame, start, lines, node="A", direction="downstream", **kw):
    rows = GR.impact(start(node), edge_frame(*lines), direction, **kw).collect()
    return {r.node: (r.category, r.distance, r.resolution) for r in rows}


def test_impact_direct_and_indirect(edge_frame, start):
    got = impact_of(edge_frame, start, ["A CALLS B", "B CALLS C", "C CALLS A"])
    assert got == {"B": ("direct", 1, "exact"), "C": ("indirect", 2, "exact")}


def test_impact_weakest_confidence_and_diamond(edge_frame, start):
    got = impact_of(edge_frame, start, ["A CALLS B inferred", "A CALLS C", "B CALLS D", "C CALLS D", "C CALLS E"])
    # C is met before B (stronger edge first), so D is first reached through C
    assert got["D"] == ("indirect", 2, "exact") and got["B"] == ("direct", 1, "inferred") and len(got) == 4


def test_impact_keeps_unresolved_apart(edge_frame, start):
    got = impact_of(edge_frame, start, ["A CALLS U unresolved", "U CALLS V"])
    assert got == {"U": ("unresolved", 1, "unresolved")}


def test_impact_depth_and_summary(edge_frame, start, facts):
    edges = edge_frame(*[f"n{i} CALLS n{i + 1}" for i in range(6)])
    assert set(impact_of(edge_frame, start, [f"n{i} CALLS n{i + 1}" for i in range(6)], "n0", max_depth=1)) == {"n1"}
    found = GR.impact(start("n0"), edges, "downstream", 5)
    containers = facts("start string, container_kind string, container string", [("n0", "file", "f")])
    row = GR.impact_summary(found, containers, max_nodes=3, directions=1).first()
    assert (row.direct_callees, row.indirect_callees, row.affected_files, row.nodes_visited, row.truncated) == (1, 4, 1, 6, True)
    assert GR.impact_summary(found, containers, max_nodes=500).first().truncated is False


def test_members_carry_impact_to_their_container(edge_frame, start):
    got = impact_of(edge_frame, start, ["File CONTAINS Class", "Class CONTAINS method", "method CALLS other"], "File")
    assert got == {"other": ("direct", 1, "exact")}


def test_frontier_parts_by_kind(edge_frame, facts, monkeypatch):
    """A kind with few ids is broadcast beside one with many; edges between other kinds leave by range."""
    monkeypatch.setattr(GR, "SMALL_FRONTIER", 300)
    nodes = facts("node string", [(f"c:{i}",) for i in range(20)] + [("s:1",), ("s:2",), ("\u00fcber",), (None,)])
    front, n = GR._frontier(nodes, "node")
    assert n == 24 and sorted(ids.count() for ids, _ in front.parts) == [3, 20]
    edges = edge_frame("c:3 CALLS s:1", "c:7 CALLS s:9", "x CALLS c:5", "b CALLS a", "\u00fcber CALLS z", "s:2 CALLS s:1")
    by = {side: sorted((r.source_id, r.target_id) for r in GR._touching(edges, front, side).collect()) for side in ("source_id", "target_id")}
    assert by == {"source_id": [("c:3", "s:1"), ("c:7", "s:9"), ("s:2", "s:1"), ("\u00fcber", "z")],
                  "target_id": [("c:3", "s:1"), ("s:2", "s:1"), ("x", "c:5")]}
    for most in (16, 1):
        monkeypatch.setattr(GR, "MAX_RANGES", most)
        (_, few), (_, many) = GR._frontier(nodes, "node")[0].parts
        assert edges.where(many(F.col("source_id"))).count() == 2
        assert edges.where(few(F.col("source_id"))).count() == (2 if most == 16 else 3)


@pytest.mark.parametrize("small", [8 << 20, 300, 0])
def test_impact_is_the_same_for_any_parts(edge_frame, start, monkeypatch, small):
    monkeypatch.setattr(GR, "SMALL_FRONTIER", small)
    lines = ["f CONTAINS k", *[f"k CONTAINS m{i}" for i in range(12)], *[f"m{i} CALLS s{i % 3}" for i in range(12)], "s1 CALLS t", "k CALLS s7 inferred"]
    got = impact_of(edge_frame, start, lines, "f")
    assert got == {**{f"s{i}": ("direct", 1, "exact") for i in range(3)}, "s7": ("direct", 1, "inferred"), "t": ("indirect", 2, "exact")}


def test_last_level_is_not_moved_to_find_nothing(edge_frame, start, monkeypatch):
    """Edges none of which can leave the last, shuffled frontier end the search without a further level."""
    monkeypatch.setattr(GR, "SMALL_FRONTIER", 0)
    written, cut = [], GR.cut_lineage
    monkeypatch.setattr(GR, "cut_lineage", lambda df: written.append(1) or cut(df))
    edges = edge_frame("a CALLS b", "b CALLS c1", "b CALLS c2 inferred")
    assert ends(GR.traverse(start("a"), edges)) == [("a", "b", 1), ("a", "c1", 2), ("a", "c2", 2)] and len(written) == 2
    written.clear()
    got = {r.node: r.distance for r in GR.impact(start("a"), edges, "downstream").collect()}
    assert got == {"b": 1, "c1": 2, "c2": 2} and len(written) == 2
    assert ends(GR.traverse(start("z"), edges)) == [] and GR.impact(start("z"), edges, "downstream").count() == 0


def test_edges_at_focus_are_found_before_grouping(spark, edge_frame, start):
    edges = edge_frame("A CALLS B inferred", "A CALLS B", "B CALLS C", "C CALLS A", "C CALLS D")
    near = GR.strongest_edges(GR.edges_at(start("A", "B"), edges))
    got = sorted((r.focus, r.source_id, r.target_id, r.resolution) for r in GR.neighbourhood(start("A", "B"), near).collect())
    assert got == [("A", "A", "B", "exact"), ("A", "C", "A", "exact"), ("B", "A", "B", "exact"), ("B", "B", "C", "exact")]
    from lodestone.queries import traversal
    for query in (traversal.expand_node, traversal.graph_context):
        assert "LeftSemi" in query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_cycles(edge_frame):
    two = GR.cycles(edge_frame("ServiceA CALLS ServiceB", "ServiceB DEPENDS_ON ServiceA")).collect()
    assert [(c.cycle_id, c.severity, c.relationship_types) for c in two] == [("cycle:ServiceA->ServiceB", "medium", ["CALLS", "DEPENDS_ON"])]
    three = GR.cycles(edge_frame("A CALLS B", "B CALLS C", "C CALLS A")).collect()
    assert [(c.cycle_id, c.severity, c.members) for c in three] == [("cycle:A->B->C", "high", ["A", "B", "C"])]
    assert GR.cycles(edge_frame("A CALLS B", "B CALLS C")).count() == 0
    assert GR.cycles(edge_frame("A CALLS B", "B CALLS A unresolved", "A CALLS A")).count() == 0


def test_long_ring_without_length_bound(edge_frame):
    ring = [f"n{i:02d} CALLS n{(i + 1) % 9:02d}" for i in range(9)]
    assert GR.cycles(edge_frame(*ring), max_length=5).count() == 0
    assert GR.cycles(edge_frame(*ring), max_length=None).first().description.startswith("Circular dependency involving 9 components")


def test_closing_cycles_follow_rings_of_any_length(edge_frame):
    ring = [f"n{i:02d} CALLS n{(i + 1) % 12:02d}" for i in range(12)]
    both = edge_frame(*ring, "n03 IMPORTS n01", "n05 CALLS tail", "head CALLS n05").unionByName(
        edge_frame("n03 CALLS n01", "a CALLS a", "a CALLS b unresolved", "b CALLS a", snapshot="s2"))
    got = {(c.snapshot_id, tuple(c.members), tuple(c.relationship_types), c.severity) for c in GR.closing_cycles(both).collect()}
    assert got == {("s1", tuple(f"n{i:02d}" for i in range(12)), ("CALLS",), "high"),
                   ("s1", ("n01", "n02", "n03"), ("CALLS", "IMPORTS"), "high")}
    assert GR.closing_cycles(edge_frame("A CALLS B", "B CALLS C")).count() == 0
    assert GR.closing_cycles(both.limit(0)).count() == 0


@pytest.mark.parametrize("held", [1, 30, 2 << 20])
def test_shortest_paths_of_numbers_against_brute_force(held, monkeypatch):
    """Whatever is held at a time, splits change no path."""
    monkeypatch.setattr(shortest, "HELD", held)
    for seed in range(40):
        rng = random.Random(seed)
        n = rng.randint(2, 30)
        edges = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, 4 * n))})
        s, t = np.array([e[0] for e in edges]), np.array([e[1] for e in edges])
        wanted, want = sorted((b, a) for a, b in edges if a > b), {}
        for start, end in wanted:
            level, seen = {start: (start,)}, {start}
            while level and end not in level:
                grown: dict = {}
                for node, way in level.items():
                    for a, b in edges:
                        if a == node and b > start and b not in seen:
                            grown[b] = min(grown.get(b, (n,)), (*way, b))
                seen |= set(grown)
                level = grown
            if end in level:
                want[start, end] = level[end]
        got = [(wanted[k], tuple(way)) for places, ways in shortest.search(
            np.array([w[0] for w in wanted], int), np.array([w[1] for w in wanted], int), shortest.neighbours(s, t, n), shortest.neighbours(t, s, n))
            for k, way in zip(places.tolist(), ways.tolist())]
        assert len(got) == len(want) and dict(got) == want, seed


def test_closing_cycles_of_a_small_component_take_no_job_per_level(edge_frame, monkeypatch):
    def refuse(*_):
        raise AssertionError("a component of few edges is searched by joins")

    monkeypatch.setattr(GR, "shortest_above", refuse)
    edges = edge_frame("R0 CALLS R1", "R1 IMPORTS R2", "R2 CALLS R0", "R0 CALLS Z9")
    assert [tuple(r.members) for r in GR.closing_cycles(edges).collect()] == [("R0", "R1", "R2")]


def test_shortest_paths_in_tasks_equal_those_by_joins(spark):
    rng = random.Random(5)
    edges = sorted({(rng.randrange(8) << 33, rng.randrange(8) << 33) for _ in range(18)})
    links = spark.createDataFrame(edges, "s long, t long")
    wanted = links.where("s > t").selectExpr("t AS start", "s AS end")
    found = [sorted(map(tuple, f(wanted, links).select("start", "end", F.array_join("members", ",")).collect())) for f in (shortest.paths, GR.shortest_above)]
    assert found[0] == found[1] and found[0]
    assert shortest.paths(wanted.limit(0), links.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [7, 11])
def test_closing_cycles_against_brute_force(edge_frame, seed):
    pairs = [(a, b) for a, b in random_edges(seed) if a != b]
    edges = edge_frame(*[f"v{a} IMPORTS v{b}" for a, b in pairs] * 2)
    best = {}
    for size in range(2, 10):
        for walk in itertools.permutations(range(9), size):
            if walk[0] == min(walk) and all(pair in pairs for pair in zip(walk, walk[1:] + walk[:1])):
                best.setdefault((walk[-1], walk[0]), walk)  # shorter ones come first, then the order of nodes
    assert sorted(tuple(c.members) for c in GR.closing_cycles(edges).collect()) == sorted(
        tuple(f"v{x}" for x in walk) for walk in best.values())


def random_edges(seed, nodes=9, count=22):
    rnd = random.Random(seed)
    pairs = [(a, b) for a in range(nodes) for b in range(nodes)]
    return sorted(rnd.sample(pairs, count))


def test_cycles_and_trails_against_brute_force(edge_frame):
    pairs = random_edges(7)
    edges = edge_frame(*[f"v{a} IMPORTS v{b}" for a, b in pairs])
    adjacent = {}
    for a, b in pairs:
        adjacent.setdefault(a, []).append(b)
    expected = set()
    for size in range(2, 6):
        for walk in itertools.permutations(range(9), size):
            if walk[0] == min(walk) and all(walk[(i + 1) % size] in adjacent.get(walk[i], []) for i in range(size)):
                expected.add("cycle:" + "->".join(f"v{x}" for x in walk))
    assert {c.cycle_id for c in GR.cycles(edges, 5).collect()} == expected

    counts = {}

    def walk(origin, node, used):
        for nxt in adjacent.get(node, []):
            if (node, nxt) in used or len(used) == 5:
                continue
            if nxt == origin:
                counts[origin] = counts.get(origin, 0) + 1
            walk(origin, nxt, used | {(node, nxt)})

    for a in range(9):
        walk(a, a, frozenset())
    got = {int(r.start[1:]): r.circular_dependencies for r in GR.closed_trails(edges).collect()}
    assert got == counts


def test_closure_against_brute_force(edge_frame):
    pairs = [(a, b) for a, b in random_edges(3, 9, 14) if a != b]
    edges = GR.distinct_edges(edge_frame(*[f"v{a} CALLS v{b}" for a, b in pairs]))
    into = {}
    for a, b in pairs:
        into.setdefault(b, set()).add(a)
    expected = {}
    for node in into:
        seen, todo = set(), list(into[node])
        while todo:
            x = todo.pop()
            if x not in seen and x != node:
                seen.add(x)
                todo += into.get(x, ())
        expected[f"v{node}"] = len(seen)
    assert {r.start: r.transitive_dependents for r in GR.transitive_dependents(edges).collect()} == {k: v for k, v in expected.items() if v}


def test_snapshots_stay_apart(edge_frame, facts):
    both = edge_frame("A CALLS B", snapshot="s1").unionByName(edge_frame("B CALLS A", "B CALLS C", snapshot="s2"))
    starts = facts("start string", [("A",)], "s1").unionByName(facts("start string", [("A",)], "s2"))
    rows = GR.traverse(starts, both).collect()
    assert [(r.snapshot_id, r.end) for r in rows] == [("s1", "B")]
    assert GR.cycles(both).count() == 0


def test_overview_and_neighbourhood(facts, edge_frame, start):
    nodes = facts("id string, label string", [("r", "Repository"), ("f", "File"), ("m", "Module"), ("x", "Function")])
    edges = edge_frame("r CONTAINS f", "f DEFINES m", "f CONTAINS x")
    shown = {(r.id, r.target_id) for r in GR.overview_subgraph(nodes, edges).collect()}
    assert shown == {("r", "f"), ("f", "m"), ("m", None)}
    near = GR.neighbourhood(start("f"), edges, GR.relation_whitelist(["CONTAINS", "EVIL"]))
    assert {(r.source_id, r.target_id) for r in near.collect()} == {("r", "f"), ("f", "x")}
    assert near.where(F.col("relationship") == "DEFINES").count() == 0


def test_reach_counts_against_a_search(edge_frame):
    """Random graphs with cycles, hubs and separate parts, one per snapshot; snapshots do not mix."""
    rng = random.Random(11)
    whole, expected = None, {}
    for nodes, degree in ((14, 1.1), (12, 3.0)):
        snapshot = f"s{nodes}"
        pairs = {(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(int(nodes * degree))} | {(i, 0) for i in range(5, nodes, 3)}
        edges = edge_frame(*[f"n{a} CALLS n{b}" for a, b in pairs], snapshot=snapshot)
        whole = edges if whole is None else whole.unionByName(edges)
        for n in range(nodes):
            seen, todo = {n}, [n]
            while todo:
                new = {a for a, b in pairs if b == todo[-1]} - seen
                todo.pop()
                seen |= new
                todo += new
            if len(seen) > 1:
                expected[snapshot, f"n{n}"] = len(seen) - 1
    assert {(r.snapshot_id, r.start): r.transitive_dependents for r in GR.transitive_dependents(whole).collect()} == expected


def test_sets_turn_into_bitmaps():
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for node, bucket, size in ((3, 0, 10), (3, 0, 4000), (3, 0, 3000), (3, 1, 1), (7, 0, 4096), (8, 0, 4095), (9, 2, 65536)):
        values = np.unique(np.append(rng.choice(65536, size, replace=False), [3] if size == 10 else []).astype(int))
        want.setdefault((node, bucket), set()).update(values.tolist())
        bitmap = np.zeros(65536, bool)
        bitmap[values] = True
        rows.append((node, bucket, values.astype(">u2").tobytes() if size < 4096 else np.packbits(bitmap).tobytes()))
    for _ in range(2):  # the result of a union can be united again
        out = reach.united(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), [r[2] for r in rows]).to_pylist()
        assert {(r["node"], r["bucket"]): r["n"] for r in out} == {k: len(v) for k, v in want.items()}
        assert {r["node"]: r["own"] for r in out if r["bucket"] == 0} == {k[0]: k[0] in v for k, v in want.items() if k[1] == 0}
        assert [len(r["bits"]) for r in out] == [8192, 2, 8192, 8190, 8192]
        rows = sorted([(r["node"], r["bucket"], r["bits"]) for r in out] * 2)


@pytest.mark.parametrize("depth", [1, 2, 3, 5])
def test_nodes_within_hops_against_brute_force(spark, depth):
    rnd = random.Random(depth)
    pairs = [(rnd.randrange(40), rnd.randrange(40)) for _ in range(30)] + [(100, 101), (70000, 70001), (70001, 140000), (7, 7), (100, 101)]
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    expected = {}
    for node in near:
        seen = {node}
        for _ in range(depth):
            seen |= {y for x in seen for y in near[x]}
        expected[node] = len(seen) - 1
    links = spark.createDataFrame(pairs, "s long, t long")
    rows = RE.counts_within(links, depth).collect()
    assert len(rows) == len(expected) and {r.node: r.n for r in rows} == expected
    assert RE.counts_within(links.limit(0), depth).count() == 0


def test_numbers_have_no_gaps_and_small_sets_are_one_row(edge_frame):
    edges = edge_frame(*[f"a{i} CALLS b{i % 7}" for i in range(200)]).repartition(9)
    nodes, _ = RE.numbered(edges)
    assert sorted(r.node for r in nodes.collect()) == list(range(207))
    scattered = [5, 70000, 1 << 20, (1 << 24) - 1]
    bits = np.array(scattered, ">u4").tobytes()
    whole = np.packbits(np.arange(1 << 24) % 3 == 0).tobytes()
    out = RE.united(np.array([70000, 70000, 90000, 90000, 90000]), np.array([0, 0, 0, 0, 1]), [bits, bits[:8], whole, bits, bits], RE.WIDE).to_pylist()
    some = sum(x % 3 != 0 for x in scattered)
    assert [(r["node"], r["bucket"], r["n"], r["own"]) for r in out] == [
        (70000, 0, 4, True), (90000, 0, (1 << 24) // 3 + 1 + some, True), (90000, 1, 4, False)]
    assert out[0]["bits"] == bits and len(out[1]["bits"]) == 1 << 21


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 5])
def test_components_seen_whole_hold_no_sets(spark, depth, monkeypatch):
    """Stars of stars are settled by their hub; a long path, and a ring as wide as the bound, stay with the sets."""
    tree = [(10 + i, 0) for i in range(6)] + [(100 + i, 10 + i % 6) for i in range(25)]
    path = [(200 + i, 201 + i) for i in range(8)]
    ring = [(300 + i, 300 + (i + 1) % 9) for i in range(9)] + [(310, 311)]
    near = {}
    for a, b in tree + path + ring:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    expected = {}
    for node in near:
        seen = {node}
        for _ in range(depth):
            seen |= {y for x in seen for y in near[x]}
        expected[node] = len(seen) - 1
    held = []
    whole = RE._set_counts
    monkeypatch.setattr(RE, "_set_counts", lambda both, linked, inner, leaves, d: held.extend(r.s for r in inner.collect()) or whole(both, linked, inner, leaves, d))
    rows = RE.counts_within(spark.createDataFrame(tree + path + ring, "s long, t long"), depth).collect()
    assert len(rows) == len(expected) and {r.node: r.n for r in rows} == expected
    assert (0 in held) == (depth < 4)


def test_short_cycles_end_the_search(edge_frame, monkeypatch):
    """A ring of edges both ways: every closing edge closes a cycle of two, so no search goes round the ring."""
    steps = [(i, (i + 1) % 40) for i in range(40)]
    edges = edge_frame(*[f"n{a:02d} CALLS n{b:02d}" for a, b in steps], *[f"n{b:02d} CALLS n{a:02d}" for a, b in steps])
    written = []
    cut = GR.cut_lineage
    monkeypatch.setattr(GR, "cut_lineage", lambda df: written.append(df) or cut(df))
    rows = GR.closing_cycles(edges).collect()
    assert sorted(tuple(r.members) for r in rows) == sorted(tuple(f"n{x:02d}" for x in sorted(p)) for p in steps)
    assert len(written) < 15
