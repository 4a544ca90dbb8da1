import pytest
from pyspark.sql import functions as F

from lodestone.functions import columns as C
from lodestone.operators import architecture as A
from lodestone.operators import evolution as E
from lodestone.operators import explain as X
from lodestone.operators import graph as GR
from lodestone.operators import search as SE

FACT = "qualified_name string, node_kind string, architecture_role string, layer string, file_path string, language string"


@pytest.fixture(scope="module")
def nodes(facts):
    def build(*rows):
        return facts(FACT, [(name, kind, role, layer, f"{name}.x", "java") for name, kind, role, layer in rows])
    return build


@pytest.mark.parametrize("source,target,allowed", [
    ("presentation", "application", True), ("application", "domain", True), ("infrastructure", "domain", True), ("domain", "domain", True),
    ("presentation", "infrastructure", False), ("domain", "presentation", False), ("unknown", "presentation", True), ("domain", "unknown", True)])
def test_layer_transitions(spark, source, target, allowed):
    assert spark.range(1).select(C.transition_allowed(F.lit(source), F.lit(target))).first()[0] is allowed


def test_layer_skip_needs_an_application_layer(nodes, edge_frame):
    edges = edge_frame("App.Ctl DEPENDS_ON App.Repo")
    skip = nodes(("App.Ctl", "Class", "controller", "presentation"), ("App.Repo", "Class", "repository", "infrastructure"),
                 ("App.Svc", "Class", "service", "application"))
    found = A.layer_violations(skip, edges).collect()
    assert [(v.violation_type, v.severity) for v in found] == [("layer_skip", "medium")]
    assert A.layer_violations(skip.where("layer <> 'application'"), edges).count() == 0


def test_reverse_dependency_and_owner_fallback(nodes, edge_frame):
    facts_ = nodes(("D", "Class", "domain", "domain"), ("C", "Class", "controller", "presentation"))
    found = A.layer_violations(facts_, edge_frame("D.run CALLS C.go", "D DEPENDS_ON C", "D CALLS C unresolved")).collect()
    assert [(v.source_qualified_name, v.target_qualified_name, v.violation_type, v.severity) for v in found] == [("D", "C", "reverse_dependency", "high")]


def test_boundary_bypass(facts, edge_frame):
    bindings = facts("interface_type string, concrete_type string", [("IPaymentGateway", "StripeGateway")])
    edges = edge_frame("Order DEPENDS_ON Pay.StripeGateway", "Order DEPENDS_ON IPaymentGateway", "Order CALLS Other")
    found = A.boundary_bypasses(edges, bindings).collect()
    assert [(v.target_qualified_name, v.violation_type) for v in found] == [("Pay.StripeGateway", "boundary_bypass")]


def test_hotspots(nodes, edge_frame):
    names = ["SharedUtil", "ServiceA", "ServiceB", "ServiceC", "ServiceD"]
    facts_ = nodes(*[(n, "Class", "service", "application") for n in names])
    edges = edge_frame(*[f"Service{x} DEPENDS_ON SharedUtil" for x in "ABCD"])
    top = A.hotspots(facts_, edges).orderBy(F.col("fan_in").desc()).first()
    assert (top.qualified_name, top.fan_in, top.transitive_dependents) == ("SharedUtil", 4, 4)
    assert top.severity in ("medium", "high")
    assert top.explanation.startswith("High architectural hotspot: 4 direct dependents and 4 transitive dependents")


def test_orphans(nodes, edge_frame, facts):
    facts_ = nodes(("App.UnusedHelper", "Class", "unknown", "unknown"), ("App.OrderService", "Class", "service", "application"),
                   ("App.Program", "Class", "unknown", "unknown"), ("App.Startup", "Class", "unknown", "unknown"),
                   ("App.Ctl", "Class", "controller", "presentation"), ("App.Mod", "Module", "unknown", "unknown"),
                   ("App.Bound", "Class", "unknown", "unknown"))
    edges = edge_frame("X CALLS App.OrderService.place")
    di = facts("type_name string", [("Bound",)])
    assert {o.qualified_name for o in A.orphans(facts_, edges, di).collect()} == {"App.UnusedHelper"}
    assert {o.qualified_name for o in A.orphans(facts_, edges).collect()} == {"App.UnusedHelper", "App.Bound"}


CLASS = "qualified_name string, name string, file_path string, language string, header_text string, docstring string"
METHOD = "class_name string, name string, qualified_name string, decorators array<string>"
FUNCTION = "qualified_name string, name string, file_path string, language string"


def test_role_cascade(facts, edge_frame):
    classes = facts(CLASS, [
        ("a.Ctl", "Ctl", "Ctl.java", "java", "@RestController\nclass Ctl", None), ("a.Svc", "Svc", "Svc.java", "java", "@Service class Svc", None),
        ("a.Repo", "Repo", "Repo.java", "java", "@Repository", None), ("a.UserService", "UserService", "U.java", "java", "class UserService", None),
        ("a.Hand", "Hand", "h.py", "python", "", None), ("a.Cli", "Cli", "c.ts", "typescript", "", None), ("a.View", "View", "v.tsx", "typescript", "", None)])
    methods = facts(METHOD, [("a.Hand", "create", "a.Hand.create", []), ("a.Cli", "load", "a.Cli.load", [])])
    functions = facts(FUNCTION, [("b.handle", "handle", "b.py", "python"), ("b.Page", "Page", "b.tsx", "typescript"), ("b.plain", "plain", "b.py", "python")])
    edges = edge_frame("e1 HANDLED_BY x.create", "e2 HANDLED_BY b.handle", "a.Cli.load REQUESTS e1")
    got = {r.qualified_name: (r.architecture_role, r.resolution) for r in A.classify_roles(classes, methods, functions, edges).collect()}
    assert got == {
        "a.Ctl": ("controller", "exact"), "a.Svc": ("service", "exact"), "a.Repo": ("repository", "exact"), "a.UserService": ("unknown", "unresolved"),
        "a.Hand": ("controller", "inferred"), "a.Cli": ("client", "inferred"), "a.View": ("component", "inferred"),
        "b.handle": ("endpoint_handler", "exact"), "b.Page": ("component", "inferred"), "b.plain": ("unknown", "unresolved")}


def test_role_refinement(facts, edge_frame):
    full = FACT + ", resolution string, evidence_type string, evidence string"
    rows = [("a.Ctl", "Class", "controller", "presentation", "f", "java", "exact", "e", "e")]
    rows += [(f"a.{n}", "Class", "unknown", "unknown", "f", "java", "unresolved", "e", "e") for n in ("Svc", "Leaf", "UserRepository", "Alone")]
    edges = edge_frame("Ctl DEPENDS_ON a.Svc", "a.Svc DEPENDS_ON a.Other", "a.Ctl DEPENDS_ON Leaf", "a.Alone DEPENDS_ON a.UserRepository")
    got = {r.qualified_name: r.architecture_role for r in A.refine_roles(facts(full, rows), edges).collect()}
    assert got == {"a.Ctl": "controller", "a.Svc": "service", "a.Leaf": "repository", "a.UserRepository": "repository", "a.Alone": "unknown"}


# ------------------------------------------------------------------------------ comparison

ENTITY = "qualified_name string, entity_kind string, architecture_role string, architecture_layer string, file_path string"


def compared(df):
    return df.withColumns({"baseline_snapshot_id": F.lit("b"), "target_snapshot_id": F.lit("t")}).drop("snapshot_id")


def test_entity_diff(facts):
    base = compared(facts(ENTITY, [("Mutated", "Class", "service", "application", "m"), ("OldHelper", "Class", "utility", "unknown", "o"),
                                   ("Same", "Class", None, None, "s")]))
    target = compared(facts(ENTITY, [("Mutated", "Class", "repository", "infrastructure", "m"), ("NewGateway", "Class", "gateway", "infrastructure", "n"),
                                     ("Same", "Class", None, None, "s")]))
    got = {r.qualified_name: (r.change_type, len(r.field_changes)) for r in E.entity_diff(base, target).collect()}
    assert got == {"Mutated": ("modified", 2), "OldHelper": ("removed", 0), "NewGateway": ("added", 0), "Same": ("unchanged", 0)}


def test_resolution_changes(edge_frame):
    base = compared(edge_frame("A CALLS B unresolved", "C DEPENDS_ON D exact"))
    target = compared(edge_frame("A CALLS B exact", "C DEPENDS_ON D inferred"))
    diff = E.relationship_diff(base, target)
    assert diff.where("resolution_changed").count() == 2
    assert {r.change_type for r in diff.collect()} == {"unchanged"}
    worse = E.resolution_regressions(diff).collect()
    assert [r.affected_entity for r in worse] == ["C"]


def test_change_impact_of_the_middle(facts, edge_frame):
    base = compared(facts(ENTITY, [(n, "Class", "service", "application", n) for n in "ABCD"]))
    target = compared(facts(ENTITY, [(n, "Class", "repository" if n == "B" else "service", "application", n) for n in "ABCD"]))
    edges = compared(edge_frame("A CALLS B", "B CALLS C", "C CALLS D"))
    row = E.change_impact(E.entity_diff(base, target), E.relationship_diff(edges, edges)).first()
    assert (row.changed_entity, row.direct_dependents, row.direct_dependencies, row.transitive_impacted) == ("B", 1, 1, 3)
    assert row.blast_radius_score == 5 and row.impact_depth == 3


HOTSPOT = "qualified_name string, fan_in long, fan_out long"


def test_hotspot_growth_threshold(facts):
    base = compared(facts(HOTSPOT, [("A", 2, 0), ("B", 1, 0)]))
    target = compared(facts(HOTSPOT, [("A", 5, 0), ("B", 2, 0), ("C", 9, 0)]))
    got = {r.affected_entity: r.severity for r in E.hotspot_growth(base, target).collect()}
    assert got == {"A": "medium", "C": "high"}


def test_new_cycle_and_risk(facts, edge_frame):
    none = compared(GR.cycles(edge_frame("A CALLS B")))
    some = compared(GR.cycles(edge_frame("A CALLS B", "B CALLS A")))
    found = E.new_cycles(none, some)
    assert found.first().affected_entity == "A"
    entities = E.entity_diff(compared(facts(ENTITY, [])), compared(facts(ENTITY, [("A", "Class", "x", "x", "a")])))
    rels = E.relationship_diff(compared(edge_frame("A CALLS B")), compared(edge_frame("A CALLS B")))
    risk = E.change_risk(entities, rels, found).first()
    assert (risk.risk_level, risk.score) == ("high", 40)
    calm = E.change_risk(entities, rels, found.limit(0)).first()
    assert (calm.risk_level, calm.score, calm.high_risk_factors) == ("low", 0, [])


def test_issue_origin(facts, spark):
    snapshots = spark.createDataFrame([("repo", "s1", 1), ("repo", "s2", 2), ("repo", "s3", 3)], "repository_id string, snapshot_id string, analyzed_at int")
    cycle = "cycle_id string, members array<string>"
    cycles = facts(cycle, [("cycle:A->B", ["A", "B"])], "s2").unionByName(facts(cycle, [("cycle:A->B", ["A", "B"])], "s3"))
    row = X.issue_origins(snapshots, X.matching_issues(cycles, "cycle", "A")).first()
    assert (row.origin_snapshot_id, row.snapshots_present) == ("s2", 2)
    present = {r.snapshot_id: r.present for r in X.issue_presence(snapshots, X.matching_issues(cycles, "cycle", "A")).collect()}
    assert present == {"s1": False, "s2": True, "s3": True}


def test_issue_runs(spark):
    """Present, gone, back to the end; another issue once; ties in time by snapshot; repeated rows count once."""
    snapshots = spark.createDataFrame([("repo", f"s{i}", min(i, 4)) for i in range(1, 6)],
                                      "repository_id string, snapshot_id string, analyzed_at int")
    rows = [("repo", s, "x") for s in ("s1", "s2", "s4", "s5", "s5")] + [("repo", "s3", "y")]
    issues = spark.createDataFrame(rows, "repository_id string, snapshot_id string, issue_key string")
    got = sorted(tuple(r)[1:] for r in X.issue_runs(snapshots, issues).collect())
    assert got == [("x", 1, "s1", "s2", 2, False, False), ("x", 2, "s4", "s5", 2, True, True), ("y", 1, "s3", "s3", 1, False, False)]
    assert X.issue_runs(snapshots, issues.limit(0)).count() == 0


@pytest.mark.parametrize("query,status,name", [
    ("Shop.Orders.OrderService", "resolved", "Shop.Orders.OrderService"), ("POST /api/v1/orders", "resolved", "endpoint:POST:/api/v1/orders"),
    ("post api/v1/orders", "resolved", "endpoint:POST:/api/v1/orders"), ("OrderService", "resolved", "Shop.Orders.OrderService"),
    ("Helper", "ambiguous", None), ("orders/service.py", "resolved", "Shop.Orders.OrderService"), ("Missing", "not_found", None), ("  ", "not_found", None)])
def test_entity_resolution(facts, query, status, name):
    entities = facts("qualified_name string, file_path string, module_name string", [
        ("Shop.Orders.OrderService", "src/orders/service.py", None), ("endpoint:POST:/api/v1/orders", None, None),
        ("a.Helper", "a.py", None), ("b.Helper", "b.py", None)])
    row = SE.resolve_entities(facts("query string", [(query,)]), entities).first()
    assert (row.status, row.qualified_name) == (status, name)


def test_explanations(facts, edge_frame):
    cycle = X.explain_cycles(GR.cycles(edge_frame("A CALLS B", "B CALLS A"))).first()
    assert cycle.summary == "Circular dependency cycle (MEDIUM severity) involving 2 components."
    assert cycle.detailed_reasons[0] == "Dependency cycle path: A -> B -> A"
    orphan = A.orphans(facts(FACT, [("Lonely", "Class", "unknown", "unknown", "f", "java")]), edge_frame("A CALLS B"))
    assert X.explain_orphans(orphan).first().summary == "Component 'Lonely' is identified as a candidate orphan."


def test_layers_are_looked_up_once_per_id_and_not_broadcast(facts, edge_frame):
    known = facts("qualified_name string, layer string", [("A", "domain"), ("A.in", "application"), ("B", "unknown")])
    edges = edge_frame("A.run CALLS B", "A.run CALLS B", "A.in DEPENDS_ON A", "B.x CALLS A.in.go", "A CALLS Z", "A CALLS B unresolved")
    found = A.layered_edges(known, edges)
    got = sorted((r.source_id, r.source_name, r.source_layer, r.target_id, r.target_name, r.target_layer) for r in found.collect())
    assert got == [("A.in", "A.in", "application", "A", "A", "domain"), ("A.run", "A", "domain", "B", "B", "unknown"),
                   ("B.x", "B", "unknown", "A.in.go", "A.in", "application")]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert not any("BroadcastHashJoin" in line and "LeftOuter" in line for line in plan.splitlines())


def test_windows_are_paired_by_number_over_tasks_that_follow_the_rows(spark, monkeypatch):
    from lodestone.queries import findings
    monkeypatch.setattr(findings, "ORDERS_PER_TASK", 100, raising=False)
    sf = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{sf}/orders.parquet").count()
    plan = findings.semantic_changes(spark, sf)._jdf.queryExecution().sparkPlan().toString().splitlines()
    joins = [line for line in plan if "FullOuter" in line]
    assert len(joins) == 4 and not any(name in line for line in joins for name in ("qualified_name", "source_id", "snapshot_id"))
    dealt = [line for line in plan if "REPARTITION_BY_NUM" in line]
    assert len(dealt) == 6 and all(f", {-(-orders // 100)})" in line for line in dealt)


@pytest.mark.parametrize("rows", [500_000, 2])
def test_windows_paired_by_number_equal_those_paired_by_name(spark, tmp_path, monkeypatch, rows):
    from collections import Counter

    from lodestone.queries import findings
    monkeypatch.setattr(findings, "ORDERS_PER_TASK", rows, raising=False)
    placed = [(1, 1, "F", "1995-01-01"), (2, 1, "O", "1997-06-01"), (2, 1, "F", "1998-06-01"), (2, 7, None, "1996-06-01"),
              (3, None, "F", "1998-01-01"), (4, 9, "F", "2000-12-31"), (5, 2, "P", None), (None, 2, "O", "1998-01-01"),
              (6, 2, "O", "1999-01-01"), (7, 3, "F", "2001-01-01"), (8, 3, "F", "1996-01-01"), (9, 5, "F", "1997-01-01"),
              *[(k, 4, "F", f"{1995 + k % 5}-05-05") for k in range(20, 30)]]
    (spark.createDataFrame(placed, "o_orderkey long, o_custkey long, o_orderstatus string, day string")
     .withColumn("o_orderdate", F.col("day").cast("timestamp_ntz")).drop("day").write.parquet(f"{tmp_path}/orders.parquet"))
    people = [(1, "BUILDING", 1), (1, "MACHINERY", 2), (1, "BUILDING", 1), (2, None, 3), (3, "FURNITURE", None), (4, "BUILDING", 5),
              (5, "HOUSEHOLD", None), (None, "BUILDING", 6), (8, "BUILDING", 7)]
    spark.createDataFrame(people, "c_custkey long, c_mktsegment string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    sf, pair = str(tmp_path), findings.window_pair(spark)

    def bag(df):
        return Counter(str(sorted(r.asDict(True).items())) for r in df.collect())

    by_name = (E.entity_diff(*findings._two(findings.window_entities(spark, sf), pair)),
               E.relationship_diff(*findings._two(findings.window_relationships(spark, sf), pair)))
    by_number = findings._entity_diff(spark, sf), findings._relationship_diff(spark, sf)
    for a, b in zip(by_name, by_number):
        assert a.columns == b.columns and [f.dataType for f in a.schema] == [f.dataType for f in b.schema]
        assert bag(a) == bag(b) and len(bag(a)) > 5
    assert bag(E.semantic_changes(*by_name)) == bag(E.semantic_changes(*by_number))
