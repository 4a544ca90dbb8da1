from datetime import datetime

import pytest

from lodestone.plans import comparison, dossier, questions, tools

CHANGE = "commit_sha string, file_path string, change_type string, insertions int, deletions int"
COMMIT = "commit_sha string, author_name string, author_email string, committed_at timestamp, message string"
NODE = "label string, id string, name string, qualified_name string, path string, cyclomatic_complexity int"
METRIC = "entity_type string, entity_name string, metric_name string, metric_value double, metric_source string"
PARSED = "path string, name string, qualified_name string, start_line int, end_line int"


@pytest.fixture(scope="module")
def small(facts, edge_frame):
    commits = facts(COMMIT, [("c1", "Ann", "a", datetime(2026, 1, 1), "m1"), ("c2", "Ann", "a", datetime(2026, 1, 2), "m2")])
    changes = facts(CHANGE, [("c1", "pkg/a.py", "A", 3, 0), ("c2", "pkg/b.py", "M", 1, 1)])
    return {
        "nodes": facts(NODE, [("File", "pkg/a.py", "a.py", None, "pkg/a.py", None), ("Function", "pkg.a.f", "f", "pkg.a.f", None, 3),
                              ("Function", "pkg.a.g", "g", "pkg.a.g", None, 1)]),
        "edges": edge_frame("pkg/a.py CONTAINS pkg.a.f", "pkg.a.g CALLS pkg.a.f", "pkg.a.f CALLS x unresolved"),
        "metrics": facts(METRIC, [("Function", "pkg.a.f", "fan_in", 7.0, "d"), ("Function", "pkg.a.f", "cyclomatic_complexity", 3.0, "d")]),
        "functions": facts(PARSED, [("pkg/a.py", "f", "pkg.a.f", 2, 3)]), "types": facts(PARSED, []),
        "file_churn": facts("file_path string, commit_count long, churn long", [("pkg/a.py", 1, 3), ("pkg/b.py", 1, 2)]),
        "commits": commits, "file_changes": changes,
        "file_risk": facts("file_path string, risk_score double", [("pkg/a.py", 0.9), ("pkg/b.py", 0.2)]),
    }


def test_dossier(small, start, facts):
    sources = facts("path string, content string", [("pkg/a.py", "# top\ndef f():\n    return 1\n")])
    got = dossier.dossier(small, start("pkg.a.f"), "pkg.a.f", sources, "pkg/a.py")
    view = got["overview"].first()
    assert (view.complexity, view.callers, view.callees, view.file_path, view.risk) == (3.0, 7, 1, "pkg/a.py", 0.25)
    assert got["code"].first().source_code == "def f():\n    return 1"
    assert {(r.direction, r.node, r.category) for r in got["impact"].collect()} == {("upstream", "pkg.a.g", "direct"), ("downstream", "x", "unresolved")}
    assert [r.commit_sha for r in got["git_commits"].collect()] == ["c1"] and got["git_churn"].first().churn == 3
    assert got["health"].first().metrics["fan_in"] == 7.0


def test_git_context_falls_back(small):
    near = dossier.git_context(small["file_churn"], small["file_changes"], small["commits"], "b.py", None)
    assert near["churn"].first().file_path == "pkg/b.py"
    assert [(r.commit_sha, r.change_type) for r in near["recent_commits"].collect()] == [("c2", "MODIFY"), ("c1", "MODIFY")]


def test_tool_catalog(small):
    ws = tools.Workspace(small, "repo", "s1")
    assert [r.file_path for r in tools.run("get_hotspots", ws).collect()] == ["pkg/a.py"]
    assert tools.run("get_metrics", ws, entity_id="pkg.a.f").first().metrics["cyclomatic_complexity"] == 3.0
    assert [r.commit_sha for r in tools.run("get_git_context", ws, file_path="pkg/a.py").collect()] == ["c1"]
    assert tools.describe()["get_impact"]["arguments"] == {"entity_id": "required", "direction": "both", "depth": None}
    context = tools.run("get_graph_context", ws, entity_id="pkg.a.f", relationship_types=["CALLS"])
    assert {(r.source_id, r.target_id) for r in context.collect()} == {("pkg.a.g", "pkg.a.f"), ("pkg.a.f", "x")}


def test_stored_comparison_and_trend_tools(spark, facts, edge_frame):
    metrics = facts(METRIC, [("File", "m", "risk_score", 0.5, "h")], "s1").unionByName(facts(METRIC, [("File", "m", "risk_score", 0.7, "h")], "s2"))
    edges = edge_frame("m IMPORTS n", snapshot="s1").unionByName(edge_frame("m IMPORTS n", "n IMPORTS m", "m DEPENDS_ON k", snapshot="s2"))
    snapshots = spark.createDataFrame([("repo", "s1", 1), ("repo", "s2", 2)], "repository_id string, snapshot_id string, analyzed_at int")
    ws = tools.Workspace({"metrics": metrics, "edges": edges}, "repo", "s2", snapshots)
    found = {(r.severity, r.entity_name) for r in tools.run("get_drift_findings", ws, previous_snapshot_id="s1", current_snapshot_id="s2").collect()}
    assert found == {("HIGH", "m"), ("MODERATE", "m"), ("MODERATE", "n")}
    assert [r.metrics["risk_score"] for r in tools.run("get_metric_trend", ws, entity_name="m").collect()] == [0.5, 0.7]
    assert [r.repository_risk for r in tools.run("get_evolution_timeline", ws).collect()] == [0.5, 0.7]
    state = tools.run("compare_snapshots", ws, previous_snapshot_id="s1", current_snapshot_id="s2").first()
    assert (state.state, round(state.percentage_change, 3)) == ("MODIFIED", 0.4)


def test_trends_over_findings(spark, facts):
    snapshots = spark.createDataFrame([("repo", f"s{i}", i) for i in (1, 2, 3)], "repository_id string, snapshot_id string, analyzed_at int")
    def many(columns, row, counts):
        parts = [facts(columns, [row] * n, f"s{i + 1}") for i, n in enumerate(counts)]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])
    found = {"cycles": many("cycle_id string", ("c",), (0, 1, 2)), "violations": many("v string", ("v",), (3, 2, 1)),
             "orphans": many("o string", ("o",), (1, 1, 1)), "hotspots": many("fan_in long, fan_out long", (4, 1), (1, 2, 1))}
    got = {r.metric_name: (r.direction, r.delta_total) for r in comparison.trends(snapshots, found).collect()}
    assert got["cycle_count"] == ("increasing", 2) and got["violation_count"] == ("decreasing", -2)
    assert got["orphan_candidate_count"] == ("stable", 0) and got["hotspot_count"] == ("fluctuating", 0) and got["max_fan_in"] == ("stable", 0)


def test_questions_without_their_inputs(facts, edge_frame):
    ask = questions.Questions({"entities": facts("qualified_name string, file_path string, module_name string, architecture_role string, architecture_layer string",
                                                 [("a.X", "a", None, "service", "application")]),
                               "relationships": edge_frame("a.X CALLS a.Y")}, "repo", "s1")
    assert ask.execute("issue_origin").warnings and ask.execute("entity_history").warnings
    missing = ask.execute("upstream_dependents", "Nobody")
    assert missing.resolution.first().status == "not_found" and missing.paths.count() == 0
    found = ask.execute("downstream_dependencies", "X")
    assert [(e.source_id, e.source_role, e.target_role) for e in found.evidence.collect()] == [("a.X", "service", None)]
