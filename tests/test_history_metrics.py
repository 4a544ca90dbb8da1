from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestone.functions import columns as C
from lodestone.operators import git_metrics as G
from lodestone.operators import metrics as M

CHANGE = "commit_sha string, file_path string, change_type string, insertions int, deletions int"
COMMIT = "commit_sha string, author_name string, author_email string, committed_at timestamp, message string"


def test_file_churn(facts):
    changes = facts(CHANGE, [("c1", "a.py", "M", 10, 5), ("c2", "a.py", "M", 20, 0), ("c3", "b.py", "M", 50, 50)])
    rows = {r.file_path: r for r in G.file_churn(changes).collect()}
    assert (rows["a.py"].churn, rows["a.py"].commit_count, rows["a.py"].normalized_churn) == (35, 2, 0.35)
    assert (rows["b.py"].churn, rows["b.py"].commit_count, rows["b.py"].normalized_churn) == (100, 1, 1.0)


def test_churn_of_untouched_lines_is_zero(facts):
    rows = G.file_churn(facts(CHANGE, [("c1", "a.py", "A", 0, 0)])).collect()
    assert rows[0].normalized_churn == 0.0


def test_contributors(facts):
    commits = facts(COMMIT, [("c1", "Alice", "a@example.com", datetime(2026, 8, 1), "m"),
                             ("c2", "Alice", "a@example.com", datetime(2026, 8, 2), "m")])
    changes = facts(CHANGE, [("c1", "a.py", "M", 10, 5), ("c2", "b.py", "M", 20, 0), ("gone", "c.py", "M", 9, 9)])
    row = G.contributors(commits, changes).first()
    assert (row.author_email, row.author_name, row.commit_count, row.files_touched) == ("a@example.com", "Alice", 2, 2)
    assert (row.total_insertions, row.total_deletions) == (30, 5)
    assert (row.first_commit_at, row.last_commit_at) == (datetime(2026, 8, 1), datetime(2026, 8, 2))


@pytest.mark.parametrize("score,band", [(0.10, "LOW"), (0.30, "MODERATE"), (0.59, "MODERATE"), (0.60, "HIGH"),
                                        (0.79, "HIGH"), (0.80, "CRITICAL"), (0.95, "CRITICAL")])
def test_risk_bands(spark, score, band):
    assert spark.range(1).select(C.risk_band(F.lit(score))).first()[0] == band


def test_file_risk_combines_signals(facts):
    complexity = facts("file_path string, normalized_complexity double", [("src/a.py", 1.0)])
    churn = facts("file_path string, normalized_churn double", [("src/a.py", 0.5), ("src/b.py", 1.0)])
    coupling = facts("module_key string, normalized_coupling double", [("src.a", 1.0)])
    rows = {r.file_path: r for r in G.file_risk(complexity, churn, coupling).collect()}
    assert (rows["src/a.py"].risk_score, rows["src/a.py"].risk_label, rows["src/a.py"].risk_code) == (0.85, "CRITICAL", 3.0)
    assert (rows["src/b.py"].risk_score, rows["src/b.py"].risk_label) == (0.3, "MODERATE")


def test_commit_window(facts):
    commits = facts(COMMIT, [(f"c{i}", "A", "a", datetime(2026, 1, i), "m") for i in range(1, 6)] + [("old", "A", "a", datetime(2024, 1, 1), "m")])
    kept = G.commit_window(commits, datetime(2026, 1, 6), since_days=30, max_count=3)
    assert sorted(r.commit_sha for r in kept.collect()) == ["c3", "c4", "c5"]


SERIES = "metric_name string, ord int, value long"


def series(facts, values, name="m"):
    return facts(SERIES, [(name, i, v) for i, v in enumerate(values)])


@pytest.mark.parametrize("values,expected", [([10, 15, 20], "INCREASING"), ([20, 15, 10], "DECREASING"), ([10, 10, 10], "STABLE"),
                                             ([10, 15, 12, 18], "VOLATILE"), ([10], "UNKNOWN"), ([1, 1, 2], "VOLATILE")])
def test_strict_trend(facts, values, expected):
    assert M.strict_trend(series(facts, values), "ord", ["repository_id", "metric_name"]).first().trend == expected


@pytest.mark.parametrize("values,expected,delta", [([0, 1, 2], "increasing", 2), ([3, 2, 1], "decreasing", -2), ([4, 4], "stable", 0),
                                                   ([1, 3, 2], "fluctuating", 1), ([1, 1, 2], "increasing", 1), ([5], "insufficient_data", 0)])
def test_trend_direction(facts, values, expected, delta):
    row = M.trend_direction(series(facts, values), "ord", ["repository_id", "metric_name"]).first()
    assert (row.direction, row.delta_total) == (expected, delta)


def test_percentile_rank_matches_definition(facts):
    df = facts("id string, v long", [(str(i), v) for i, v in enumerate([0, 0, 1, 2, 2, 5])])
    got = {r.id: r.p for r in C.percentile_rank(df, "v", "p", ["repository_id", "snapshot_id"]).collect()}
    assert got["0"] == pytest.approx(200 / 6) and got["2"] == pytest.approx(50.0) and got["5"] == 100.0


@pytest.mark.parametrize("raw,path,key", [
    ("api//v1/users/", "/api/v1/users", "/api/v1/users"), ("/", "/", "/"), ("/users/{user_id}", "/users/{user_id}", "/users/{_}"),
    ("/users/<int:user_id>", "/users/<int:user_id>", "/users/{_}"), ("/users/:id/posts", "/users/:id/posts", "/users/{_}/posts")])
def test_http_paths(spark, raw, path, key):
    row = spark.range(1).select(C.http_path(F.lit(raw)).alias("p"), C.http_path_key(F.lit(raw)).alias("k")).first()
    assert (row.p, row.k) == (path, key)


def test_static_metrics_keep_isolated_nodes(facts, edge_frame):
    nodes = facts("id string, label string, cyclomatic_complexity int",
                  [("f", "Function", 4), ("g", "Function", None), ("m", "Module", None), ("n", "Module", None)])
    edges = edge_frame("f CALLS g", "g CALLS f unresolved", "m IMPORTS n", "n IMPORTS m", "m IMPORTS m")
    got = {(r.entity_name, r.metric_name): r.metric_value for r in M.static_metrics(nodes, edges).collect()}
    assert got[("f", "fan_out")] == 1 and got[("f", "fan_in")] == 0 and got[("g", "cyclomatic_complexity")] == 0
    assert got[("f", "normalized_complexity")] == 1.0 and got[("m", "outgoing_coupling")] == 1
    # from m: m->m, m->n->m, and both combined in either order
    assert got[("m", "circular_dependencies")] == 4


def test_repository_health(facts):
    rows = [("Function", "a", "cyclomatic_complexity", 12.0, "d"), ("Function", "b", "cyclomatic_complexity", 3.0, "d"),
            ("Module", "m", "outgoing_coupling", 6.0, "d"), ("Module", "m", "circular_dependencies", 2.0, "d")]
    metrics = facts("entity_type string, entity_name string, metric_name string, metric_value double, metric_source string", rows)
    h = M.repository_health(metrics).first()
    assert (h.total_functions, h.total_modules, h.average_complexity, h.maximum_complexity) == (2, 1, 7.5, 12.0)
    assert (h.circular_dependencies, h.high_complexity_functions, h.high_coupling_modules) == (2.0, 1, 1)


def test_history_of_one_entity_compares_its_rows_only(spark):
    from lodestone.queries import findings
    plan = findings.entity_history(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    scans = sum("Relation [" in line and "o_custkey" in line for line in plan.splitlines())
    kept = sum("Filter" in line and "= customer:11" in line for line in plan.splitlines())
    assert scans and kept >= scans
