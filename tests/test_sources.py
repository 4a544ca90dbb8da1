import subprocess

import pytest
from pyspark.sql import functions as F

from lodestone.functions.embedding import embed_units, hashing_provider
from lodestone.operators import git_metrics as G
from lodestone.operators import search as SE
from lodestone.session import cut_lineage, ensure_checkpoint_dir, small_frame
from lodestone.sources import repository as SR
from lodestone.sources.store import read_table, write_table


def test_scan(spark, tmp_path):
    tree = {"src/a.py": "x = 1\n", "src/b.TS": "", "src/c.tsx": "c", "node_modules/d.js": "d", "pkg/__init__.py": "", "docs/read me.md": "m", "deep/build/e.go": "e", "f.go": "f"}
    for name, text in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "bad.py").write_bytes(b"# \xff\n")
    rows = {r.path: r for r in SR.scan(spark, str(tmp_path), "r", "s").collect()}
    assert set(rows) == {"src/a.py", "src/c.tsx", "f.go", "bad.py", "pkg/__init__.py"}
    assert rows["src/a.py"].content == "x = 1\n" and rows["src/a.py"].language == "python" and "�" in rows["bad.py"].content
    skipped = {r.path: r.extension for r in SR.skipped_files(spark, str(tmp_path), "r", "s").collect()}
    assert skipped == {"docs/read me.md": ".md", "src/b.TS": ".TS"}


def test_read_file_refuses_escapes(spark, facts):
    files = facts("path string, content string", [("a/b.py", "1")])
    assert SR.read_file(files, "a/./c/../b.py").count() == 1
    for bad in ("/etc/passwd", "../x", "a/../../x"):
        with pytest.raises(ValueError):
            SR.read_file(files, bad)


def test_git_log(spark, tmp_path):
    repo = tmp_path / "repo"
    repo.mkdir()

    def git(*args):
        return subprocess.run(["git", "-C", str(repo), "-c", "user.name=Ann", "-c", "user.email=ann@x", *args], check=True, capture_output=True, text=True).stdout

    git("init", "-q")
    (repo / "a.py").write_text("1\n2\n")
    git("add", "."), git("commit", "-qm", "first")
    (repo / "a.py").write_text("1\n3\n4\n")
    (repo / "b.py").write_text("b\n")
    git("add", "."), git("commit", "-qm", "second, with \"quotes\"")
    git("mv", "b.py", "c.py"), git("commit", "-qm", "third")
    (tmp_path / "log.txt").write_text(git("log", "--raw", "--numstat", "-M", f"--format={SR.LOG_FORMAT}"))
    log = SR.read_log(spark, str(tmp_path / "log.txt"), "r", "s")
    commits = SR.log_commits(log).collect()
    assert [c.message for c in sorted(commits, key=lambda c: c.message)] == ["first", "second, with \"quotes\"", "third"]
    assert {c.message: c.parent_count for c in commits}["first"] == 0
    changes = {(r.file_path, r.change_type): (r.insertions, r.deletions) for r in SR.log_file_changes(log).collect()}
    assert changes == {("a.py", "A"): (2, 0), ("a.py", "M"): (2, 1), ("b.py", "A"): (1, 0), ("c.py", "R"): (0, 0)}
    churn = {r.file_path: r.churn for r in G.file_churn(SR.log_file_changes(log)).collect()}
    assert churn["a.py"] == 5


def test_store_replaces_only_its_snapshots(spark, facts, tmp_path):
    root = str(tmp_path)
    write_table(facts("v int", [(1,), (2,)], "1998"), root, "t")
    write_table(facts("v int", [(3,)], "1999"), root, "t")
    write_table(facts("v int", [(9,)], "1998"), root, "t")
    rows = sorted((r.snapshot_id, r.v) for r in read_table(spark, root, "t").collect())
    assert rows == [("1998", 9), ("1999", 3)]
    one = read_table(spark, root, "t", "repo", "1999")
    assert [r.v for r in one.collect()] == [3]
    assert "PartitionFilters: [" in one._jdf.queryExecution().toString() and "1999" in one._jdf.queryExecution().toString()


def test_store_keeps_comparisons_apart(spark, tmp_path):
    columns = "repository_id string, baseline_snapshot_id string, target_snapshot_id string, v int"
    for rows in ([("r", "1", "2", 5), ("r", "2", "3", 6)], [("r", "1", "2", 7)]):
        write_table(spark.createDataFrame(rows, columns), str(tmp_path), "changes")
    assert sorted((r.baseline_snapshot_id, r.target_snapshot_id, r.v) for r in read_table(spark, str(tmp_path), "changes").collect()) == [
        ("1", "2", 7), ("2", "3", 6)]
    assert [r.v for r in read_table(spark, str(tmp_path), "changes", target_snapshot_id="3").collect()] == [6]
    assert len(list((tmp_path / "changes").rglob("*.parquet"))) == 2


def test_embedding_and_search(spark, facts):
    units = facts("entity_id string, entity_type string, source_text string", [
        ("a", "Function", "charge a credit card"), ("b", "Function", "render the page"), ("c", "Class", "charge card twice")])
    stored = embed_units(units, dimensions=64)
    vector = hashing_provider(64)(["charge card"])[0]
    nodes = facts("id string, label string, name string, qualified_name string, path string", [("n1", "Function", "Widget", "x.Widget", None),
                                                                                              ("n2", "Repository", "widget", None, None)])
    best = SE.semantic_search(stored, units, nodes, "charge card", vector, 2).collect()
    assert {r.entity_id for r in best} == {"a", "c"} and all(0 <= r.similarity <= 1 for r in best)
    assert [r.similarity for r in SE.semantic_search(stored, units, nodes, "PAGE", [0.0] * 64).collect()] == [0.85]
    assert [(r.id, r.similarity) for r in SE.semantic_search(stored, units, nodes, "widget", None).collect()] == [("n1", 0.88)]


def test_failing_provider_is_recorded(spark, facts, monkeypatch):
    from lodestone.functions import embedding

    monkeypatch.setattr(embedding.time, "sleep", lambda s: None)

    def broken(texts):
        raise OSError("down")

    assert embedding._with_retry(broken, ["x"]) == ([None], "OSError: down")
    units = facts("entity_id string, source_text string", [("a", "x"), ("b", None)])

    def refuses(texts):
        raise ValueError("no model")

    rows = embed_units(units, refuses).collect()
    assert len(rows) == 2 and all(r.embedding is None and r.embedding_error == "ValueError: no model" for r in rows)


def test_checkpoint_folder_comes_from_the_session(spark):
    folder = ensure_checkpoint_dir(spark)
    assert folder == spark.sparkContext.getCheckpointDir()
    kept = cut_lineage(spark.range(3))
    assert kept.count() == 3 and "Join" not in kept._jdf.queryExecution().toString()


def test_extension_rules(spark):
    df = spark.createDataFrame([("a/.env",), ("b.tar.gz",), ("c",), ("d/e.PY",), ("x/y.py",)], "path string")
    got = {r.path: (r.e, r.l) for r in df.select("path", SR.extension(F.col("path")).alias("e"), SR.language_of(F.col("path")).alias("l")).collect()}
    assert got == {"a/.env": ("", None), "b.tar.gz": (".gz", None), "c": ("", None), "d/e.PY": (".PY", None), "x/y.py": (".py", "python")}


def test_small_frame_keeps_rows_and_quotes(spark):
    rows = [("a", "it's", "x"), ("b", '"q"', "y"), ("c", "?", "z")]
    assert [tuple(r) for r in small_frame(spark, ["p", "q", "r"], rows).collect()] == rows
