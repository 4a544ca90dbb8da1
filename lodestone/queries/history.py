"""Commit-history queries over the warehouse, each with its SQL statement."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import columns as C
from lodestone.operators import git_metrics as G
from lodestone.queries import sql as S
from lodestone.sources import warehouse as W

KEYS = ["repository_id", "snapshot_id"]
WINDOW_END = datetime(2001, 8, 1)


def file_churn(spark: SparkSession, sf: str) -> DataFrame:
    out = G.file_churn(W.file_changes(spark, sf), W.commits(spark, sf))
    return out.select("file_path", "commit_count", "insertions", "deletions", "churn",
                      F.round("normalized_churn", 6).alias("normalized_churn"), "first_changed_at", "last_changed_at")


FILE_CHURN = f"""WITH {S.CHANGES}, {S.COMMITS}, per AS (
 SELECT c.file_path, count(DISTINCT c.commit_sha) AS commit_count, CAST(sum(c.insertions) AS BIGINT) AS insertions,
  CAST(sum(c.deletions) AS BIGINT) AS deletions, min(o.committed_at) AS first_changed_at, max(o.committed_at) AS last_changed_at
 FROM changes c LEFT JOIN commits o USING (commit_sha) GROUP BY 1)
SELECT file_path, commit_count, insertions, deletions, insertions + deletions AS churn,
 round((insertions + deletions) / CAST(max(insertions + deletions) OVER () AS DOUBLE), 6) AS normalized_churn,
 first_changed_at, last_changed_at FROM per"""


def contributors(spark: SparkSession, sf: str) -> DataFrame:
    return G.contributors(W.commits(spark, sf), W.file_changes(spark, sf)).drop(*KEYS)


CONTRIBUTORS = f"""WITH {S.CHANGES}, {S.COMMITS}, a AS (
 SELECT author_email, min(author_name) AS author_name, count(DISTINCT commit_sha) AS commit_count,
  min(committed_at) AS first_commit_at, max(committed_at) AS last_commit_at FROM commits GROUP BY 1),
b AS (SELECT author_email, count(DISTINCT file_path) AS files_touched, CAST(sum(insertions) AS BIGINT) AS total_insertions,
  CAST(sum(deletions) AS BIGINT) AS total_deletions FROM changes JOIN commits USING (commit_sha) GROUP BY 1)
SELECT author_email, author_name, commit_count, coalesce(files_touched, 0) AS files_touched,
 coalesce(total_insertions, 0) AS total_insertions, coalesce(total_deletions, 0) AS total_deletions,
 first_commit_at, last_commit_at FROM a LEFT JOIN b USING (author_email)"""


def recent_commits_per_file(spark: SparkSession, sf: str) -> DataFrame:
    out = G.recent_commits_per_file(W.file_changes(spark, sf), W.commits(spark, sf), 5,
                                    ("insertions", "deletions", "change_type"))
    return out.select("file_path", "recency", "commit_sha", "author_name", "message", "committed_at", "insertions",
                      "deletions", "change_type")


RECENT_COMMITS = f"""WITH {S.CHANGES}, {S.COMMITS}
SELECT * FROM (SELECT file_path, row_number() OVER (PARTITION BY file_path
  ORDER BY committed_at DESC, commit_sha, insertions, deletions, change_type) AS recency,
  commit_sha, author_name, message, committed_at, insertions, deletions, change_type
 FROM changes JOIN commits USING (commit_sha)) WHERE recency <= 5"""


def commits_in_window(spark: SparkSession, sf: str) -> DataFrame:
    return G.commit_window(W.commits(spark, sf), WINDOW_END, since_days=365, max_count=1000).drop(*KEYS)


COMMITS_IN_WINDOW = f"""WITH {S.COMMITS} SELECT * FROM commits WHERE committed_at > TIMESTAMP '2001-08-01' - INTERVAL 365 DAY
ORDER BY committed_at DESC, commit_sha LIMIT 1000"""


def change_types(spark: SparkSession, sf: str) -> DataFrame:
    """Lines flagged N have no diff entry, order status F has no parent, priority 5 lost its parent."""
    changes = W.file_changes(spark, sf)
    numstat = changes.drop("change_type")
    status = (changes.where(F.col("change_type") != "N").groupBy(*KEYS, "commit_sha", "file_path")
              .agg(F.min("change_type").alias("change_type")))
    orders = W.table(spark, sf, "orders").select(
        *W.keys("o_orderkey"), F.col("o_orderkey").cast("string").alias("commit_sha"),
        F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("parent_count"),
        (F.col("o_orderpriority") == "5-LOW").alias("parent_missing"))
    out = G.classify_changes(numstat, status, orders)
    return out.groupBy("file_path", "change_type").agg(
        F.count(F.lit(1)).alias("changes"), F.sum(F.col("insertions").cast("bigint")).alias("insertions"))


CHANGE_TYPES = f"""WITH {S.CHANGES}, st AS (SELECT commit_sha, file_path, min(change_type) AS ct FROM changes
  WHERE change_type <> 'N' GROUP BY 1, 2)
SELECT c.file_path, coalesce(st.ct, CASE WHEN o.o_orderstatus = 'F' THEN 'A' ELSE 'M' END) AS change_type,
 count(*) AS changes, CAST(sum(c.insertions) AS BIGINT) AS insertions
FROM changes c JOIN orders o ON CAST(o.o_orderkey AS VARCHAR) = c.commit_sha
LEFT JOIN st ON st.commit_sha = c.commit_sha AND st.file_path = c.file_path
WHERE o.o_orderpriority <> '5-LOW' GROUP BY 1, 2"""


def git_overview(spark: SparkSession, sf: str) -> DataFrame:
    return G.git_overview(W.commits(spark, sf))


GIT_OVERVIEW = f"""WITH {S.COMMITS} SELECT 'shop' AS repository_id, 'head' AS snapshot_id, count(*) AS total_commits,
 count(DISTINCT author_email) AS total_contributors, count(*) > 0 AS git_available FROM commits"""


def _risk(spark: SparkSession, sf: str) -> DataFrame:
    complexity = G.complexity_by_file(W.complexity_metrics(spark, sf))
    churn = G.file_churn(W.file_changes(spark, sf))
    coupling = C.max_normalised(
        W.table(spark, sf, "part").select(
            *W.keys("p_partkey"),
            W.module_name(F.col("p_partkey")).alias("module_key"), "p_retailprice"),
        "p_retailprice", "normalized_coupling", KEYS)
    return G.file_risk(complexity, churn, coupling)


def complexity_by_file(spark: SparkSession, sf: str) -> DataFrame:
    out = G.complexity_by_file(W.complexity_metrics(spark, sf))
    return out.select("file_path", F.round("normalized_complexity", 6).alias("normalized_complexity"))


_COMPLEXITY = f"""cx AS (SELECT {S.path('p_partkey')} AS file_path, {S.module('p_partkey')} AS module_key,
  p_size / CAST(max(p_size) OVER () AS DOUBLE) AS c, p_retailprice / max(p_retailprice) OVER () AS coupling FROM part)"""
COMPLEXITY = f"WITH {_COMPLEXITY} SELECT file_path, round(c, 6) AS normalized_complexity FROM cx"


def file_risk(spark: SparkSession, sf: str) -> DataFrame:
    return _risk(spark, sf).drop(*KEYS)


_RISK = f"""{S.CHANGES}, {_COMPLEXITY}, ch AS (SELECT file_path, CAST(sum(insertions) + sum(deletions) AS BIGINT) AS churn
  FROM changes GROUP BY 1), chn AS (SELECT file_path, churn / CAST(max(churn) OVER () AS DOUBLE) AS n FROM ch),
 scored AS (SELECT coalesce(cx.file_path, chn.file_path) AS file_path,
  0.4::DOUBLE * coalesce(c, 0) + 0.3::DOUBLE * coalesce(coupling, 0) + 0.3::DOUBLE * coalesce(n, 0) AS s
  FROM cx FULL OUTER JOIN chn ON cx.file_path = chn.file_path),
 risk AS (SELECT file_path, round(s, 4) AS risk_score,
  CASE WHEN s >= 0.8 THEN 'CRITICAL' WHEN s >= 0.6 THEN 'HIGH' WHEN s >= 0.3 THEN 'MODERATE' ELSE 'LOW' END AS risk_label,
  CASE WHEN s >= 0.8 THEN 3.0::DOUBLE WHEN s >= 0.6 THEN 2.0 WHEN s >= 0.3 THEN 1.0 ELSE 0.0 END AS risk_code FROM scored)"""
FILE_RISK = f"WITH {_RISK} SELECT * FROM risk"


def risk_hotspots(spark: SparkSession, sf: str) -> DataFrame:
    return G.risk_hotspots(_risk(spark, sf), 20).drop(*KEYS)


RISK_HOTSPOTS = f"WITH {_RISK} SELECT * FROM risk WHERE risk_score >= 0.3 ORDER BY risk_score DESC, file_path LIMIT 20"


def hotspot_risk_clamped(spark: SparkSession, sf: str) -> DataFrame:
    line = W.table(spark, sf, "lineitem").select(*W.keys("l_partkey"),
                                                 W.module_path(F.col("l_partkey")).alias("file_path"), "l_linenumber", "l_quantity")
    signals = line.groupBy(*KEYS, "file_path").agg(
        F.max(F.col("l_quantity").cast("int")).alias("complexity"), F.max("l_linenumber").alias("fan_in"),
        F.min("l_linenumber").alias("fan_out"), F.count(F.lit(1)).alias("churn"))
    return G.clamped_hotspot_risk(signals).drop(*KEYS)


HOTSPOT_CLAMPED = f"""WITH s AS (SELECT {S.path('l_partkey')} AS file_path, max(CAST(l_quantity AS INT)) AS cx,
  max(l_linenumber) + min(l_linenumber) AS cp, count(*) AS ch FROM lineitem GROUP BY 1),
 r AS (SELECT file_path, round(0.0::DOUBLE + 0.4::DOUBLE * least(cx / CAST(greatest(max(cx) OVER (), 1) AS DOUBLE), 1.0::DOUBLE)
  + 0.3::DOUBLE * least(cp / CAST(greatest(max(cp) OVER (), 1) AS DOUBLE), 1.0::DOUBLE)
  + 0.3::DOUBLE * least(ch / CAST(greatest(max(ch) OVER (), 1) AS DOUBLE), 1.0::DOUBLE), 4) AS risk_score FROM s)
SELECT file_path, risk_score, CASE WHEN risk_score >= 0.9 THEN 'CRITICAL' WHEN risk_score >= 0.8 THEN 'HIGH'
 WHEN risk_score >= 0.6 THEN 'MODERATE' ELSE 'LOW' END AS risk_label FROM r"""

QUERIES = {
    "file_churn": (file_churn, FILE_CHURN),
    "contributors": (contributors, CONTRIBUTORS),
    "recent_commits_per_file": (recent_commits_per_file, RECENT_COMMITS),
    "commits_in_window": (commits_in_window, COMMITS_IN_WINDOW),
    "change_types": (change_types, CHANGE_TYPES),
    "git_overview": (git_overview, GIT_OVERVIEW),
    "complexity_by_file": (complexity_by_file, COMPLEXITY),
    "file_risk": (file_risk, FILE_RISK),
    "risk_hotspots": (risk_hotspots, RISK_HOTSPOTS),
    "hotspot_risk_clamped": (hotspot_risk_clamped, HOTSPOT_CLAMPED),
}
