"""Commit-history metrics: churn, contributors, recent commits and file risk.

Inputs carry ``repository_id`` and ``snapshot_id``; every operator handles all snapshots of all
repositories in one job.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import vocab
from lodestone.functions import columns as C

KEYS = vocab.KEYS


def commit_window(commits: DataFrame, reference_time: datetime | Column, since_days: int | None = None,
                  max_count: int | None = None) -> DataFrame:
    """Newest ``max_count`` commits per snapshot that are at most ``since_days`` old; without a bound, all of them."""
    ref = reference_time if isinstance(reference_time, Column) else F.lit(reference_time)
    recent = commits if since_days is None else commits.where(F.col("committed_at") > ref - F.make_dt_interval(F.lit(since_days)))
    if max_count is None:
        return recent
    w = Window.partitionBy(*KEYS).orderBy(F.col("committed_at").desc(), "commit_sha")
    return recent.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max_count).drop("_n")


def classify_changes(numstat: DataFrame, name_status: DataFrame, commits: DataFrame) -> DataFrame:
    """Attach the change type of each changed file.

    A file without a diff entry is an addition when its commit has no parent, otherwise a
    modification. Files of commits whose parent object is missing are left out.
    """
    parents = commits.select(*KEYS, "commit_sha", "parent_count", "parent_missing")
    return (
        numstat.join(parents, ["commit_sha", *KEYS])
        .where(~F.col("parent_missing"))
        .join(name_status, ["commit_sha", "file_path", *KEYS], "left")
        .withColumn("change_type", F.coalesce(
            "change_type", F.when(F.col("parent_count") == 0, F.lit("A")).otherwise(F.lit("M"))))
        .select(*KEYS, "commit_sha", "file_path", "change_type", "insertions", "deletions")
    )


def _changes_per_file_and_commit(file_changes: DataFrame) -> DataFrame:
    return file_changes.groupBy(*KEYS, "file_path", "commit_sha").agg(
        F.sum(F.col("insertions").cast("bigint")).alias("insertions"),
        F.sum(F.col("deletions").cast("bigint")).alias("deletions"),
    )


def file_churn(file_changes: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """Per file: distinct commits, lines added and removed, churn, and churn over the maximum.

    The first step groups by (file, commit), so a file holding a large share of all changes is
    spread over many tasks before the second step counts its commits.
    """
    per_commit = _changes_per_file_and_commit(file_changes)
    times = []
    if commits is not None:
        # groupBy first: the commit table must be unique on its key
        stamps = commits.groupBy(*KEYS, "commit_sha").agg(F.max("committed_at").alias("committed_at"))
        per_commit = per_commit.join(stamps, ["commit_sha", *KEYS], "left")
        times = [F.min("committed_at").alias("first_changed_at"), F.max("committed_at").alias("last_changed_at")]
    churn = per_commit.groupBy(*KEYS, "file_path").agg(
        F.count(F.lit(1)).alias("commit_count"),
        F.sum("insertions").alias("insertions"),
        F.sum("deletions").alias("deletions"),
        *times,
    ).withColumn("churn", F.col("insertions") + F.col("deletions"))
    return C.max_normalised(churn, "churn", "normalized_churn", KEYS)


def contributors(commits: DataFrame, file_changes: DataFrame) -> DataFrame:
    """Per author: commits, files touched, lines added and removed, first and last commit."""
    activity = commits.groupBy(*KEYS, "author_email").agg(
        F.max_by("author_name", F.struct("committed_at", "commit_sha")).alias("author_name"),
        F.countDistinct("commit_sha").alias("commit_count"),
        F.min("committed_at").alias("first_commit_at"),
        F.max("committed_at").alias("last_commit_at"),
    )
    authors = commits.select(*KEYS, "commit_sha", "author_email").dropDuplicates(["commit_sha", *KEYS])
    # One row per (author, file) before the count, so a busy author never sits in one task.
    touched = (
        file_changes.join(authors, ["commit_sha", *KEYS])
        .groupBy(*KEYS, "author_email", "file_path")
        .agg(F.sum(F.col("insertions").cast("bigint")).alias("insertions"),
             F.sum(F.col("deletions").cast("bigint")).alias("deletions"))
        .groupBy(*KEYS, "author_email")
        .agg(F.count(F.lit(1)).alias("files_touched"),
             F.sum("insertions").alias("total_insertions"),
             F.sum("deletions").alias("total_deletions"))
    )
    zero = F.lit(0).cast("bigint")
    return activity.join(touched, ["author_email", *KEYS], "left").select(
        *KEYS, "author_email", "author_name", "commit_count",
        F.coalesce("files_touched", zero).alias("files_touched"),
        F.coalesce("total_insertions", zero).alias("total_insertions"),
        F.coalesce("total_deletions", zero).alias("total_deletions"),
        "first_commit_at", "last_commit_at",
    )


def recent_commits_per_file(file_changes: DataFrame, commits: DataFrame, limit: int = 5,
                            tie_break: tuple[str, ...] = ()) -> DataFrame:
    """The newest ``limit`` changes of every file, with their commits.

    Spark pushes the rank limit below the shuffle, so at most ``limit`` rows per file and
    map task are moved.
    """
    joined = file_changes.join(commits, ["commit_sha", *KEYS])
    order = [F.col("committed_at").desc(), F.col("commit_sha"), *[F.col(c) for c in tie_break]]
    w = Window.partitionBy(*KEYS, "file_path").orderBy(*order)
    return joined.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= limit)


def git_overview(commits: DataFrame) -> DataFrame:
    """Commit and contributor counts per snapshot."""
    return commits.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("total_commits"),
        F.countDistinct("author_email").alias("total_contributors"),
    ).withColumn("git_available", F.col("total_commits") > 0)


def complexity_by_file(function_metrics: DataFrame, contains: DataFrame | None = None) -> DataFrame:
    """Mean normalised complexity per function, then the highest per file.

    ``contains`` (file_path, entity_name) places a function in its file; without it the file is
    read off the qualified name.
    """
    per_function = (
        function_metrics.where(F.col("metric_name") == "normalized_complexity")
        .groupBy(*KEYS, "entity_name").agg(F.avg("metric_value").alias("mean_complexity"))
    )
    if contains is not None:
        placed = per_function.join(contains, ["entity_name", *KEYS])
    else:
        path = F.concat(F.translate(C.owner_of(F.col("entity_name")), ".", "/"), F.lit(".py"))
        placed = per_function.withColumn("file_path", path).where(F.col("file_path").isNotNull())
    return placed.groupBy(*KEYS, "file_path").agg(F.max("mean_complexity").alias("normalized_complexity"))


def file_risk(complexity: DataFrame, churn: DataFrame, coupling: DataFrame) -> DataFrame:
    """Weighted risk per file; the band uses the unrounded score, the stored score is rounded.

    ``coupling`` carries ``module_key`` and ``normalized_coupling``; a file's key is its path with
    slashes as dots and without ``.py``.
    """
    weights = vocab.RISK_WEIGHTS
    zero = F.lit(0.0)
    signals = complexity.select(*KEYS, "file_path", "normalized_complexity").join(
        churn.select(*KEYS, "file_path", "normalized_churn"), ["file_path", *KEYS], "full_outer")
    keyed = signals.withColumn(
        "module_key", F.replace(F.translate("file_path", "/", "."), F.lit(".py"), F.lit("")))
    joined = keyed.join(coupling.select(*KEYS, "module_key", "normalized_coupling"), ["module_key", *KEYS], "left")
    score = (
        F.lit(weights["complexity"]) * F.coalesce("normalized_complexity", zero)
        + F.lit(weights["coupling"]) * F.coalesce("normalized_coupling", zero)
        + F.lit(weights["churn"]) * F.coalesce("normalized_churn", zero)
    )
    scored = joined.withColumn("_score", score)
    return scored.select(
        *KEYS, "file_path",
        F.round("_score", 4).alias("risk_score"),
        C.risk_band(F.col("_score")).alias("risk_label"),
        F.element_at(C.literal_map(vocab.RISK_LABEL_CODE), C.risk_band(F.col("_score"))).alias("risk_code"),
    )


def risk_hotspots(risk: DataFrame, limit: int = 20, floor: float = 0.30) -> DataFrame:
    """The highest-risk files at or above ``floor``: a TakeOrderedAndProject, not a full sort."""
    return (risk.where(F.col("risk_score") >= floor)
            .orderBy(F.col("risk_score").desc_nulls_last(), "file_path").limit(limit))


def clamped_hotspot_risk(signals: DataFrame) -> DataFrame:
    """Alternative score from raw file signals: each over its maximum (at least 1), clamped to 1.

    ``signals`` carries ``complexity``, ``fan_in``, ``fan_out`` and ``churn`` per file. The bands
    apply to the rounded score.
    """
    raw = signals.withColumn("coupling", F.col("fan_in") + F.col("fan_out"))
    tops = raw.groupBy(*KEYS).agg(*[F.greatest(F.max(n), F.lit(1)).alias(f"top_{n}") for n in vocab.RISK_WEIGHTS])
    score = sum(
        (F.lit(weight) * F.least(F.col(name) / F.col(f"top_{name}"), F.lit(1.0))
         for name, weight in vocab.RISK_WEIGHTS.items()),
        start=F.lit(0.0),
    )
    level = (F.when(F.col("risk_score") >= 0.9, "CRITICAL").when(F.col("risk_score") >= 0.8, "HIGH")
             .when(F.col("risk_score") >= 0.6, "MODERATE").otherwise("LOW"))
    return (raw.join(tops, KEYS, "left").withColumn("risk_score", F.round(score, 4))
            .select(*KEYS, "file_path", "risk_score", level.alias("risk_label")))


def files_by_churn(churn: DataFrame, by: str = "churn") -> DataFrame:
    return churn.orderBy(F.col(by).desc_nulls_first(), "file_path")
