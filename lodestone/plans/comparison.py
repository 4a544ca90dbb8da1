"""Comparison of snapshots: diff, changes, regressions, impact and risk in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import vocab
from lodestone.operators import evolution as E
from lodestone.operators import explain as X
from lodestone.operators import metrics as M
from lodestone.session import cut_lineage

ARCHITECTURE = ("cycles", "violations", "hotspots", "orphans")


def compare(facts: dict[str, DataFrame], pairs: DataFrame) -> dict[str, DataFrame]:
    """``facts`` holds entities, relationships, cycles, violations, hotspots and orphans of all snapshots;
    ``pairs`` names the comparisons."""
    def sides(name: str) -> tuple[DataFrame, DataFrame]:
        return E.pair_snapshots(facts[name], pairs, "baseline"), E.pair_snapshots(facts[name], pairs, "target")

    entities = cut_lineage(E.entity_diff(*sides("entities")))
    relationships = cut_lineage(E.relationship_diff(*sides("relationships")))
    baseline, target = {}, {}
    for name in ARCHITECTURE:
        baseline[name], target[name] = sides(name)
    regressions = cut_lineage(E.regressions(relationships, baseline, target))
    return {
        "entity_diff": entities, "relationship_diff": relationships, "changes": E.semantic_changes(entities, relationships),
        "regressions": regressions, "impact": E.change_impact(entities, relationships),
        "risk": E.change_risk(entities, relationships, regressions),
        "removed_dependents": E.removed_dependents(entities, relationships)}


def summary(result: dict[str, DataFrame]) -> DataFrame:
    """Counts per comparison."""
    entities = result["entity_diff"].groupBy(*E.PAIR).agg(
        *[F.count_if(F.col("change_type") == c).alias(f"entities_{c}") for c in ("added", "removed", "modified", "unchanged")])
    edges = result["relationship_diff"].groupBy(*E.PAIR).agg(
        F.count_if(F.col("change_type") == "added").alias("relationships_added"),
        F.count_if(F.col("change_type") == "removed").alias("relationships_removed"),
        F.count_if("resolution_changed").alias("resolution_changes"))
    found = result["regressions"].groupBy(*E.PAIR).agg(F.count(F.lit(1)).alias("regressions"))
    risk = result["risk"].select(*E.PAIR, "risk_level", "score")
    return (entities.join(edges, E.PAIR, "full_outer").join(found, E.PAIR, "left").join(risk, E.PAIR, "left").na.fill(0))


def stored_comparison(metrics: DataFrame, edges: DataFrame, pairs: DataFrame) -> dict[str, DataFrame]:
    """Metric and edge lifecycles with drift findings, from stored metrics and graph edges."""
    from lodestone.operators import graph as GR

    def sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        return E.pair_snapshots(df, pairs, "baseline"), E.pair_snapshots(df, pairs, "target")

    changes, moved = E.metric_diff(*sides(metrics)), E.edge_lifecycle(*sides(edges))
    on_cycle = GR.closed_trails(edges.where(F.col("relationship").isin("IMPORTS", "DEPENDS_ON")))
    return {"metrics": changes, "relationships": moved, "drift_high": E.drift_high(changes, moved),
            "drift_moderate": E.drift_moderate(*sides(on_cycle))}


def trends(snapshots: DataFrame, facts: dict[str, DataFrame]) -> DataFrame:
    """Direction of the six architecture metrics over each repository's snapshots in time order."""
    counted = snapshots.select(*vocab.KEYS, "analyzed_at")
    for name, column in (("cycles", "cycle_count"), ("violations", "violation_count"), ("orphans", "orphan_candidate_count")):
        counted = counted.join(facts[name].groupBy(*vocab.KEYS).agg(F.count(F.lit(1)).alias(column)), vocab.KEYS, "left")
    spots = facts["hotspots"].groupBy(*vocab.KEYS).agg(
        F.count(F.lit(1)).alias("hotspot_count"), F.max("fan_in").alias("max_fan_in"), F.max("fan_out").alias("max_fan_out"))
    names = ["cycle_count", "violation_count", "hotspot_count", "max_fan_in", "max_fan_out", "orphan_candidate_count"]
    wide = counted.join(spots, vocab.KEYS, "left").na.fill(0, names)
    rows = F.array(*[F.struct(F.lit(n).alias("metric_name"), F.col(n).alias("value")) for n in names])
    series = wide.select(vocab.REPO, "analyzed_at", F.explode(rows).alias("m")).select(vocab.REPO, "analyzed_at", "m.*")
    return M.trend_direction(series, "analyzed_at", [vocab.REPO, "metric_name"])


def issue_origin(snapshots: DataFrame, findings: DataFrame, issue_type: str, key: str) -> DataFrame:
    """First snapshot with a matching finding."""
    return X.issue_origins(snapshots, X.matching_issues(findings, issue_type, key))
