"""Snapshot comparison: diffs, semantic changes, regressions, change impact, risk and drift.

A comparison is carried as ``repository_id, baseline_snapshot_id, target_snapshot_id``; the two
sides arrive as frames that hold only the compared snapshots (see ``pair_snapshots``), so many
comparisons run in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import vocab
from lodestone.functions import columns as C
from lodestone.operators import graph, reach
from lodestone.session import cut_lineage

PAIR = [vocab.REPO, "baseline_snapshot_id", "target_snapshot_id"]
COMPARED_FIELDS = ["architecture_role", "architecture_layer", "file_path"]


def pair_snapshots(facts: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """Rows of the baseline or the target snapshots, keyed by the comparison."""
    wanted = pairs.select(*PAIR).withColumn(vocab.SNAP, F.col(f"{side}_snapshot_id"))
    return facts.join(wanted, vocab.KEYS).drop(vocab.SNAP)


def consecutive_pairs(snapshots: DataFrame) -> DataFrame:
    """Each snapshot with the one before it; the window holds one row per snapshot."""
    from pyspark.sql import Window

    w = Window.partitionBy(vocab.REPO).orderBy("analyzed_at", vocab.SNAP)
    return (snapshots.withColumn("baseline_snapshot_id", F.lag(vocab.SNAP).over(w))
            .where(F.col("baseline_snapshot_id").isNotNull())
            .select(vocab.REPO, "baseline_snapshot_id", F.col(vocab.SNAP).alias("target_snapshot_id")))


def paired(baseline: DataFrame, target: DataFrame, keys: list[str], values: list[str], over: list[str] = PAIR,
           tasks: int = 1) -> DataFrame:
    """Both sides of each key, values as ``old_`` and ``new_``.

    Keys may be numbers that stand for names: a shuffle and a sort then hold a fraction of the bytes, and names are made for the
    rows that are kept. A single comparison needs no ``over``. More than one of ``tasks`` deals the rows over at least so many;
    left alone, Spark packs partitions by their compressed bytes, so a task's rows grow with the input.
    """
    b = baseline.select(*over, *keys, F.lit(True).alias("in_baseline"), *[F.col(v).alias(f"old_{v}") for v in values])
    t = target.select(*over, *keys, F.lit(True).alias("in_target"), *[F.col(v).alias(f"new_{v}") for v in values])
    if tasks > 1:
        b, t = b.repartition(tasks, *keys, *over), t.repartition(tasks, *keys, *over)
    return b.join(t, [*keys, *over], "full_outer").na.fill(False, ["in_baseline", "in_target"])


def entity_diff(baseline: DataFrame, target: DataFrame) -> DataFrame:
    """added / removed / modified / unchanged per entity, with the changed fields as a map."""
    return entity_states(paired(baseline, target, ["qualified_name"], ["entity_kind", *COMPARED_FIELDS]))


def entity_states(both: DataFrame) -> DataFrame:
    """``entity_diff`` of entities that are paired already."""
    changed = F.filter(
        F.array(*[F.when(~F.col(f"old_{f}").eqNullSafe(F.col(f"new_{f}")),
                         F.struct(F.lit(f).alias("field"), F.col(f"old_{f}").alias("old"),
                                  F.col(f"new_{f}").alias("new"))) for f in COMPARED_FIELDS]),
        lambda x: x.isNotNull())
    in_both = F.col("in_baseline") & F.col("in_target")
    change = (F.when(~F.col("in_baseline"), "added").when(~F.col("in_target"), "removed")
              .when(F.size(changed) > 0, "modified").otherwise("unchanged"))
    return both.select(
        *PAIR, "qualified_name", F.coalesce("new_entity_kind", "old_entity_kind").alias("entity_kind"),
        change.alias("change_type"),
        F.when(in_both, changed).otherwise(F.array().cast("array<struct<field:string,old:string,new:string>>"))
        .alias("field_changes"),
        *[F.col(f"{side}_{f}") for f in COMPARED_FIELDS for side in ("old", "new")])


def relationship_diff(baseline: DataFrame, target: DataFrame) -> DataFrame:
    """added / removed / unchanged per edge; a changed confidence alone leaves it unchanged."""
    return relationship_states(paired(baseline, target, ["source_id", "relationship", "target_id"], ["resolution"]))


def relationship_states(both: DataFrame) -> DataFrame:
    """``relationship_diff`` of edges that are paired already."""
    change = (F.when(~F.col("in_baseline"), "added").when(~F.col("in_target"), "removed").otherwise("unchanged"))
    moved = F.col("in_baseline") & F.col("in_target") & (F.col("old_resolution") != F.col("new_resolution"))
    return both.select(
        *PAIR, F.concat("source_id", F.lit("->"), "relationship", F.lit("->"), "target_id").alias("canonical_id"),
        "source_id", "relationship", "target_id", change.alias("change_type"),
        "old_resolution", "new_resolution", moved.alias("resolution_changed"), "in_baseline", "in_target")


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("None")) for p in parts])


def semantic_changes(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Role, layer, endpoint, dependency and confidence changes, one row each."""
    name = F.col("qualified_name")
    null = F.lit(None).cast("string")

    def fact(change_id: Column, category: Column, entity: Column, old: Column, new: Column, text: Column) -> Column:
        return F.struct(change_id.alias("change_id"), category.alias("category"), entity.alias("entity_id"),
                        old.alias("old_value"), new.alias("new_value"), text.alias("description"))

    def field_fact(field: str, category: str, label: str) -> Column:
        old, new = F.col(f"old_{field}"), F.col(f"new_{field}")
        hit = (F.col("change_type") == "modified") & ~old.eqNullSafe(new)
        return F.when(hit, fact(_text(f"{category}:", name, ":", old, "->", new), F.lit(category), name, old, new,
                                _text(f"Architectural {label} of '", name, "' changed from '", old, "' to '", new, "'")))

    endpoint = F.col("entity_kind") == "Endpoint"
    added = endpoint & (F.col("change_type") == "added")
    removed = endpoint & (F.col("change_type") == "removed")
    from_entities = entities.where(F.col("change_type") != "unchanged").select(*PAIR, F.explode(F.filter(F.array(
        field_fact("architecture_role", "role_change", "role"),
        field_fact("architecture_layer", "layer_change", "layer"),
        F.when(added, fact(_text("endpoint_added:", name), F.lit("endpoint_added"), name, null, name,
                           _text("New HTTP endpoint added: '", name, "'"))),
        F.when(removed, fact(_text("endpoint_removed:", name), F.lit("endpoint_removed"), name, name, null,
                             _text("HTTP endpoint removed: '", name, "'"))),
    ), lambda x: x.isNotNull())).alias("c"))

    cid, src, rel, dst = (F.col(c) for c in ("canonical_id", "source_id", "relationship", "target_id"))
    old_r, new_r = F.col("old_resolution"), F.col("new_resolution")
    better = C.confidence_rank(new_r) < C.confidence_rank(old_r)
    arrow = _text(rel, " relationship: '", src, "' -> '", dst, "'")
    shift = _text("Resolution of ", rel, " to '", dst, "' ")
    change = (
        F.when(F.col("change_type") == "added",
               fact(_text("rel_added:", cid), _text("dependency_added:", F.lower(rel)), src, null, dst,
                    F.concat(F.lit("Added "), arrow)))
        .when(F.col("change_type") == "removed",
              fact(_text("rel_removed:", cid), _text("dependency_removed:", F.lower(rel)), src, dst, null,
                   F.concat(F.lit("Removed "), arrow)))
        .when(better, fact(_text("resolution_improved:", cid), F.lit("resolution_improved"), src, old_r, new_r,
                           F.concat(shift, _text("improved from '", old_r, "' to '", new_r, "'"))))
        .otherwise(fact(_text("resolution_degraded:", cid), F.lit("resolution_degraded"), src, old_r, new_r,
                        F.concat(shift, _text("degraded from '", old_r, "' to '", new_r, "'")))))
    from_edges = (relationships.where((F.col("change_type") != "unchanged") | F.col("resolution_changed"))
                  .select(*PAIR, change.alias("c")))
    return from_entities.unionByName(from_edges).select(*PAIR, "c.*")


def _regression(df: DataFrame, kind: str, regression_id: Column, severity: Column, entity: Column, message: Column,
                evidence: dict[str, Column]) -> DataFrame:
    entries = [F.lit(x) if i == 0 else F.coalesce(x.cast("string"), F.lit(""))
               for pair in evidence.items() for i, x in enumerate(pair)]
    return df.select(*PAIR, F.lit(kind).alias("regression_type"), regression_id.alias("regression_id"),
                     severity.alias("severity"), entity.alias("affected_entity"), message.alias("message"),
                     F.create_map(*entries).alias("evidence"))


def new_cycles(baseline: DataFrame, target: DataFrame) -> DataFrame:
    fresh = target.join(baseline.select(*PAIR, "cycle_id").distinct(), ["cycle_id", *PAIR], "left_anti")
    path = F.array_join(F.concat("members", F.array(F.element_at("members", 1))), " -> ")
    return _regression(
        fresh, "new_cycle", _text("new_cycle:", F.col("cycle_id")), F.col("severity"), F.element_at("members", 1),
        F.concat(F.lit("Newly introduced circular dependency: "), path),
        {"cycle_members": F.array_join("members", ","), "severity": F.col("severity")})


def new_violations(baseline: DataFrame, target: DataFrame) -> DataFrame:
    keys = ["violation_type", "source_qualified_name", "target_qualified_name"]
    fresh = target.join(baseline.select(*PAIR, *keys).distinct(), [*PAIR, *keys], "left_anti")
    kind, src, dst = (F.col(k) for k in keys)
    return _regression(
        fresh, "new_architecture_violation", _text("new_violation:", kind, ":", src, "->", dst), F.col("severity"), src,
        _text("Newly introduced ", kind, " violation: ", F.col("message")),
        {"violation_type": kind, "source": src, "target": dst, "severity": F.col("severity")})


def hotspot_growth(baseline: DataFrame, target: DataFrame, fan_in_delta: int = 2, fan_out_delta: int = 2) -> DataFrame:
    old = baseline.select(*PAIR, "qualified_name", F.col("fan_in").alias("_in"), F.col("fan_out").alias("_out"))
    joined = target.join(old, ["qualified_name", *PAIR], "left").na.fill(0, ["_in", "_out"])
    d_in, d_out = F.col("fan_in") - F.col("_in"), F.col("fan_out") - F.col("_out")
    grown = joined.where((d_in >= fan_in_delta) | (d_out >= fan_out_delta))
    name = F.col("qualified_name")
    return _regression(
        grown, "hotspot_growth", _text("hotspot_growth:", name),
        F.when(d_in < 5, "medium").otherwise("high"), name,
        _text("Architectural hotspot '", name, "' grew significantly: fan-in changed from ", F.col("_in"), " to ",
              F.col("fan_in"), " (+", d_in, "), fan-out changed from ", F.col("_out"), " to ", F.col("fan_out"),
              " (+", d_out, ")."),
        {"old_fan_in": F.col("_in"), "new_fan_in": F.col("fan_in"), "fan_in_delta": d_in,
         "old_fan_out": F.col("_out"), "new_fan_out": F.col("fan_out"), "fan_out_delta": d_out})


def dependency_growth(relationships: DataFrame, delta: int = 2) -> DataFrame:
    counts = (relationships.where(F.col("relationship").isin("DEPENDS_ON", "CALLS"))
              .groupBy(*PAIR, "source_id")
              .agg(F.count_if("in_baseline").alias("old_count"), F.count_if("in_target").alias("new_count")))
    change = F.col("new_count") - F.col("old_count")
    grown = counts.where((change >= delta) & (F.col("old_count") > 0))
    return _regression(
        grown, "dependency_growth", _text("dependency_growth:", F.col("source_id")), F.lit("medium"),
        F.col("source_id"),
        _text("Entity '", F.col("source_id"), "' increased its architectural coupling from ", F.col("old_count"),
              " to ", F.col("new_count"), " dependencies (+", change, ")."),
        {"old_count": F.col("old_count"), "new_count": F.col("new_count"), "delta": change})


def newly_orphaned(baseline: DataFrame, target: DataFrame) -> DataFrame:
    fresh = target.join(baseline.select(*PAIR, "qualified_name").distinct(), ["qualified_name", *PAIR], "left_anti")
    name = F.col("qualified_name")
    return _regression(
        fresh, "newly_orphaned_candidate", _text("newly_orphaned:", name), F.lit("low"), name,
        _text("Component '", name, "' is newly orphaned with zero inbound architectural references."),
        {"exclusions_checked": F.array_join("exclusions_checked", ",")})


def resolution_regressions(relationships: DataFrame) -> DataFrame:
    worse = relationships.where(F.col("resolution_changed") & (F.col("old_resolution") == "exact")
                                & F.col("new_resolution").isin("inferred", "unresolved"))
    old, new = F.col("old_resolution"), F.col("new_resolution")
    return _regression(
        worse, "resolution_regression", _text("resolution_regression:", F.col("canonical_id")), F.lit("medium"),
        F.col("source_id"),
        _text("Resolution confidence of relationship '", F.col("canonical_id"), "' degraded from '", old, "' to '",
              new, "'."),
        {"old_resolution": old, "new_resolution": new, "target_id": F.col("target_id")})


def regressions(relationships: DataFrame, baseline_arch: dict[str, DataFrame], target_arch: dict[str, DataFrame],
                depending: DataFrame | None = None) -> DataFrame:
    """All six regression kinds; the architecture frames are keyed by the comparison already.

    ``depending`` may hold the calls and dependencies of ``relationships``, where these can be had without the rest.
    """
    parts = [
        new_cycles(baseline_arch["cycles"], target_arch["cycles"]),
        new_violations(baseline_arch["violations"], target_arch["violations"]),
        hotspot_growth(baseline_arch["hotspots"], target_arch["hotspots"]),
        dependency_growth(relationships if depending is None else depending),
        newly_orphaned(baseline_arch["orphans"], target_arch["orphans"]),
        resolution_regressions(relationships),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def change_impact(entities: DataFrame, relationships: DataFrame, max_depth: int = 5) -> DataFrame:
    """Blast radius of every changed entity on the target edges, both directions, few hops.

    What lies within reach is counted by compressed sets for all nodes at once; no table of (start, node) pairs arises.
    """
    keyed = {c: PAIR[i] for i, c in enumerate(PAIR)}
    snap = F.concat_ws("\u0001", keyed["baseline_snapshot_id"], keyed["target_snapshot_id"]).alias(vocab.SNAP)
    # Both inputs are read several times below; the diffs behind them are not repeated.
    live = cut_lineage(relationships.where("in_target").select(vocab.REPO, snap, "source_id", "target_id").distinct())
    changed = cut_lineage(entities.where(F.col("change_type") != "unchanged").select(*PAIR, "qualified_name", "change_type"))
    nodes, links = reach.numbered(live)
    around = (nodes.join(reach.counts_within(links, max_depth), "node")
              .select(*vocab.KEYS, F.col("id").alias("start"), F.col("n").alias("transitive_impacted")))
    into = live.groupBy(*vocab.KEYS, F.col("target_id").alias("start")).agg(F.count(F.lit(1)).alias("direct_dependents"))
    out = live.groupBy(*vocab.KEYS, F.col("source_id").alias("start")).agg(
        F.count(F.lit(1)).alias("direct_dependencies"))
    keys = ["start", *vocab.KEYS]
    joined = (changed.select(*PAIR, snap, F.col("qualified_name").alias("start"), "change_type")
              .join(into, keys, "left").join(out, keys, "left").join(around, keys, "left")
              .na.fill(0, ["direct_dependents", "direct_dependencies", "transitive_impacted"]))
    return joined.select(
        *PAIR, F.col("start").alias("changed_entity"), "change_type", "direct_dependents", "direct_dependencies",
        "transitive_impacted", F.least(F.lit(max_depth), F.col("transitive_impacted")).alias("impact_depth"),
        (F.col("direct_dependents") + F.col("direct_dependencies") + F.col("transitive_impacted"))
        .alias("blast_radius_score"))


def change_risk(entities: DataFrame, relationships: DataFrame, regression_facts: DataFrame) -> DataFrame:
    """One row per comparison: score 0..100, level, and the reasons behind it.

    Counts come from map-side combined aggregates. The names of removed, heavily used components
    are kept as their own rows (``removed_dependents``); the reason here states how many.
    """
    def kind(name: str, out: str) -> Column:
        return F.count_if(F.col("regression_type") == name).alias(out)

    counted = regression_facts.groupBy(*PAIR).agg(
        kind("new_cycle", "cycles"), kind("new_architecture_violation", "violations"),
        kind("hotspot_growth", "hotspots"), kind("dependency_growth", "growths"),
        kind("resolution_regression", "degraded"))
    removed = removed_dependents(entities, relationships).groupBy(*PAIR).agg(F.count(F.lit(1)).alias("removed"))
    # One reading of the entities gives their comparisons as well.
    layers = cut_lineage(entities.groupBy(*PAIR).agg(F.count_if(
        (F.col("change_type") == "modified") & ~F.col("old_architecture_layer").eqNullSafe(F.col("new_architecture_layer"))).alias("layers")))
    all_pairs = layers.select(*PAIR).unionByName(relationships.select(*PAIR).distinct()).distinct()
    names = ["cycles", "violations", "removed", "hotspots", "growths", "degraded", "layers"]
    row = (all_pairs.join(counted, PAIR, "left").join(removed, PAIR, "left").join(layers, PAIR, "left")
           .na.fill(0, names))

    def rule(column: str, before: str, after: str) -> Column:
        return F.when(F.col(column) > 0, _text(before, F.col(column), after))

    high = F.filter(F.array(
        rule("cycles", "Introduced ", " new circular dependency cycle(s)"),
        rule("violations", "Introduced ", " new architectural violation(s)"),
        rule("removed", "Removed ", " heavily depended-on component(s)")), lambda x: x.isNotNull())
    medium = F.filter(F.array(
        rule("hotspots", "Materially increased coupling on ", " dependency hotspot(s)"),
        rule("growths", "Significant dependency coupling growth in ", " component(s)"),
        rule("degraded", "Resolution confidence degraded on ", " architectural relationship(s)"),
        rule("layers", "Architectural layer changed for ", " component(s)")), lambda x: x.isNotNull())
    # Points per rule. Removed components count each.
    score = (
        F.when(F.col("cycles") > 0, 40).otherwise(0) + F.when(F.col("violations") > 0, 35).otherwise(0)
        + F.col("removed") * 30
        + F.when(F.col("hotspots") > 0, 20).otherwise(0) + F.when(F.col("growths") > 0, 15).otherwise(0)
        + F.when(F.col("degraded") > 0, 15).otherwise(0) + F.when(F.col("layers") > 0, 10).otherwise(0))
    level = (F.when((F.size(high) > 0) | (score >= 30), "high")
             .when((F.size(medium) > 0) | (score >= 10), "medium").otherwise("low"))
    calm = F.array(F.lit("Low-risk isolated architectural modification with zero detected regressions."))
    reasons = F.when(F.size(high) + F.size(medium) > 0, F.concat(high, medium)).otherwise(calm)
    return row.select(*PAIR, level.alias("risk_level"), F.least(F.lit(100), score).cast("int").alias("score"),
                      reasons.alias("reasons"), high.alias("high_risk_factors"), medium.alias("medium_risk_factors"),
                      *names)


def removed_dependents(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Removed entities with at least two dependents in the baseline."""
    gone = entities.where(F.col("change_type") == "removed").select(*PAIR, F.col("qualified_name").alias("target_id"))
    return (relationships.where("in_baseline").join(gone, ["target_id", *PAIR], "left_semi")
            .groupBy(*PAIR, "target_id").agg(F.count(F.lit(1)).alias("baseline_dependents"))
            .where(F.col("baseline_dependents") >= 2))


# ------------------------------------------------------------- comparison of stored metrics

def metric_diff(baseline: DataFrame, target: DataFrame) -> DataFrame:
    """Lifecycle of every (entity, metric) with delta and relative change.

    Entity state needs all metrics of the entity, so it is a small aggregate joined back.
    """
    keys = ["entity_type", "entity_name", "metric_name"]
    both = paired(baseline, target, keys, ["metric_value"])
    old, new = F.col("old_metric_value"), F.col("new_metric_value")
    state = both.groupBy(*PAIR, "entity_type", "entity_name").agg(
        F.bool_or("in_baseline").alias("b"), F.bool_or("in_target").alias("t"),
        F.bool_and(old.eqNullSafe(new)).alias("same")).select(
        *PAIR, "entity_type", "entity_name",
        F.when(~F.col("t"), "REMOVED").when(~F.col("b"), "ADDED").when(F.col("same"), "UNCHANGED")
        .otherwise("MODIFIED").alias("state"))
    delta = new - old
    return both.join(state, ["entity_type", "entity_name", *PAIR]).select(
        *PAIR, *keys, "state", old.alias("previous_value"), new.alias("current_value"), delta.alias("delta"),
        F.when(old != 0, delta / F.abs(old)).alias("percentage_change"))


def edge_lifecycle(baseline: DataFrame, target: DataFrame) -> DataFrame:
    """ADDED, REMOVED or MODIFIED (confidence) edges; unchanged ones are not reported."""
    def compared(df: DataFrame) -> DataFrame:
        return df.where(F.col("relationship").isin(vocab.COMPARED_RELATIONSHIPS))

    both = paired(compared(baseline), compared(target), ["source_id", "relationship", "target_id"], ["resolution"])
    state = (F.when(~F.col("in_target"), "REMOVED").when(~F.col("in_baseline"), "ADDED")
             .when(~F.col("old_resolution").eqNullSafe(F.col("new_resolution")), "MODIFIED"))
    return both.withColumn("state", state).where(F.col("state").isNotNull()).select(
        *PAIR, "source_id", "relationship", "target_id", "state",
        F.col("old_resolution").alias("previous_resolution"), F.col("new_resolution").alias("current_resolution"))


def drift_high(metric_changes: DataFrame, edge_changes: DataFrame) -> DataFrame:
    """Entities whose risk rose by more than a tenth and that gained dependencies.

    The gained targets are counted, and the first is named, so a module that gained a
    very large number of them never becomes one huge string.
    """
    risen = metric_changes.where(
        (F.col("metric_name") == "risk_score") & F.col("state").isin("MODIFIED", "UNCHANGED")
        & (F.col("percentage_change") > 0.10))
    gained = edge_changes.where((F.col("state") == "ADDED") & F.col("relationship").isin("IMPORTS", "DEPENDS_ON"))
    targets = gained.groupBy(*PAIR, F.col("source_id").alias("entity_name")).agg(
        F.count(F.lit(1)).alias("gained_dependencies"), F.min("target_id").alias("first_target"))
    return risen.join(targets, ["entity_name", *PAIR]).select(
        *PAIR, F.lit("HIGH").alias("severity"), "entity_name", "entity_type", "gained_dependencies", "first_target",
        F.concat(F.lit("Gained new dependencies and risk increased significantly (+"),
                 F.format_string("%.1f", F.col("percentage_change") * 100), F.lit("%).")).alias("reason"))


def drift_moderate(baseline_cycles: DataFrame, target_cycles: DataFrame) -> DataFrame:
    """Entities on a dependency cycle in the target only. Inputs carry ``start`` per comparison."""
    fresh = (target_cycles.select(*PAIR, "start").distinct()
             .join(baseline_cycles.select(*PAIR, "start").distinct(), ["start", *PAIR], "left_anti"))
    return fresh.select(*PAIR, F.lit("MODERATE").alias("severity"), F.col("start").alias("entity_name"),
                        F.lit("A new circular dependency was introduced involving this module.").alias("reason"))
