"""Architecture questions over the facts of one snapshot, by query type."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import vocab
from lodestone.operators import explain as X
from lodestone.operators import graph as GR
from lodestone.operators import search as SE
from lodestone.session import small_frame

KEYS = vocab.KEYS
FINDINGS = {"explain_violation": ("violations", X.explain_violations), "explain_cycle": ("cycles", X.explain_cycles),
            "explain_hotspot": ("hotspots", X.explain_hotspots), "explain_orphan": ("orphans", X.explain_orphans)}
PATH_QUERIES = ("upstream_dependents", "downstream_dependencies", "dependency_path", "http_architecture_path")
QUERY_TYPES = (*PATH_QUERIES, *FINDINGS, "explain_risk", "entity_history", "issue_origin")


@dataclass
class Answer:
    """Frames of one answer; ``resolution`` says how the asked names were understood."""

    query_type: str
    resolution: DataFrame | None = None
    paths: DataFrame | None = None
    evidence: DataFrame | None = None
    explanation: DataFrame | None = None
    history: DataFrame | None = None
    warnings: list[str] = field(default_factory=list)


class Questions:
    """Questions about one snapshot. ``facts`` holds the frames of the analysis, ``comparison`` those
    of a comparison, ``snapshots`` the timeline; each is needed only by the questions that read it."""

    def __init__(self, facts: dict[str, DataFrame], repository_id: str, snapshot_id: str,
                 comparison: dict[str, DataFrame] | None = None, snapshots: DataFrame | None = None):
        self.repository_id, self.snapshot_id = repository_id, snapshot_id
        self.all_facts, self.comparison, self.snapshots = facts, comparison, snapshots
        here = (F.col(vocab.REPO) == repository_id) & (F.col(vocab.SNAP) == snapshot_id)
        self.facts = {name: df.where(here) for name, df in facts.items() if set(KEYS) <= set(df.columns)}

    def _asked(self, text: str) -> DataFrame:
        spark = self.facts["entities"].sparkSession
        return small_frame(spark, [*KEYS, "query"], [(self.repository_id, self.snapshot_id, text)])

    def resolve(self, text: str) -> DataFrame:
        return SE.resolve_entities(self._asked(text), self.facts["entities"])

    def candidates(self, text: str) -> DataFrame:
        return SE.entity_candidates(self._asked(text), self.facts["entities"])

    def execute(self, query_type: str, entity: str = "", target: str = "", max_depth: int | None = None,
                relationships: list[str] | None = None, issue_type: str = "cycle", issue_key: str | None = None) -> Answer:
        if query_type in PATH_QUERIES:
            return self._paths(query_type, entity, target, max_depth, relationships)
        if query_type in FINDINGS:
            name, explain = FINDINGS[query_type]
            explained = explain(self.facts[name])
            return Answer(query_type, explanation=explained.where(F.col("subject") == entity) if entity else explained)
        if query_type == "explain_risk":
            if self.comparison is None:
                return Answer(query_type, warnings=["Evolution analysis result required for explain_risk query."])
            return Answer(query_type, resolution=self.resolve(entity), explanation=X.explain_risk(self.comparison["risk"]),
                          evidence=X.entity_regressions(self.comparison["regressions"], self._name(entity)))
        if query_type == "entity_history":
            if self.comparison is None:
                return Answer(query_type, warnings=["Evolution analysis result required for entity_history query."])
            return Answer(query_type, history=X.entity_history(
                self.comparison["entity_diff"], self.comparison["relationship_diff"], entity))
        if query_type == "issue_origin":
            if self.snapshots is None:
                return Answer(query_type, warnings=["Snapshot history required for issue_origin query."])
            findings = self.all_facts[{"cycle": "cycles", "violation": "violations", "hotspot": "hotspots"}[issue_type]]
            issues = X.matching_issues(findings, issue_type, issue_key or entity)
            return Answer(query_type, history=X.issue_presence(self.snapshots, issues),
                          explanation=X.issue_origins(self.snapshots, issues))
        return Answer(query_type, warnings=[f"Unsupported query type '{query_type}'."])

    def _name(self, text: str) -> str:
        """The resolved qualified name (one row), or the text itself."""
        row = self.resolve(text).first()
        return row["qualified_name"] if row and row["qualified_name"] else text

    def _paths(self, query_type: str, entity: str, target: str, max_depth: int | None, relationships: list[str] | None) -> Answer:
        """Names are resolved with a join, so an unknown or ambiguous name simply starts no path."""
        found = self.resolve(entity)
        starts = found.where(F.col("status") == "resolved").select(*KEYS, F.col("qualified_name").alias("start"))
        edges = self.facts["relationships"]
        if query_type == "upstream_dependents":
            paths = GR.traverse(starts, edges, "upstream", relationships, max_depth)
        elif query_type == "downstream_dependencies":
            paths = GR.traverse(starts, edges, "downstream", relationships, max_depth)
        elif query_type == "http_architecture_path":
            paths = GR.http_chains(starts, edges, max_depth)
        else:
            goal = self.resolve(target)
            goals = goal.where(F.col("status") == "resolved").select(*KEYS, F.col("qualified_name").alias("goal"))
            paths = GR.find_paths(starts.join(goals, KEYS), edges, relationships, max_depth)
            found = found.unionByName(goal)
        warnings = ["Source and target entities are identical."] if query_type == "dependency_path" and entity == target else []
        return Answer(query_type, resolution=found, paths=paths, evidence=path_evidence(paths, self.facts["entities"]),
                      explanation=X.explain_paths(starts, paths, query_type), warnings=warnings)


def path_evidence(paths: DataFrame, entities: DataFrame) -> DataFrame:
    """Every edge on any path, once, with the roles and layers of its ends."""
    steps = paths.select(*KEYS, F.explode("steps").alias("s")).select(
        *KEYS, F.col("s.source").alias("source_id"), F.col("s.relationship").alias("relationship"),
        F.col("s.target").alias("target_id"), F.col("s.resolution").alias("resolution")).distinct()
    for end in ("source", "target"):
        roles = entities.select(*KEYS, F.col("qualified_name").alias(f"{end}_id"),
                                F.col("architecture_role").alias(f"{end}_role"), F.col("architecture_layer").alias(f"{end}_layer"))
        steps = steps.join(roles, [f"{end}_id", *KEYS], "left")
    return steps.withColumn("confidence", F.when(F.col("resolution") == "exact", "exact").otherwise("inferred"))
