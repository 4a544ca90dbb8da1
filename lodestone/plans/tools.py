"""Named tools over the fact tables of one repository: a catalog of parameterised queries."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import vocab
from lodestone.operators import git_metrics as G
from lodestone.operators import graph as GR
from lodestone.operators import metrics as M
from lodestone.operators import search as SE
from lodestone.operators.evolution import PAIR
from lodestone.plans import comparison as CP
from lodestone.plans import dossier as D
from lodestone.session import small_frame
from lodestone.sources.repository import read_file

KEYS = vocab.KEYS
REGISTRY: dict[str, tuple[str, Callable]] = {}


def tool(description: str):
    def register(fn: Callable) -> Callable:
        REGISTRY[fn.__name__] = (description, fn)
        return fn
    return register


class Workspace:
    """Fact tables of one repository and the snapshot the tools look at."""

    def __init__(self, facts: dict[str, DataFrame], repository_id: str, snapshot_id: str, snapshots: DataFrame | None = None,
                 sources: DataFrame | None = None, vector: Callable[[str], list[float]] | None = None):
        self.repository_id, self.snapshot_id = repository_id, snapshot_id
        own = F.col(vocab.REPO) == repository_id
        self.history = {n: df.where(own) for n, df in facts.items() if vocab.REPO in df.columns}
        self.facts = {n: df.where(F.col(vocab.SNAP) == snapshot_id) for n, df in self.history.items() if vocab.SNAP in df.columns}
        self.snapshots = snapshots.where(own) if snapshots is not None else None
        self.sources, self.vector = sources, vector
        self.spark = next(iter(facts.values())).sparkSession

    def start(self, entity: str) -> DataFrame:
        return small_frame(self.spark, [*KEYS, "start"], [(self.repository_id, self.snapshot_id, entity)])

    def pair(self, previous: str, current: str) -> DataFrame:
        return small_frame(self.spark, PAIR, [(self.repository_id, previous, current)])


def describe() -> dict[str, dict]:
    """Name -> description and arguments (required or with their default)."""
    out = {}
    for name, (text, fn) in REGISTRY.items():
        args = list(inspect.signature(fn).parameters.values())[1:]
        out[name] = {"description": text, "arguments": {
            a.name: "required" if a.default is inspect.Parameter.empty else a.default for a in args}}
    return out


def run(name: str, workspace: Workspace, **arguments) -> DataFrame:
    if name not in REGISTRY:
        raise KeyError(f"unknown tool: {name}")
    fn = REGISTRY[name][1]
    inspect.signature(fn).bind(workspace, **arguments)  # raises TypeError on wrong arguments
    return fn(workspace, **arguments)


@tool("Code entities related to a question, by vector or text.")
def search_code(ws: Workspace, query: str, limit: int = 5) -> DataFrame:
    vector = ws.vector(query) if ws.vector else None
    return SE.semantic_search(ws.facts.get("embeddings", ws.facts["units"]), ws.facts["units"], ws.facts["nodes"], query, vector, limit)


@tool("A file by its repository-relative path.")
def get_file(ws: Workspace, relative_path: str) -> DataFrame:
    return read_file(ws.sources, relative_path)


@tool("A function with its source.")
def get_function(ws: Workspace, entity_id: str) -> DataFrame:
    return D.entity_code(ws.facts["functions"], ws.sources, entity_id)


@tool("A class with its source.")
def get_class(ws: Workspace, entity_id: str) -> DataFrame:
    return D.entity_code(ws.facts["types"], ws.sources, entity_id)


@tool("Edges around an entity, restricted to allowed relation types.")
def get_graph_context(ws: Workspace, entity_id: str, relationship_types: list[str] | None = None) -> DataFrame:
    return GR.neighbourhood(ws.start(entity_id), ws.facts["edges"], GR.relation_whitelist(relationship_types))


@tool("Direct callers of an entity.")
def get_callers(ws: Workspace, entity_id: str) -> DataFrame:
    return GR.impact(ws.start(entity_id), ws.facts["edges"], "upstream", 1)


@tool("Direct callees of an entity.")
def get_callees(ws: Workspace, entity_id: str) -> DataFrame:
    return GR.impact(ws.start(entity_id), ws.facts["edges"], "downstream", 1)


@tool("Blast radius of an entity.")
def get_impact(ws: Workspace, entity_id: str, direction: str = "both", depth: int | None = None) -> DataFrame:
    return GR.impact(ws.start(entity_id), ws.facts["edges"], direction, depth)


@tool("Metrics of an entity with their sources.")
def get_metrics(ws: Workspace, entity_id: str) -> DataFrame:
    return M.metric_map(ws.facts["metrics"].where(F.col("entity_name") == entity_id))


@tool("Churn and recent commits of a file.")
def get_git_context(ws: Workspace, file_path: str) -> DataFrame:
    return D.git_context(ws.facts["file_churn"], ws.facts["file_changes"], ws.facts["commits"], file_path, None)["recent_commits"]


@tool("Files with the highest risk.")
def get_hotspots(ws: Workspace, limit: int = 20) -> DataFrame:
    return G.risk_hotspots(ws.facts["file_risk"], limit, 0.60)


@tool("Lifecycle of entities between two snapshots.")
def compare_snapshots(ws: Workspace, previous_snapshot_id: str, current_snapshot_id: str) -> DataFrame:
    return CP.stored_comparison(ws.history["metrics"], ws.history["edges"], ws.pair(previous_snapshot_id, current_snapshot_id))["metrics"]


@tool("Aggregated metrics per snapshot in time order.")
def get_evolution_timeline(ws: Workspace) -> DataFrame:
    return M.snapshot_timeline(ws.snapshots, ws.history["metrics"])


@tool("Architecture drift between two snapshots.")
def get_drift_findings(ws: Workspace, previous_snapshot_id: str, current_snapshot_id: str) -> DataFrame:
    found = CP.stored_comparison(ws.history["metrics"], ws.history["edges"], ws.pair(previous_snapshot_id, current_snapshot_id))
    columns = ["severity", "entity_name", "reason"]
    return found["drift_high"].select(*columns).unionByName(found["drift_moderate"].select(*columns))


@tool("Metrics of one entity over time.")
def get_metric_trend(ws: Workspace, entity_name: str) -> DataFrame:
    maps = M.metric_map(ws.history["metrics"].where(F.col("entity_name") == entity_name))
    return ws.snapshots.join(maps, KEYS).orderBy("analyzed_at", vocab.SNAP)
