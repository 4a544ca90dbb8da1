"""Investigation of one entity: overview, code, graph, health, commits and impact as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import vocab
from lodestone.operators import graph as GR
from lodestone.operators import metrics as M

KEYS = vocab.KEYS
OVERVIEW_RELATIONSHIPS = ["CALLS", "IMPORTS", "DEFINES"]


def locate(nodes: DataFrame, edges: DataFrame, entity: str) -> DataFrame:
    """The node meant by an id, qualified name, name or path, with the file that contains it."""
    hit = ((F.col("id") == entity) | (F.col("qualified_name") == entity) | (F.col("name") == entity) | (F.col("path") == entity))
    order = F.when(F.col("id") == entity, 0).when(F.col("qualified_name") == entity, 1).when(F.col("name") == entity, 2).otherwise(3)
    node = nodes.where(hit).orderBy(order, "label", "id").limit(1)
    inside = GR.containment_pairs(edges.where(F.col("relationship") == "CONTAINS")).join(
        nodes.where(F.col("label") == "File").select(*KEYS, F.col("id").alias("ancestor"), F.col("path").alias("file_path")), ["ancestor", *KEYS])
    places = inside.groupBy(*KEYS, F.col("member").alias("id")).agg(F.min("file_path").alias("file_path"))
    return node.join(places, ["id", *KEYS], "left").withColumn("file_path", F.coalesce("path", "file_path"))


def overview(node: DataFrame, edges: DataFrame, metrics: DataFrame) -> DataFrame:
    """Complexity, coupling, risk, callers and callees; counts from the graph where no metric is stored."""
    maps = M.metric_map(metrics).groupBy(*KEYS, F.col("entity_name").alias("id")).agg(F.first("metrics").alias("m"))
    kept = edges.where(F.col("relationship").isin(OVERVIEW_RELATIONSHIPS)).select(*KEYS, "source_id", "target_id").distinct()
    into = kept.groupBy(*KEYS, F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("graph_in"))
    out = kept.groupBy(*KEYS, F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("graph_out"))
    joined = node.join(maps, ["id", *KEYS], "left").join(into, ["id", *KEYS], "left").join(out, ["id", *KEYS], "left")

    def stored(*names: str):
        return F.coalesce(*[F.try_element_at("m", F.lit(n)) for n in names])

    return joined.select(
        *KEYS, "id", "label", "file_path",
        F.coalesce(stored("cyclomatic_complexity"), F.col("cyclomatic_complexity").cast("double"), F.lit(1.0)).alias("complexity"),
        F.coalesce(stored("outgoing_coupling", "coupling"), F.col("graph_out").cast("double"), F.lit(0.0)).alias("coupling"),
        F.round(F.coalesce(stored("risk_score"), F.lit(0.25)), 2).alias("risk"),
        F.coalesce(stored("incoming_coupling", "fan_in").cast("bigint"), F.col("graph_in"), F.lit(0).cast("bigint")).alias("callers"),
        F.coalesce(stored("outgoing_coupling", "fan_out").cast("bigint"), F.col("graph_out"), F.lit(0).cast("bigint")).alias("callees"))


def entity_code(parsed: DataFrame, sources: DataFrame, entity: str) -> DataFrame:
    """Source lines of a parsed function or type."""
    chosen = parsed.where((F.col("qualified_name") == entity) | (F.col("name") == entity)).select(
        *KEYS, "path", "qualified_name", "start_line", "end_line")
    text = F.array_join(F.slice(F.split("content", "\n"), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    return chosen.join(sources.select(*KEYS, "path", "content"), ["path", *KEYS]).select(
        *KEYS, "path", "qualified_name", "start_line", "end_line", text.alias("source_code"))


def _path_options(file_path: str | None, qualified_name: str | None) -> list[str]:
    clean = (file_path or "").replace("\\", "/").strip("/")
    options = [clean, f"{clean}.py" if clean and not clean.endswith(".py") else ""]
    if qualified_name:
        slashed = qualified_name.replace(".", "/")
        options += [f"{slashed}.py", slashed]
    return list(dict.fromkeys(o for o in options if o))


def git_context(churn: DataFrame, file_changes: DataFrame, commits: DataFrame, file_path: str | None,
                qualified_name: str | None, limit: int = 5) -> dict[str, DataFrame]:
    """Churn and recent commits of the file; the first path spelling with commits counts.

    Without any, the newest commits of the repository stand in. All choices are ranks inside one
    ordered, limited query, so nothing is collected to decide.
    """
    options = _path_options(file_path, qualified_name)
    rank = F.lit(len(options))
    for i in reversed(range(len(options))):
        rank = F.when(F.col("file_path") == options[i], i).otherwise(rank)
    name = options[0].rsplit("/", 1)[-1].lower() if options else "\u0000"
    near = F.col("file_path").isin(options or [""]) | F.contains(F.lower("file_path"), F.lit(name))
    chosen = churn.where(near).orderBy(rank, "file_path").limit(1)

    touched = file_changes.where(F.col("file_path").isin(options or [""])).join(commits, ["commit_sha", *KEYS]).select(
        *KEYS, "commit_sha", "author_name", "message", "committed_at", "insertions", "deletions", "change_type", rank.alias("choice"))
    elsewhere = commits.select(
        *KEYS, "commit_sha", "author_name", "message", "committed_at", F.lit(0).alias("insertions"), F.lit(0).alias("deletions"),
        F.lit("MODIFY").alias("change_type"), F.lit(len(options) + 1).alias("choice"))
    ranked = touched.unionByName(elsewhere).orderBy("choice", F.col("committed_at").desc(), "commit_sha").limit(limit)
    best = ranked.groupBy(*KEYS).agg(F.min("choice").alias("choice"))
    return {"churn": chosen, "recent_commits": ranked.join(best, ["choice", *KEYS], "left_semi").drop("choice")}


def dossier(facts: dict[str, DataFrame], start: DataFrame, entity: str, sources: DataFrame | None = None,
            file_path: str | None = None) -> dict[str, DataFrame]:
    """The sections of an investigation; ``start`` is the entity as a one-row frame."""
    node = locate(facts["nodes"], facts["edges"], entity)
    sections = {
        "context": node, "overview": overview(node, facts["edges"], facts["metrics"]),
        "graph": GR.neighbourhood(start, facts["edges"]), "impact": GR.impact(start, facts["edges"], "both"),
        "health": M.metric_map(facts["metrics"].where(F.col("entity_name") == entity))}
    if sources is not None:
        sections["code"] = entity_code(facts["functions"].select(*KEYS, "path", "name", "qualified_name", "start_line", "end_line").unionByName(
            facts["types"].select(*KEYS, "path", "name", "qualified_name", "start_line", "end_line")), sources, entity)
    if "commits" in facts:
        context = git_context(facts["file_churn"], facts["file_changes"], facts["commits"], file_path, entity)
        sections |= {"git_churn": context["churn"], "git_commits": context["recent_commits"]}
    return sections
