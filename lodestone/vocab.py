"""Fixed values shared by every operator: names, ranks, bands and lookup tables."""

from __future__ import annotations

REPO = "repository_id"
SNAP = "snapshot_id"
KEYS = [REPO, SNAP]
# Join keys are listed with the entity first: a sort-merge join compares the first key by a cached
# prefix, and repository and snapshot are the same on most rows.

# --- Fixed values: confidence, strongest first -------------------------------------------
CONFIDENCE = ["exact", "inferred", "unresolved"]
CONFIRMED = ["exact", "inferred"]

# --- Fixed values: edge types ------------------------------------------------------------
TRAVERSAL_RELATIONSHIPS = [
    "CALLS", "IMPORTS", "REQUESTS", "HANDLED_BY", "DEPENDS_ON", "IMPLEMENTS", "ARCHITECTURE_VIOLATION",
]
HTTP_CHAIN_RELATIONSHIPS = ["CALLS", "REQUESTS", "HANDLED_BY", "DEPENDS_ON", "IMPLEMENTS"]
IMPACT_RELATIONSHIPS = ["CALLS", "IMPORTS", "INHERITS", "DEFINES", "REQUESTS", "HANDLED_BY"]
MEMBER_IMPACT_RELATIONSHIPS = ["CALLS", "IMPORTS", "INHERITS", "REQUESTS", "HANDLED_BY"]
CYCLE_RELATIONSHIPS = ["CALLS", "DEPENDS_ON", "IMPORTS"]
HOTSPOT_RELATIONSHIPS = ["CALLS", "DEPENDS_ON", "REQUESTS", "IMPORTS"]
INBOUND_RELATIONSHIPS = ["CALLS", "REQUESTS", "HANDLED_BY", "DEPENDS_ON"]
LAYER_RULE_RELATIONSHIPS = ["CALLS", "DEPENDS_ON"]
COMPARED_RELATIONSHIPS = ["CALLS", "IMPORTS", "DEPENDS_ON"]
GRAPH_CONTEXT_RELATIONSHIPS = ["CALLS", "IMPORTS", "INHERITS", "CONTAINS", "DEFINES"]
OVERVIEW_LABELS = ["Repository", "File", "Module"]

# --- Fixed values: roles, layers and the transitions between layers ----------------------
ROLE_TO_LAYER = {
    "controller": "presentation",
    "endpoint_handler": "presentation",
    "component": "presentation",
    "service": "application",
    "domain": "domain",
    "repository": "infrastructure",
    "gateway": "infrastructure",
    "client": "infrastructure",
    "infrastructure": "infrastructure",
    "utility": "unknown",
    "unknown": "unknown",
}
ALLOWED_TRANSITIONS = [
    ("presentation", "application"),
    ("application", "domain"),
    ("application", "infrastructure"),
    ("infrastructure", "domain"),
    ("presentation", "presentation"),
    ("application", "application"),
    ("domain", "domain"),
    ("infrastructure", "infrastructure"),
]
ENTRYPOINT_WORDS = ["main", "app", "index", "startup", "program", "server", "bootstrap"]
ORPHAN_EXCLUSIONS = [
    "standard_entrypoint_check", "framework_endpoint_check",
    "di_container_binding_check", "graph_inbound_reference_check",
]

# --- Fixed values: risk weights and bands ------------------------------------------------
RISK_WEIGHTS = {"complexity": 0.4, "coupling": 0.3, "churn": 0.3}
RISK_BANDS = [("CRITICAL", 0.80), ("HIGH", 0.60), ("MODERATE", 0.30)]
RISK_LABEL_CODE = {"LOW": 0.0, "MODERATE": 1.0, "HIGH": 2.0, "CRITICAL": 3.0}

# --- Fixed values: HTTP ------------------------------------------------------------------
HTTP_VERBS = ["GET", "POST", "PUT", "DELETE", "PATCH", "OPTIONS", "HEAD"]

# --- Fixed values: source files ----------------------------------------------------------
EXTENSION_LANGUAGE = {
    ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript",
    ".mjs": "javascript", ".cjs": "javascript", ".java": "java", ".cs": "csharp", ".go": "go", ".rs": "rust",
}
IGNORED_DIRECTORIES = [
    ".git", ".venv", "venv", "env", "__pycache__", "node_modules", "dist", "build", "target", "bin", "obj",
    "out", ".idea", ".vscode", ".mypy_cache", ".pytest_cache", "coverage", ".tox", ".turbo", ".next", ".nuxt",
    "vendor", ".gradle", ".m2", ".cargo",
]
