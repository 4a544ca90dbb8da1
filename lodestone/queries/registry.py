"""All registered queries: name -> (Spark query, SQL statement or None)."""

from __future__ import annotations

from functools import wraps

from lodestone.queries import code, findings, history, lookup, structure, traversal
from lodestone.session import apply_runtime_conf


def _configured(run):
    @wraps(run)
    def query(spark, sf_dir):
        return run(apply_runtime_conf(spark), sf_dir)
    return query


ALL: dict = {}
for _module in (history, structure, traversal, findings, lookup, code):
    ALL.update({name: (_configured(run), statement) for name, (run, statement) in _module.QUERIES.items()})
