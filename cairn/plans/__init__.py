"""Registry of the core queries."""

from __future__ import annotations

import importlib

CORE = ["cairn.plans.pipeline", "cairn.plans.recall", "cairn.plans.curation", "cairn.plans.graph", "cairn.plans.maintenance"]


def registry(more: tuple[str, ...] = ()) -> tuple[dict, dict]:
    """All queries of CORE and of further modules, and the SQL of those that have one."""
    found: dict = {}
    sql: dict = {}
    for name in [*CORE, *more]:
        module = importlib.import_module(name)
        found.update(module.queries())
        sql.update(module.oracle_sql())
    return found, sql
