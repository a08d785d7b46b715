"""Every registered query with its SQL twin, gathered from the plan modules."""

from __future__ import annotations

from importlib import import_module

MODULES: tuple[str, ...] = ("retrieval", "texts", "chunking", "graph", "statistics", "evaluation", "audit", "citing", "gates", "building")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"tessera.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"tessera.plans.{m}").ORACLE_SQL.items()}
