"""All queries of the core, gathered from the plan modules."""

from __future__ import annotations

from tracequarry.plans.registry import Query

MODULES = ("grouping", "nested", "tokenwise", "textual", "searching", "rollups", "stepwise", "batching", "imperative", "further", "files")


def _modules():
    import importlib

    return [importlib.import_module(f"tracequarry.plans.{name}") for name in MODULES]


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for m in _modules():
        if clash := out.keys() & m.R.run.keys():
            raise ValueError(f"registered twice: {sorted(clash)}")
        out |= m.R.run
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _modules():
        out |= m.R.sql
    return out
