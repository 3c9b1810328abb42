"""The queries of the core, and the SQL they are checked against."""

from __future__ import annotations

from importlib import import_module

MODULES = ("facet_queries", "text_queries", "join_queries")


def queries() -> dict:
    return {name: f for m in MODULES for name, f in import_module(f"folioloom.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in import_module(f"folioloom.plans.{m}").ORACLE.items()}
