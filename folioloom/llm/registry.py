"""The queries of this package, and the SQL they are checked against."""

from __future__ import annotations

from importlib import import_module

MODULES = ("names", "bitext", "pieces", "lookalike", "sentences", "packing", "mixture", "languages")


def queries() -> dict:
    return {name: f for m in MODULES for name, f in import_module(f"folioloom.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in import_module(f"folioloom.llm.{m}").ORACLE.items()}
