"""Registered queries: operators over the given tables, each beside its SQL."""

from __future__ import annotations

from importlib import import_module

#: Modules of this package with QUERIES and SQL, by name.
MODULES = ["text_graph", "texts", "graphs", "metrics", "assertions"]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"skein.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"skein.plans.{m}").SQL.items()}
