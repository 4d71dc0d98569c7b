"""Registered queries: each runs library operators over the given tables.

Importing this package fills the registry; ``all_queries`` and ``all_sql`` feed
the entry module, the oracle tests and the benchmark.
"""

from __future__ import annotations

import importlib

from riskspark.queries.registry import QUERIES, SQL

for _name in ("tables", "columns", "profiles", "screening", "modelling", "clusters", "risk"):
    try:
        importlib.import_module(f"riskspark.queries.{_name}")
    except ModuleNotFoundError as err:
        if err.name != f"riskspark.queries.{_name}":
            raise


def all_queries() -> dict:
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    return dict(SQL)
