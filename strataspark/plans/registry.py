"""Registering queries, and collecting those of all modules of the core."""

from __future__ import annotations

import importlib

MODULES = [
    "strataspark.operators.queries",
    "strataspark.operators.lookups",
    "strataspark.operators.graph",
    "strataspark.operators.history",
    "strataspark.operators.rollups",
    "strataspark.operators.layers",
    "strataspark.operators.coverage",
    "strataspark.operators.health",
    "strataspark.functions.mining",
    "strataspark.functions.test_texts",
    "strataspark.operators.assembly",
    "strataspark.operators.mapping",
]


def register(queries: dict, sqls: dict):
    """A decorator that enters a query under its function's name, and its SQL if it has one."""

    def with_sql(sql: str | None = None):
        def enter(f):
            queries[f.__name__] = f
            if sql is not None:
                sqls[f.__name__] = sql
            return f

        return enter

    return with_sql


def collect(names: list[str]) -> tuple[dict, dict]:
    """QUERIES and SQL of the named modules, united; a name may be given once only."""
    queries, sql = {}, {}
    for name in names:
        m = importlib.import_module(name)
        if twice := set(m.QUERIES) & set(queries):
            raise ValueError(f"given twice: {sorted(twice)}")
        queries |= m.QUERIES
        sql |= m.SQL
    return queries, sql
