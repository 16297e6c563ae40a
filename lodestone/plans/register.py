"""Where queries and their DuckDB SQL are registered."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        if name in QUERIES:
            raise ValueError(f"a query {name} is there already")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add
