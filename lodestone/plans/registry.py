"""Registered queries: name, function and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is there already")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = " ".join(sql.split()) if "\\n" not in sql else sql
        return f

    return add


def load() -> None:
    """Imports the modules that register queries."""
    from . import catalog, machines, scalars, streams  # noqa: F401
