"""Where queries and their SQL are registered by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str, recursive: bool = False) -> Callable[[Query], Query]:
    """Register a query under its function's name; `sql` is its body after the given common table expressions."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (f"with {'recursive ' * recursive}" + ",".join(ctes) + "\n" + sql) if ctes else sql
        return f

    return register
