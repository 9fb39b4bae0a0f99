"""How a plan module collects its queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def registry() -> tuple[dict[str, Query], dict[str, str], Callable[[str | None], Callable[[Query], Query]]]:
    """Two empty dicts and the decorator that adds a function to them under its name, with its twin if it has one."""
    queries: dict[str, Query] = {}
    twins: dict[str, str] = {}

    def query(sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            queries[f.__name__] = f
            if sql:
                twins[f.__name__] = sql
            return f

        return add

    return queries, twins, query
