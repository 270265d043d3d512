"""Registered queries, and the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name; sql runs in DuckDB over the same tables."""

    def keep(made: Query) -> Query:
        QUERIES[made.__name__] = made
        if sql:
            SQL[made.__name__] = sql
        return made

    return keep
