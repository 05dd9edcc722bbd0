"""The table of named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}


def register(oracle: str | None = None):
    """Put a query under its name, with the DuckDB SQL that gives the same rows."""

    def add(query: Query) -> Query:
        QUERIES[query.__name__] = (query, oracle)
        return query

    return add
