"""Every registered query over the star-schema tables and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


from graphloom.plans import code_queries, graph_queries, text_queries  # noqa: E402, F401, I001
from graphloom.plans import more_queries  # noqa: E402, F401
from graphloom.plans import partition_queries  # noqa: E402, F401
