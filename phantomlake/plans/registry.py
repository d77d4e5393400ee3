"""Where the queries of the library register themselves with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from phantomlake.sources.views import duck

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; sql may name views as {view}."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = duck(sql)
        return f

    return keep
