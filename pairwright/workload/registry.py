"""Named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairwright.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` gives the same rows on the same tables."""

    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def shipped(spark: SparkSession, folder: str) -> DataFrame:
            return run(ship_package(spark), folder)

        QUERIES[name] = shipped
        if sql is not None:
            SQL[name] = sql
        return run

    return register
