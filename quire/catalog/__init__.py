"""One query for each operator over the test tables, with its SQL for a second engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(made: Query) -> Query:
        QUERIES[made.__name__] = made
        if sql is not None:
            ORACLE_SQL[made.__name__] = sql
        return made

    return add


def load() -> None:
    from quire.catalog import pages, rasters, reports, texts  # noqa: F401
