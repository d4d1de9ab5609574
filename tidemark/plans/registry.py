"""Registration of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.views import Source, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers f(source) under its name, with SQL over the views for the same rows."""

    def put(f: Callable[[Source], DataFrame]) -> Callable[[Source], DataFrame]:
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Source(spark, sf_dir))
        if sql:
            ORACLE_SQL[key] = with_views(sql)
        return f

    return put
