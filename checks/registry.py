"""Registry of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.tables import Tables, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, **more_ctes: str):
    """Register a function of ``Tables`` under its own name, with the SQL for the same rows."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[build.__name__] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            SQL[build.__name__] = oracle(sql, more_ctes)
        return build

    return register
