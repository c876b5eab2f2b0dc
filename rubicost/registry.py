"""Registry of named queries: a Spark callable and, where SQL can say the same, a DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers ``fn(tables, **options) -> DataFrame`` under its name; ``sql`` is its equivalent without options."""

    def register(fn):
        from rubicost.tables import Tables

        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered already")
        QUERIES[key] = lambda spark, sf_dir, **options: fn(Tables(spark, sf_dir), **options)
        if sql:
            ORACLES[key] = sql
        return fn

    return register
