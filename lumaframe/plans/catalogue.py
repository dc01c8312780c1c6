"""The relational queries that the driver checks against DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumaframe.plans import planes, rules, tables


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**planes.QUERIES, **tables.QUERIES, **rules.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**planes.SQL, **tables.SQL, **rules.SQL}
