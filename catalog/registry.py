"""Collects queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``; ``sql`` is its DuckDB twin."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


# Two engines add doubles in different orders, so figures are compared at a fixed
# precision.  The offset keeps exact halves away from the rounding edge.
def fx(c: Column | str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * F.lit(float(10**digits)) + F.lit(0.5001)) / F.lit(float(10**digits))


def fxs(expr: str, digits: int = 6) -> str:
    return f"(floor(CAST({expr} AS DOUBLE) * 1e{digits} + CAST(0.5001 AS DOUBLE)) / 1e{digits})"


def fix(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Compare-precision for the named double columns."""
    return df.withColumns({c: fx(c, digits) for c in columns})
