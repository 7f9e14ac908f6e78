"""Registry of named queries and their DuckDB oracle statements.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the driver tables. The oracle, when
given, is an SQL text DuckDB runs over the same tables; column names and types match the
Spark result (doubles rounded to 6 places on both sides, counts as BIGINT)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def r6(c: Column | str) -> Column:
    """Round a double to 6 places (values are hashed by the checker)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)
