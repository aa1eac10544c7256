"""Named queries over the provided tables and their DuckDB counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query function under ``name``; without ``sql`` it is checked in tests only."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            # adding zero turns the negative zero of a rounded small number into zero, as Spark has it
            ORACLE[name] = re.sub(r"\bround\(", "0.0 + round(", sql)
        return fn

    return add


def r6(col: Column | str, digits: int = 6) -> Column:
    """Rounding that hides the order of floating point sums in comparisons."""
    return F.round(F.col(col) if isinstance(col, str) else col, digits)


def shown(df: DataFrame, *keys: str, digits: int = 6, **values: Column | str) -> DataFrame:
    """Keys as they are and rounded values."""
    return df.select(*keys, *[r6(v, digits).alias(n) for n, v in values.items()])
