"""Deterministic first and last rows per key, combined map-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: Sequence[str], order: Column | str, agg) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    by = F.col(order) if isinstance(order, str) else order
    if not rest:
        return df.distinct()
    picked = df.groupBy(*keys).agg(agg(F.struct(*rest), by).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def keep_last(df: DataFrame, keys: Sequence[str], order: Column | str) -> DataFrame:
    """The row with the largest ``order`` of each key; ``order`` has to be unique within a key.

    An aggregation, not a window: a hot key is reduced before it is shuffled.
    """
    return _pick(df, keys, order, F.max_by)


def keep_first(df: DataFrame, keys: Sequence[str], order: Column | str) -> DataFrame:
    """The row with the smallest ``order`` of each key."""
    return _pick(df, keys, order, F.min_by)
