"""Time zone free arithmetic on ``timestamp_ntz`` columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MINUTE = 60
HOUR = 3_600
DAY = 86_400
WEEK = 7 * DAY


def ntz(value) -> Column:
    """A literal or column as ``timestamp_ntz``."""
    col = value if isinstance(value, Column) else F.lit(str(value))
    return col.cast("timestamp_ntz")


def day(ts) -> Column:
    """Midnight of the day of ``ts``."""
    return F.to_date(ts).cast("timestamp_ntz")


def week(ts) -> Column:
    """Monday of the week of ``ts``."""
    return F.trunc(F.to_date(ts), "week").cast("timestamp_ntz")


def month(ts) -> Column:
    """First day of the month of ``ts``."""
    return F.trunc(F.to_date(ts), "month").cast("timestamp_ntz")


def epoch_day(ts) -> Column:
    return F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")


def epoch_second(ts) -> Column:
    """Whole seconds since 1970 without touching the session time zone."""
    return (
        epoch_day(ts) * F.lit(DAY).cast("bigint")
        + F.hour(ts) * HOUR + F.minute(ts) * 60 + F.second(ts)
    ).cast("bigint")


def from_epoch(seconds) -> Column:
    """Inverse of :func:`epoch_second`."""
    return F.timestamp_add("SECOND", seconds, ntz("1970-01-01 00:00:00"))


def floor_to(ts, step: int) -> Column:
    """``ts`` floored to a multiple of ``step`` seconds since 1970."""
    sec = epoch_second(ts)
    return from_epoch(sec - sec % F.lit(step).cast("bigint"))


def bar_number(ts, step: int) -> Column:
    """Number of the bar that holds ``ts`` on a calendar of ``step`` seconds."""
    return F.floor(epoch_second(ts) / F.lit(step)).cast("bigint")


def with_pos(df: DataFrame, step: int, ts: str = "ts") -> DataFrame:
    """Add the bar number ``pos`` that all per-series frames are ordered by."""
    return df.withColumn("pos", bar_number(F.col(ts), step))
