"""Ranks, exact quantiles, totals and capped weights inside a group of any size.

The groups are cross-sections (all symbols at one ``ts``) or pooled samples (all
rows of a rule).  Values are cut into order-preserving buckets that depend on
the value alone, the buckets are counted with map-side aggregation, and only
distinct values of one bucket at a time are sorted, so a group that holds a third
of the rows is still spread over many tasks, whatever its values are.  Group keys must not be null.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# significant bits of a bucket's value, of a part of a bucket, and of a bucket of ranks
BUCKET_BITS, PART_BITS, RANK_BITS = 9, 31, 20


def value_bucket(x: Column, bits: int = BUCKET_BITS) -> Column:
    """``x`` rounded to ``bits`` significant bits; never decreases in ``x``.

    The sum and difference with a multiple of ``x`` drop the low bits by the rounding of the
    processor.  Numbers too large for the multiple are buckets of their own.
    """
    multiple = x * F.lit(float((1 << (53 - bits)) + 1))
    return F.when(F.abs(x) < F.lit(2.0 ** 960), multiple - (multiple - x)).otherwise(x)


def _offsets(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, _b, _before, _total) from (by, _b, _n): rows in earlier buckets and rows in the group."""
    group = [F.col(c) for c in by] or [F.lit(0)]
    ordered = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*by, "_b", "_n", F.coalesce(F.sum("_n").over(ordered), F.lit(0)).alias("_before"),
                         F.sum("_n").over(Window.partitionBy(*group)).alias("_total"))


def rank_within(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    out: str,
    *,
    how: str = "average",
    ties: Sequence[str] = (),
    descending: bool = False,
    count_as: str | None = None,
) -> DataFrame:
    """Rank of ``value`` inside each group; null values get no rank.

    ``how`` is ``average`` (ties share the mean rank) or ``row`` (ties are ordered
    by the ``ties`` columns).  Mean ranks are found on distinct values with their counts and
    joined back, so ties of any number are one row to the windows; a window holds the distinct
    values of one bucket.  ``count_as`` names the count of ranked rows.
    """
    x = -F.col(value) if descending else F.col(value)
    tagged = df.withColumn("_v", x.cast("double")).withColumn("_b", value_bucket(F.col("_v"), RANK_BITS))
    kept = [c for c in df.columns if c not in (out, count_as)]
    present = tagged.filter(F.col("_v").isNotNull())
    if how == "average":
        counted = present.groupBy(*by, "_b", "_v").agg(F.count(F.lit(1)).alias("_n"))
        offsets = _offsets(counted.groupBy(*by, "_b").agg(F.sum("_n").alias("_n")), by).drop("_n")
        lower = Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
        first = F.col("_before") + F.coalesce(F.sum("_n").over(lower), F.lit(0))
        ranks = counted.join(offsets, [*by, "_b"]).select(*by, "_v", "_total", (first + (F.col("_n") + 1) / 2).alias("_rank"))
        joined = tagged.join(ranks, [*by, "_v"], "left")
        cols = [F.col("_rank").alias(out)]
    elif how == "row":
        offsets = _offsets(present.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n")), by)
        local = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_v", *ties))
        joined = tagged.join(offsets, [*by, "_b"], "left")
        cols = [F.when(F.col("_v").isNotNull(), F.col("_before") + local).alias(out)]
    else:
        raise ValueError(f"unknown rank method {how!r}")
    if count_as:
        cols.append(F.col("_total").alias(count_as))
    return joined.select(*kept, *cols)


def percentile_rank(df: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Average rank divided by the number of ranked rows."""
    ranked = rank_within(df, by, value, "_r", count_as="_c")
    return ranked.withColumn(out, F.col("_r") / F.col("_c")).drop("_r", "_c")


def locate(counts: DataFrame, by: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """Buckets that hold the order statistics of each quantile.

    ``counts``: (by, _b, _n).  Returns (by, _b, _before, _name, _at, _lo, _hi) with the
    wanted places counted from 0.
    """
    wanted = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in probs.items()])
    return (
        _offsets(counts, by).withColumn("_q", F.explode(wanted)).withColumn("_at", F.col("_q.p") * (F.col("_total") - 1))
        .select(*by, "_b", "_before", "_n", F.col("_q.name").alias("_name"), "_at",
                F.floor("_at").alias("_lo"), F.ceil("_at").alias("_hi"))
        .filter((F.col("_before") <= F.col("_hi")) & (F.col("_before") + F.col("_n") > F.col("_lo")))
        .drop("_n")
    )


def settle(counted: DataFrame, spots: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Quantiles (by, names) from the distinct values of the located buckets.

    ``counted``: (by, _b, _v, _n).  A bucket is cut once more into some four million parts at
    most by the next bits; only the parts that hold a wanted place are sorted, and the
    remaining bits allow a part no more distinct values than that, whatever the values are.
    """
    cut = counted.withColumn("_c", value_bucket(F.col("_v"), PART_BITS))
    sums = cut.groupBy(*by, "_b", "_c").agg(F.sum("_n").alias("_m")).join(spots, [*by, "_b"])
    before = Window.partitionBy(*by, "_b", "_name").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_m").over(before), F.lit(0))).filter(
        (F.col("_before") <= F.col("_hi")) & (F.col("_before") + F.col("_m") > F.col("_lo"))).drop("_m")
    upto = Window.partitionBy(*by, "_b", "_c", "_name").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = cut.join(parts, [*by, "_b", "_c"]).withColumn("_end", F.col("_before") + F.sum("_n").over(upto))
    start = F.col("_end") - F.col("_n")
    out = []
    for n in names:
        own = F.col("_name") == n
        low, high = (F.max(F.when(own & (start <= F.col(spot)) & (F.col(spot) < F.col("_end")), F.col("_v"))) for spot in ("_lo", "_hi"))
        out.append((low + (high - low) * F.max(F.when(own, F.col("_at") - F.col("_lo")))).alias(n))
    return placed.groupBy(*by).agg(*out)


def quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float]
) -> DataFrame:
    """Exact linear quantiles per group: one row per group, one column per entry.

    Bucket counts locate the order statistics; only the distinct values of the
    buckets that hold them are looked at again.  Groups without a value are absent.
    """
    x = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    x = x.withColumn("_b", value_bucket(F.col("_v")))
    spots = locate(x.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n")), by, probs)
    near = x.join(spots.select(*by, "_b"), [*by, "_b"], "left_semi")
    counted = near.groupBy(*by, "_b", "_v").agg(F.count(F.lit(1)).alias("_n"))
    return settle(counted, spots, by, list(probs))


def with_totals(df: DataFrame, by: Sequence[str], **aggs: Column) -> DataFrame:
    """Join group aggregates back: partial sums are shuffled instead of the rows."""
    totals = df.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()])
    kept = df.drop(*[n for n in aggs if n in df.columns])
    return kept.join(totals, list(by)) if by else kept.crossJoin(totals)


def capped_shares(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    cap: float | str,
    out: str,
    *,
    widen: bool = False,
    smallest: float | None = None,
) -> DataFrame:
    """Shares of ``value`` (>= 0) summing to 1 per group with none above ``cap``.

    ``cap`` may name a column of ``by`` that holds caps of ``smallest`` or more.

    What a capped row gives up goes to the uncapped rows in proportion, so every
    share is ``least(cap, value * r)`` with one factor ``r`` per group.  Only the
    largest ``1 / cap`` values can be capped: they settle ``r`` together with the
    group total.  ``widen`` raises the cap to ``1 / rows`` in small groups, and
    otherwise such a group is an error.
    """
    positive = df.filter(F.col(value) > 0)
    sums = positive.groupBy(*by).agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    if isinstance(cap, str) and (cap not in by or smallest is None):
        raise ValueError("a cap column has to be one of the grouping columns, with its smallest value given")
    most = math.ceil(1.0 / (smallest if isinstance(cap, str) else cap)) + 1
    group = [F.col(c) for c in by] or [F.lit(0)]
    # a row_number filter is applied before the shuffle too, so only `most` rows per task travel
    top = positive.select(*by, F.col(value).alias("_v")).withColumn(
        "_k", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("_v")))
    ).filter(F.col("_k") <= most)
    top = top.join(sums, list(by)) if by else top.crossJoin(sums)
    limit = F.col(cap) if isinstance(cap, str) else F.lit(float(cap))
    limit = F.greatest(limit, 1.0 / F.col("_n")) if widen else limit
    larger = F.coalesce(
        F.sum("_v").over(Window.partitionBy(*group).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0.0))
    top = top.withColumn("_cap", limit).withColumn(
        "_r", (1 - (F.col("_k") - 1) * F.col("_cap")) / (F.col("_sum") - larger))
    settled = F.col("_v") * F.col("_r") <= F.col("_cap") + 1e-12
    factors = top.groupBy(*by).agg(
        F.min_by("_r", F.when(settled, F.col("_k"))).alias("_r"), F.first("_cap").alias("_cap"))
    joined = df.join(factors, list(by), "left") if by else df.crossJoin(factors)
    if not widen:
        small = F.col("_cap").isNotNull() & F.col("_r").isNull()
        joined = joined.withColumn("_r", F.when(
            small, F.raise_error(F.lit("cap is infeasible for the number of rows"))).otherwise(F.col("_r")))
    share = F.when(F.col(value) > 0, F.least(F.col("_cap"), F.col(value) * F.col("_r"))).otherwise(F.lit(0.0))
    return joined.withColumn(out, share).drop("_r", "_cap")


def symbol_order(df: DataFrame, column: str = "symbol", out: str = "_i") -> DataFrame:
    """Distinct values of ``column`` with their position in sorted order from 0.

    Positions are counted per leading-letters bucket first, so the distinct
    values are never sorted in a single task.
    """
    names = df.select(column).distinct().withColumn("_b", F.substring(column, 1, 3))
    counts = names.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_b").orderBy(column)) - 1
    return names.join(offsets, "_b").select(column, (F.col("_before") + local).alias(out))
