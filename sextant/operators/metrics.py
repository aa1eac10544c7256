"""Performance measures of daily series (keys..., ts, pos, net, turnover, funding, ...).

Moments are plain aggregates; quantiles go through the bucketed exact form,
compounding and drawdowns through block-wise running values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions import series as S
from sextant.functions import spread as D
from sextant.functions import timeaxis as T
from sextant.functions.stats import safe_corr
from sextant.operators.accounting import BARS_PER_YEAR, equity_and_drawdown

ROOT = math.sqrt(365)


def _over(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def _left(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    return a.join(b, list(by), "left") if by else a.crossJoin(b)


def drawdown(series: DataFrame, value: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Equity and drawdown of return series, or of equity series.

    A series whose first value exceeds 0.5 is taken for an equity curve.
    """
    clean = series.filter(F.col(value).isNotNull() & ~F.isnan(value))
    first = clean.groupBy(*keys).agg((F.min_by(value, "pos") > 0.5).alias("_eq"))
    x = _left(clean, first, keys)
    x = S.running(x, {"_grown": ("product", 1 + F.col(value), True)}, keys=keys)
    x = x.withColumn("equity", F.when(F.col("_eq"), F.col(value)).otherwise(F.col("_grown"))).drop("_eq", "_grown")
    x = S.running(x, {"_peak": ("max", "equity", True)}, keys=keys)
    return x.withColumn("drawdown", F.col("equity") / F.col("_peak") - 1).drop("_peak")


def perf_metrics(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Annual return, volatility, Sharpe, maximum drawdown, turnover and funding per group."""
    base = daily.groupBy(*by).agg(
        (F.avg("net") * 365).alias("annual_return"), (F.stddev_samp("net") * ROOT).alias("annual_volatility"),
        (F.avg("turnover") * 365).alias("annual_turnover"), F.sum("funding").alias("funding_return"),
        F.count("net").alias("observations"))
    grown = equity_and_drawdown(daily.filter(F.col("net").isNotNull()), "net", by).groupBy(*by).agg(
        F.min("drawdown").alias("max_drawdown"), (F.max_by("equity", "pos") - 1).alias("cumulative_return"))
    return _left(base, grown, by).withColumn("net_sharpe", _over(F.col("annual_return"), F.col("annual_volatility")))


def in_splits(daily: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows repeated for every split (split, start, end) that holds their day; splits is a small table."""
    inside = (F.col("ts") >= F.col("start")) & (F.coalesce(F.col("ts") <= F.col("end"), F.lit(True)))
    return daily.join(splits, inside)


def metrics_by_split(daily: DataFrame, splits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return perf_metrics(in_splits(daily, splits), [*by, "split"])


def compound(daily: DataFrame, grain: str, by: Sequence[str] = (), value: str = "net") -> DataFrame:
    """Returns compounded to calendar weeks (Monday to Sunday), months or years."""
    start = {"week": T.week, "month": T.month,
             "year": lambda c: F.trunc(F.to_date(c), "year").cast("timestamp_ntz")}[grain](F.col("ts"))
    return daily.groupBy(*by, start.alias("period")).agg((F.product(1 + F.col(value)) - 1).alias("ret"))


def rich_metrics(daily: DataFrame, bench: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The wide metric set; ``bench`` is (ts, bench), an absent benchmark day counts as 0."""
    x = daily.filter(F.col("net").isNotNull()).join(bench.select("ts", F.col("bench").alias("_b")), "ts", "left") \
        .withColumn("_b", F.coalesce("_b", F.lit(0.0)))
    base = perf_metrics(x, by)
    down = F.when(F.col("net") < 0, F.col("net"))
    more = x.groupBy(*by).agg(
        (F.stddev_samp(down) * ROOT).alias("_down"), F.avg((F.col("net") > 0).cast("double")).alias("positive_day_rate"),
        F.sum("fee").alias("fees"), F.sum("slippage").alias("slippage"),
        _over(F.covar_samp("net", "_b"), F.var_samp("_b")).alias("bench_beta"),
        safe_corr("net", "_b").alias("bench_correlation"))
    weeks = compound(x, "week", by).groupBy(*by).agg(F.min("ret").alias("worst_week"))
    months = compound(x, "month", by).groupBy(*by).agg(F.min("ret").alias("worst_month"))
    tail = D.quantiles(x, by, "net", {"_q": 0.05})
    cvar = _left(x, tail, by).filter(F.col("net") <= F.col("_q")).groupBy(*by).agg(F.avg("net").alias("cvar_95"))
    out = base
    for part in (more, weeks, months, cvar):
        out = _left(out, part, by)
    return out.withColumn("sortino", _over(F.col("annual_return"), F.col("_down"))).withColumn(
        "calmar", F.when(F.col("max_drawdown") < 0, F.col("annual_return") / F.abs("max_drawdown"))).drop("_down")


def rolling_metrics(daily: DataFrame, bench: DataFrame, windows: Sequence[int], keys: Sequence[str] = (),
                    least: int = 30) -> DataFrame:
    """Trailing metrics per window length, from max(window / 2, least) bars on."""
    x = daily.join(bench.select("ts", F.col("bench").alias("_b")), "ts", "left")
    both = F.when(F.col("net").isNotNull() & F.col("_b").isNotNull(), F.lit(1))
    x = x.withColumn("_both", both)
    out = None
    for window in windows:
        need = max(window // 2, least)

        def build(w, window=window, need=need):
            t = S.trailing(w, window)

            def enough(c, v):
                return F.when(F.count(c).over(t) >= need, v)

            return {
                "annual_return": enough("net", F.avg("net").over(t) * 365),
                "annual_volatility": enough("net", F.stddev_samp("net").over(t) * ROOT),
                "bench_beta": _over(enough("_both", F.covar_samp("net", "_b").over(t)),
                                    enough("_b", F.var_samp("_b").over(t))),
                "bench_correlation": enough("_both", safe_corr("net", "_b", t)),
                "annual_turnover": enough("turnover", F.avg("turnover").over(t) * 365),
                "funding_return": enough("funding", F.sum("funding").over(t)),
            }

        part = S.over_bars(x, build, before=window - 1, keys=keys).withColumn("window", F.lit(window)).withColumn(
            "sharpe", _over(F.col("annual_return"), F.col("annual_volatility")))
        out = part if out is None else out.unionByName(part)
    return out.drop("_b", "_both")


def search_score(daily: DataFrame, by: Sequence[str] = (), least: int = 180) -> DataFrame:
    """Sharpe, annual turnover and count per group; too few rows score null."""
    x = daily.groupBy(*by).agg(
        F.count("net").alias("observations"), (F.avg("net") * 365).alias("_r"),
        (F.stddev_samp("net") * ROOT).alias("_v"), (F.avg("turnover") * 365).alias("_t"))
    enough = F.col("observations") >= least
    return x.withColumn("sharpe", F.when(enough & (F.col("_v") > 0), F.col("_r") / F.col("_v"))).withColumn(
        "annual_turnover", F.when(enough, F.col("_t"))).drop("_r", "_v", "_t")


def deflated_sharpe(sr: Column, n_trials: int, n_obs: Column) -> Column:
    """Sharpe less the best of ``n_trials`` lucky ones; null unless trials and rows exceed one."""
    if n_trials <= 1:
        return F.lit(None).cast("double")
    lucky = NormalDist().inv_cdf(1.0 - 1.0 / n_trials)
    spread = F.sqrt((1.0 + 0.5 * sr * sr) / F.greatest(F.lit(1), n_obs - 1))
    return F.when((n_obs > 1) & sr.isNotNull(), sr - lucky * spread)


def series_metrics(daily: DataFrame, freq: str = "1d", by: Sequence[str] = (), n_trials: int | None = None) -> DataFrame:
    """Sharpe, CAGR, drawdown, total return, skew, 5 / 95 % tails and t-statistic of ``net``."""
    periods = BARS_PER_YEAR.get(freq, 365)
    clean = daily.filter(F.col("net").isNotNull())
    n = F.count("net")
    base = clean.groupBy(*by).agg(
        n.alias("observations"), F.avg("net").alias("_m"), F.stddev_samp("net").alias("_s"),
        F.when(n > 2, F.skewness("net") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"))
    grown = equity_and_drawdown(clean, "net", by).groupBy(*by).agg(
        F.min("drawdown").alias("max_drawdown"), (F.max_by("equity", "pos") - 1).alias("total_return"))
    tails = D.quantiles(clean, by, "net", {"lower_tail": 0.05, "upper_tail": 0.95})
    x = _left(_left(base, grown, by), tails, by)
    x = x.withColumn("sharpe", _over(F.col("_m"), F.col("_s")) * math.sqrt(periods))
    x = x.withColumn("cagr", F.when(F.col("total_return") > -1, F.pow(
        1 + F.col("total_return"), periods / F.greatest(F.lit(1), F.col("observations"))) - 1))
    x = x.withColumn("volatility", F.col("_s") * math.sqrt(periods)).withColumn(
        "t_stat", F.col("_m") / F.nullif(F.col("_s") / F.sqrt("observations"), F.lit(0.0)))
    if n_trials is not None:
        x = x.withColumn("deflated_sharpe", deflated_sharpe(F.col("sharpe"), n_trials, F.col("observations")))
    return x.drop("_m", "_s")


def rolling_perf(daily: DataFrame, n: int, periods: int = 365, keys: Sequence[str] = ()) -> DataFrame:
    """Trailing Sharpe, volatility and compounded return over full windows of ``n`` bars."""
    def build(w):
        t = S.trailing(w, n)
        sd = S.rolling_std("net", n, w)
        return {
            "rolling_sharpe": _over(S.rolling_mean("net", n, w), sd) * math.sqrt(periods),
            "rolling_vol": sd * math.sqrt(periods),
            "rolling_return": S.full("net", n, w, F.product(1 + F.col("net")).over(t) - 1)}
    return S.over_bars(daily, build, before=n - 1, keys=keys)


def compare(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Metrics of a portfolio (keys, ts, pos, net) and a benchmark (ts, bench) on their common days."""
    x = a.filter(F.col("net").isNotNull()).join(b.filter(F.col("bench").isNotNull()).select("ts", "bench"), "ts")
    x = x.select(*by, "ts", "pos", "net", "bench")
    zero = {"turnover": F.lit(0.0), "funding": F.lit(0.0)}
    measures = ("annual_return", "annual_volatility", "net_sharpe", "max_drawdown", "cumulative_return")

    def side(column: str, prefix: str) -> DataFrame:
        m = perf_metrics(x.withColumn("net", F.col(column)).withColumns(zero), by)
        return m.select(*by, *[F.col(c).alias(f"{prefix}_{c}") for c in measures])

    both = x.groupBy(*by).agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("observations"),
        safe_corr("net", "bench").alias("correlation"), _over(F.covar_samp("net", "bench"), F.var_samp("bench")).alias("beta"))
    out = _left(_left(both, side("net", "portfolio"), by), side("bench", "benchmark"), by)
    return out.withColumn("excess", F.col("portfolio_cumulative_return") - F.col("benchmark_cumulative_return"))


def benchmark_returns(prices: DataFrame, start, end, cost: float = 0.0009, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Passive returns of the priced days in [start, end], entry cost taken from the first one."""
    span = prices.filter(F.col("ts").between(T.ntz(start), T.ntz(end)) & F.col("close").isNotNull())
    lagged = S.running(span, {"_prev": ("last", "close", False)}, keys=keys)
    rets = lagged.withColumn("ret", F.col("close") / F.nullif(F.col("_prev"), F.lit(0.0)) - 1).filter(
        F.col("ret").isNotNull()).drop("_prev")
    first = rets.groupBy(*keys).agg(F.min("pos").alias("_first"))
    return _left(rets, first, keys).withColumn(
        "ret", F.col("ret") - F.when(F.col("pos") == F.col("_first"), F.lit(cost)).otherwise(F.lit(0.0))).drop("_first")


def summary_stats(daily: DataFrame, by: Sequence[str] = (), periods: int = 365) -> DataFrame:
    """Mean, deviation, extremes, median, t-statistic with its degrees of freedom and population skew."""
    clean = daily.filter(F.col("net").isNotNull())
    n = F.count("net")
    base = clean.groupBy(*by).agg(
        F.avg("net").alias("mean"), F.stddev_samp("net").alias("std"), F.min("net").alias("min"), F.max("net").alias("max"),
        F.skewness("net").alias("skew"), (n - 1).alias("degrees"), F.sum("net").alias("total"))
    x = _left(base, D.quantiles(clean, by, "net", {"median": 0.5}), by)
    return x.withColumn("ann_mean", F.col("mean") * periods).withColumn("ann_std", F.col("std") * math.sqrt(periods)) \
        .withColumn("sharpe", _over(F.col("ann_mean"), F.col("ann_std"))) \
        .withColumn("t_stat", F.col("mean") / F.nullif(F.col("std") / F.sqrt(F.col("degrees") + 1), F.lit(0.0)))


def cumulative_curve(daily: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Running sum of returns and its distance from the running maximum."""
    x = S.running(daily, {"curve": ("sum", "net", True)}, keys=keys)
    x = S.running(x, {"_peak": ("max", "curve", True)}, keys=keys)
    return x.withColumn("below_peak", F.col("curve") - F.col("_peak")).drop("_peak")


def standalone_sharpe(contrib: DataFrame, least: int = 365, days: int | None = None) -> DataFrame:
    """Sharpe of each symbol's own net contribution, null with too few rows or no spread.

    With ``days`` only the last calendar days count and the minimum shrinks to
    min(20, max(3, days / 2)).
    """
    x = contrib
    if days is not None:
        end = contrib.agg(F.max("pos").alias("_end"))
        x = contrib.crossJoin(end).filter(F.col("pos") > F.col("_end") - days)
        least = min(20, max(3, int(days * 0.5)))
    agg = x.groupBy("symbol").agg(
        F.count("contribution").alias("n"), F.avg("contribution").alias("_m"), F.stddev_samp("contribution").alias("_s"))
    return agg.withColumn("sharpe", F.when(
        (F.col("n") >= least) & (F.col("_s") > 0), F.col("_m") / F.col("_s") * ROOT)).drop("_m", "_s")


def equal_weight_basket(rows: DataFrame, value: float = 1.0) -> DataFrame:
    """Mean of the available returns per bar with equity, drawdown and running cost drag.

    ``rows``: (ts, symbol, pos, returns, total_cost).
    """
    daily = rows.groupBy("ts", "pos").agg(
        F.avg("returns").alias("net"), F.coalesce(F.avg(F.col("total_cost") / value), F.lit(0.0)).alias("_c"))
    costs = S.running(daily, {"cost_drag": ("sum", "_c", True)}, keys=())
    return equity_and_drawdown(costs.filter(F.col("net").isNotNull()), "net").drop("_c")


def basket_contributions(rows: DataFrame) -> DataFrame:
    """Compounded return of each member of the basket."""
    return rows.groupBy("symbol").agg((F.product(1 + F.coalesce("returns", F.lit(0.0))) - 1).alias("contribution"))


def _pair_sums():
    """Sums over common bars of every pair of columns, for one block of bars at a time."""

    def sums(frame):
        x = frame.pivot_table(index="pos", columns="symbol", values="returns", aggfunc="first")
        there = x.notna().to_numpy(float)
        v = x.fillna(0.0).to_numpy(float)
        i, j = np.triu_indices(v.shape[1], k=1)
        names = x.columns.to_numpy()
        moments = {"n": there.T @ there, "sx": v.T @ there, "sy": there.T @ v, "sxx": (v * v).T @ there,
                   "syy": there.T @ (v * v), "sxy": v.T @ v}
        return pd.DataFrame({"a": names[i], "b": names[j], **{k: m[i, j] for k, m in moments.items()}})

    return sums


def pairwise_correlations(rows: DataFrame, bars: int = 256) -> DataFrame:
    """Correlation of each pair of members on their common bars: (a, b, corr).

    Built-in joins would emit every pair of every bar; a block of bars instead
    yields its pair sums from one matrix product, and only those are shuffled.
    """
    x = rows.filter(F.col("returns").isNotNull()).select(
        F.floor(F.col("pos") / bars).alias("_blk"), "pos", "symbol", "returns")
    fields = ("n", "sx", "sy", "sxx", "syy", "sxy")
    parts = x.groupBy("_blk").applyInPandas(
        _pair_sums(), "a string, b string, " + ", ".join(f"{f} double" for f in fields))
    t = parts.groupBy("a", "b").agg(*[F.sum(f).alias(f) for f in fields])
    cov = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    va = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    vb = F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")
    return t.select("a", "b", F.when((F.col("n") > 1) & (va > 0) & (vb > 0), cov / F.sqrt(va * vb)).alias("corr"))


def mean_pairwise_correlation(rows: DataFrame) -> DataFrame:
    """Average correlation of the member pairs."""
    return pairwise_correlations(rows).agg(F.avg("corr").alias("avg_pairwise_corr"), F.count("corr").alias("pairs"))


def exposure_stats(rows: DataFrame, value: float, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """Average and largest exposure, turnover and cost drag (position, turnover, total_cost)."""
    return rows.groupBy(*by).agg(
        F.avg(F.abs("position")).alias("avg_exposure"), F.max(F.abs("position")).alias("max_exposure"),
        F.sum("turnover").alias("turnover"), (F.sum("total_cost") / value).alias("cost_drag"))
