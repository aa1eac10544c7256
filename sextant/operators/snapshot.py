"""Questions asked of the latest state: rankings, changes, distributions, tickers, holdings."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions import series as S
from sextant.functions import spread as D
from sextant.functions import timeaxis as T
from sextant.operators import metrics as M
from sextant.operators.accounting import size_positions

# Days of a lookback unit.
LOOKBACK_DAYS = {"d": 1, "w": 7, "m": 30, "y": 365}


def ticker_history(panels: Mapping[str, DataFrame], sharpes: DataFrame, value: float) -> DataFrame:
    """Panels (ts, symbol, value) aligned on (ts, symbol) with notionals, quantity and sides.

    One aggregation over the union of the panels instead of a chain of outer joins.
    """
    names = list(panels)
    rows = None
    for name, df in panels.items():
        part = df.select("ts", "symbol", F.lit(name).alias("_name"), F.col(df.columns[-1]).cast("double").alias("_v"))
        rows = part if rows is None else rows.unionByName(part)
    x = rows.groupBy("ts", "symbol").pivot("_name", names).agg(F.first("_v")).join(sharpes, "symbol", "left")
    target = F.col("target_weight")
    return x.withColumn("target_notional", target * value).withColumn("held_notional", F.col("held_weight") * value) \
        .withColumn("quantity", target * value / F.nullif(F.col("price"), F.lit(0.0))) \
        .withColumn("xsec_side", F.when(target > 1e-10, "LONG").when(target < -1e-10, "SHORT").otherwise("FLAT")) \
        .withColumn("trend_side", F.when(F.col("absolute_forecast") >= 0, "LONG").otherwise("SHORT"))


def signal_records(fc: DataFrame, combined: DataFrame, targets: DataFrame, value: float) -> DataFrame:
    """Signal ledger rows: map of components, combined forecast, percentile, direction, target notional, quality."""
    components = fc.groupBy("ts", "symbol", "pos").agg(F.map_from_entries(
        F.array_sort(F.collect_list(F.struct("rule", "value")))).alias("components"))
    ranked = D.percentile_rank(combined.select("ts", "symbol", "pos", "f"), ["pos"], "f", "percentile")
    x = ranked.join(components, ["ts", "symbol", "pos"], "left").join(targets.select("symbol", "pos", "w"), ["symbol", "pos"], "left")
    f = F.col("f")
    direction = F.when(f.isNull(), "UNAVAILABLE").when(f > 0, "LONG").when(f < 0, "SHORT").otherwise("FLAT")
    return x.withColumn("direction", direction).withColumn("target_notional", F.coalesce("w", F.lit(0.0)) * value).withColumn(
        "quality_flag", F.when(f.isNotNull(), "valid").otherwise("warmup")).drop("w")


def latest(df: DataFrame) -> DataFrame:
    """Rows at the newest timestamp of the table."""
    end = df.agg(F.max("ts").alias("_end"))
    return df.join(end, F.col("ts") == F.col("_end")).drop("_end")


def ticker(df: DataFrame, symbol: str) -> DataFrame:
    return df.filter(F.col("symbol") == symbol)


def top_signals(rows: DataFrame, by: str, n: int, sector: DataFrame | None = None) -> DataFrame:
    """The strongest longs and shorts: by rank of the target weights, or by Sharpe of the trend side."""
    x = rows if sector is None else rows.join(sector.select("symbol").distinct(), "symbol", "left_semi")
    if by == "sr":
        longs = x.filter(F.col("trend_side") == "LONG").orderBy(F.desc_nulls_last("standalone_sr"), "symbol")
        shorts = x.filter(F.col("trend_side") == "SHORT").orderBy(F.desc_nulls_last("standalone_sr"), "symbol")
    else:
        longs = x.filter(F.col("xsec_signal") > 0).orderBy(F.desc_nulls_last("rank"), "symbol")
        shorts = x.filter(F.col("xsec_signal") < 0).orderBy(F.asc_nulls_last("rank"), "symbol")
    return longs.limit(n).withColumn("side", F.lit("LONG")).unionByName(shorts.limit(n).withColumn("side", F.lit("SHORT")))


def shadow_summary(signals: DataFrame, funding: DataFrame, n: int = 5) -> DataFrame:
    """Strongest n per direction and the funding paid, received and net as rows (item, symbol, value)."""
    longs = signals.filter(F.col("direction") == "LONG").orderBy(F.desc("f"), "symbol").limit(n)
    shorts = signals.filter(F.col("direction") == "SHORT").orderBy("f", "symbol").limit(n)
    top = longs.select(F.lit("long").alias("item"), "symbol", F.col("f").alias("value")).unionByName(
        shorts.select(F.lit("short").alias("item"), "symbol", F.col("f").alias("value")))
    flows = funding.agg(
        F.coalesce(-F.sum(F.when(F.col("cashflow") < 0, F.col("cashflow"))), F.lit(0.0)).alias("paid"),
        F.coalesce(F.sum(F.when(F.col("cashflow") > 0, F.col("cashflow"))), F.lit(0.0)).alias("received"))
    none = F.lit(None).cast("string")
    return top.unionByName(flows.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("item"), none.alias("symbol"), v.alias("value")) for k, v in {
            "paid": F.col("paid"), "received": F.col("received"), "net": F.col("received") - F.col("paid")}.items()]))))


def changes(history: DataFrame, days: int | None, n: int) -> DataFrame:
    """Largest target changes between the newest snapshot and the newest one at least ``days`` old (else the oldest)."""
    stamps = history.select("ts").distinct()
    end = stamps.agg(F.max("ts").alias("_now"), F.min("ts").alias("_first"))
    if days is None:
        ends = end.withColumn("_then", F.col("_first"))
    else:
        cut = F.col("_now") - F.make_dt_interval(F.lit(days))
        found = stamps.join(end, F.col("ts") <= cut).agg(F.max("ts").alias("_found"))
        ends = end.crossJoin(found).withColumn("_then", F.coalesce("_found", "_first")).drop("_found")
    now = history.join(ends.select("_now"), F.col("ts") == F.col("_now"))
    then = history.join(ends.select("_then"), F.col("ts") == F.col("_then")).select(
        "symbol", F.col("absolute_forecast").alias("_f"), F.col("rank").alias("_r"), F.col("target_weight").alias("_w"))
    x = now.join(then, "symbol", "left").select(
        "symbol", (F.col("absolute_forecast") - F.col("_f")).alias("forecast_change"), (F.col("rank") - F.col("_r")).alias("rank_change"),
        (F.col("target_weight") - F.col("_w")).alias("target_change"))
    return x.orderBy(F.abs("target_change").desc_nulls_last(), "symbol").limit(n)


def lookback_days(token: str) -> int | None:
    """Days of ``7d``, ``4w``, ``6m``, ``1y``; ``all`` is None."""
    text = token.strip().lower()
    if text == "all":
        return None
    found = re.fullmatch(r"(\d+)([dwmy])", text)
    if not found or not 1 <= int(found[1]) * LOOKBACK_DAYS[found[2]] <= 3650:
        raise ValueError(f"invalid lookback {token!r}")
    return int(found[1]) * LOOKBACK_DAYS[found[2]]


def lookback_column(token: Column) -> Column:
    """The same for a column of tokens: days, null for ``all`` and for anything invalid."""
    text = F.lower(F.trim(token))
    unit = F.regexp_extract(text, r"^(\d+)([dwmy])$", 2)
    amount = F.nullif(F.regexp_extract(text, r"^(\d+)([dwmy])$", 1), F.lit("")).cast("int")
    scale = F.create_map(*[F.lit(x) for pair in LOOKBACK_DAYS.items() for x in pair])
    days = amount * F.try_element_at(scale, unit)
    return F.when((amount >= 1) & (days <= 3650), days)


def window_days(df: DataFrame, token: str) -> DataFrame:
    """Rows of the last calendar days that end at the newest row."""
    days = lookback_days(token)
    if days is None:
        return df
    end = df.agg((F.max("ts") - F.make_dt_interval(F.lit(days - 1))).alias("_from"))
    return df.join(end, F.col("ts") >= F.col("_from")).drop("_from")


def distribution(history: DataFrame, token: str = "180d", value: str = "absolute_forecast") -> DataFrame:
    """Mean, quartiles, breadth and count of the cross-section of every bar in the lookback."""
    x = window_days(history, token).filter(F.col(value).isNotNull())
    base = x.groupBy("ts").agg(F.avg(value).alias("mean"), F.avg((F.col(value) > 0).cast("double")).alias("positive_breadth"), F.count(F.lit(1)).alias("universe"))
    return base.join(D.quantiles(x, ["ts"], value, {"p25": 0.25, "p75": 0.75}), "ts")


def performance(daily: DataFrame, token: str = "1y", bench: DataFrame | None = None) -> DataFrame:
    """Metrics over a lookback, against a benchmark on common days if one is given."""
    x = window_days(daily, token)
    return M.perf_metrics(x) if bench is None else M.compare(x, bench)


def ticker_snapshot(prices: DataFrame, records: DataFrame, attribution: DataFrame, income: DataFrame, benchmark: str,
                    models: Sequence[str], *, short: int = 30, long: int = 90, least: int = 60) -> DataFrame:
    """One row per symbol: last price, returns, volatility, beta, forecasts by model, attribution, account funding.

    Trailing values stand at the newest bar of the panel; prices are filled forward.
    """
    end = prices.agg(F.max("pos").alias("_end"))
    x = prices.crossJoin(end)

    def at_lag(k: int) -> Column:
        return F.max_by("open", F.when((F.col("pos") <= F.col("_end") - k) & F.col("open").isNotNull(), F.col("pos")))

    last = x.groupBy("symbol").agg(at_lag(0).alias("last_open"), at_lag(short).alias("_s"), at_lag(long).alias("_l"))
    last = last.withColumn("return_short", F.col("last_open") / F.nullif(F.col("_s"), F.lit(0.0)) - 1).withColumn(
        "return_long", F.col("last_open") / F.nullif(F.col("_l"), F.lit(0.0)) - 1).drop("_s", "_l")
    rets = S.simple_returns(prices, "open")
    recent = rets.crossJoin(end).filter(F.col("pos") > F.col("_end") - long)
    b = recent.filter(F.col("symbol") == benchmark).select("pos", F.col("ret").alias("_b"))
    pair = recent.join(b, "pos", "left")
    both = F.col("ret").isNotNull() & F.col("_b").isNotNull()
    risk = pair.groupBy("symbol").agg(
        F.when(F.count("ret") >= least, F.stddev_samp("ret") * math.sqrt(365)).alias("volatility"),
        F.when(F.count_if(both) >= least, F.covar_samp("ret", "_b")).alias("_cov"))
    var = b.agg(F.when(F.count("_b") >= least, F.var_samp("_b")).alias("_var"))
    risk = risk.crossJoin(var).withColumn("beta", F.col("_cov") / F.nullif(F.col("_var"), F.lit(0.0))).drop("_cov", "_var")
    wide = latest(records).groupBy("symbol").pivot("model", list(models)).agg(
        F.first("forecast").alias("forecast"), F.first("percentile").alias("percentile"), F.first("position").alias("position"))
    attr = attribution.groupBy("symbol").pivot("model", list(models)).agg(F.first("contribution").alias("contribution"))
    attr = attr.select("symbol", *[F.col(m).alias(f"{m}_contribution") for m in models])
    money = income.groupBy("symbol").agg(
        F.sum("income").alias("funding_net"), F.count("income").alias("funding_events"),
        F.sum(F.when(F.col("income") < 0, F.col("income"))).alias("funding_paid"),
        F.sum(F.when(F.col("income") > 0, F.col("income"))).alias("funding_received"))
    out = last
    for part in (risk, wide, attr, money):
        out = out.join(part, "symbol", "left")
    return out.withColumn("funding_events", F.coalesce("funding_events", F.lit(0).cast("bigint")))


def signal_stats(records: DataFrame, keys: Sequence[str] = ("symbol", "model"), f: str = "forecast") -> DataFrame:
    """Mean, deviation, mean size, positive share, valid days and direction flips of valid forecasts."""
    x = records.filter(F.col(f).isNotNull()).withColumn("_d", F.signum(f))
    x = S.running(x, {"_p": ("last", "_d", False)}, keys=keys)
    return x.groupBy(*keys).agg(
        F.avg(f).alias("forecast_mean"), F.stddev_samp(f).alias("forecast_std"), F.avg(F.abs(f)).alias("mean_abs_forecast"),
        F.avg((F.col(f) > 0).cast("double")).alias("positive_share"), F.count(f).alias("valid_days"),
        F.count_if(F.col("_p").isNotNull() & (F.col("_d") != F.col("_p"))).alias("direction_flips"))


def current_components(fc: DataFrame, rules: Sequence[str]) -> DataFrame:
    """Last known value of every rule per symbol, one column per rule."""
    last = fc.groupBy("symbol", "rule").agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("pos"))).alias("value"))
    return last.groupBy("symbol").pivot("rule", list(rules)).agg(F.first("value"))


def holdings_weekly(positions: DataFrame, k: int = 18) -> DataFrame:
    """Last holding of each week for the ``k`` largest names by mean size, the rest netted: (week, label, held).

    The mean is over all bars of the table; a name without a row at the last bar of a week holds 0.
    """
    bars = positions.select("ts").distinct()
    size = positions.groupBy("symbol").agg(F.sum(F.abs("held")).alias("_s"))
    top = size.orderBy(F.desc("_s"), "symbol").limit(k).select("symbol", F.lit(True).alias("_top"))
    ends = bars.groupBy(T.week(F.col("ts")).alias("week")).agg(F.max("ts").alias("ts"))
    x = positions.join(ends, "ts").join(top, "symbol", "left")
    label = F.when(F.coalesce("_top", F.lit(False)), F.col("symbol")).otherwise(F.lit("OTHER_NET"))
    return x.groupBy("week", label.alias("label")).agg(F.sum("held").alias("held"))


def eligibility_share(records: DataFrame) -> DataFrame:
    """Share of eligible symbols by refit and rule."""
    return records.groupBy("refit_ts", "rule").agg(F.avg(F.col("eligible").cast("double")).alias("share"))


def multiplier_bands(cells: DataFrame) -> DataFrame:
    """Median and 10 / 90 % bands of the multiplier per bar."""
    return D.quantiles(cells, ["ts"], "fdm", {"median": 0.5, "p10": 0.1, "p90": 0.9})


def current_signals(px: DataFrame, fc: DataFrame, weights: DataFrame, *, multiplier: float, value: float, target: float,
                    freq: str = "1d", lookback: int = 36, periods: int = 365) -> DataFrame:
    """Last signal, notional and side of each symbol with the Sharpe of its sized P&L.

    ``weights``: (symbol, rule, weight); symbols without a weight set are skipped.
    """
    known = fc.join(weights.select("symbol", "rule", F.col("weight").alias("_w")), ["symbol", "rule"])
    sig = known.groupBy("ts", "symbol", "pos").agg(
        (F.sum(F.coalesce("value", F.lit(0.0)) * F.col("_w")) * multiplier).alias("f"))
    sig = sig.withColumn("f", F.greatest(F.least("f", F.lit(20.0)), F.lit(-20.0)))
    sized = size_positions(px.join(sig.select("symbol", "pos", "f"), ["symbol", "pos"]), value=value, target=target, freq=freq, lookback=lookback)
    pnl = S.over_bars(sized, lambda w: {"_r": S.at("units", -2, w) * (F.col("close") - S.at("close", -1, w)) / value}, before=2)
    out = pnl.groupBy("symbol").agg(
        F.round(F.max_by("f", "pos"), 2).alias("signal"), F.max_by("notional", "pos").alias("notional"),
        F.avg("_r").alias("_m"), F.nullif(F.stddev_samp("_r"), F.lit(0.0)).alias("_s"))
    side = F.when(F.col("notional") > 0, "LONG").when(F.col("notional") < 0, "SHORT").otherwise("FLAT")
    return out.withColumn("side", side).withColumn("sharpe", F.col("_m") / F.col("_s") * math.sqrt(periods)).drop("_m", "_s")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts of equal-width bins between the smallest and the largest value: (bin, low, high, n)."""
    x = df.filter(F.col(column).isNotNull() & ~F.isnan(column))
    ends = x.agg(F.min(column).alias("_a"), F.max(column).alias("_b"))
    width = (F.col("_b") - F.col("_a")) / bins
    at = F.when(width == 0, F.lit(1)).otherwise(F.least(F.floor((F.col(column) - F.col("_a")) / F.nullif(width, F.lit(0.0))) + 1, F.lit(bins)))
    counted = x.crossJoin(ends).groupBy(at.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.first("_a").alias("_a"), F.first("_b").alias("_b"))
    return counted.select("bin", (F.col("_a") + (F.col("bin") - 1) * width).alias("low"), (F.col("_a") + F.col("bin") * width).alias("high"), "n")
