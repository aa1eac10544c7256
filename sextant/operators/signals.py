"""Returns, volatility and forecasts along each series.

Panels are (ts, symbol, pos, close); forecasts are (ts, symbol, pos, rule, value).
Every window goes through :mod:`sextant.functions.series`, so one long series is
cut into blocks and never has to fit a task.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions import series as S
from sextant.session import cut_lineage

DAYS_PER_YEAR = 365
CAP = 20.0
# The rule set and scalars published with the forecasting method.
EWMAC_RULES = ((2, 8), (4, 16), (8, 32), (16, 64), (32, 128))
EWMAC_SCALARS = {
    (2, 8): 10.6, (4, 16): 7.5, (8, 32): 5.3, (16, 64): 3.75, (32, 128): 2.65, (64, 256): 1.87,
}
BREAKOUT_SCALARS = {10: 0.60, 20: 0.67, 40: 0.70, 80: 0.73, 160: 0.74, 320: 0.74}
BREAKOUT_HORIZONS = (16, 32, 64, 128, 256)


def capped(x: Column, cap: float = CAP) -> Column:
    """``x`` limited to +-cap; null stays null (greatest and least would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(cap)), F.lit(-cap)))


def legacy_cap(x: Column) -> Column:
    """The bot's cap, in which a missing forecast and exactly -20 both become +20."""
    return F.when((x < 20) & (x > -20), x).when(x < -20, F.lit(-20.0)).otherwise(F.lit(20.0))


def pct_change(df: DataFrame, value: str = "close", k: int = 1, out: str = "ret") -> DataFrame:
    """Return over ``k`` bars without filling absent bars."""
    return S.simple_returns(df, value, k, out)


def forward_returns(df: DataFrame, horizon: int) -> DataFrame:
    """Returns earned after ``ts``: fwd_open, fwd_close and fwd_h from the next open.

    fwd_open runs from this open to the next open, fwd_close from this close to
    the next, fwd_h from the next open to the open ``horizon`` bars later.
    """
    return S.over_bars(df, lambda w: {
        "fwd_open": S.at("open", 1, w) / F.nullif(F.col("open"), F.lit(0.0)) - 1,
        "fwd_close": S.at("close", 1, w) / F.nullif(F.col("close"), F.lit(0.0)) - 1,
        "fwd_h": S.at("open", horizon + 1, w) / F.nullif(S.at("open", 1, w), F.lit(0.0)) - 1,
    }, after=horizon + 1)


def causal_vol(df: DataFrame, lookback: int, out: str = "vol", periods: int = DAYS_PER_YEAR) -> DataFrame:
    """Annualised trailing deviation of returns, null until the window is full."""
    with_ret = S.simple_returns(df, out="_ret")
    return S.over_bars(with_ret, lambda w: {
        out: S.rolling_std("_ret", lookback, w) * math.sqrt(periods)}, before=lookback - 1).drop("_ret")


def diff_vol(df: DataFrame, lookback: int, out: str = "vol", backfill: bool = False, shorten: bool = False) -> DataFrame:
    """Trailing deviation of price differences from half a window on, zero as null.

    ``backfill`` fills the warm-up from later bars, which looks ahead, then fills
    forward and with 1e-8; only the bot path sizes positions that way. ``shorten``
    cuts the window of a series with fewer prices to their number.
    """
    diffs = S.over_bars(df, lambda w: {"_d": F.col("close") - S.at("close", -1, w)}, before=1)
    if shorten:
        counts = df.filter(F.col("close").isNotNull()).groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))
        diffs = diffs.join(counts, "symbol", "left").withColumn("_look", _shortened(F.coalesce("_n", F.lit(0)), lookback))
        vol = S.trailing_parts(diffs, {"_k": (F.count, "_d"), "_m": (F.avg, "_d"), "_v": (F.var_pop, "_d"), "_min": (F.min, "_d")}, "_look")
        na, nb = F.col("_k_a"), F.col("_k_b")
        n = na + nb
        # the mean of equal values is that value, so they keep a deviation of exactly zero
        ma, mb = (F.when(F.col(f"_v_{p}") == 0, F.col(f"_min_{p}")).otherwise(F.col(f"_m_{p}")) for p in ("a", "b"))
        between = F.when((na > 0) & (nb > 0), F.pow(ma - mb, F.lit(2.0)) * na * nb / n).otherwise(F.lit(0.0))
        squares = F.coalesce(F.col("_v_a") * na, F.lit(0.0)) + F.coalesce(F.col("_v_b") * nb, F.lit(0.0)) + between
        enough = n >= F.greatest(F.lit(2), F.floor(F.col("_look") / 2))
        vol = vol.withColumn(out, F.when(enough, F.nullif(F.sqrt(squares / F.nullif(n - 1, F.lit(0))), F.lit(0.0)))).drop(
            "_d", "_n", "_look", *[f"{c}_{p}" for c in ("_k", "_m", "_v", "_min") for p in ("a", "b")])
    else:
        vol = S.over_bars(diffs, lambda w: {out: S.rolling_std("_d", lookback, w, max(2, lookback // 2))}, before=lookback - 1)
        vol = vol.withColumn(out, F.nullif(F.col(out), F.lit(0.0))).drop("_d")
    if not backfill:
        return vol
    return _filled(vol, out)


def _shortened(n: Column, lookback: int) -> Column:
    return F.least(F.lit(lookback), F.greatest(F.lit(2), n))


def _filled(vol: DataFrame, out: str) -> DataFrame:
    """``out`` filled from later bars, then from earlier ones and with 1e-8."""
    turned = vol.withColumn("pos", -F.col("pos"))
    filled = S.running(turned, {"_back": ("last", out, True)}).withColumn("pos", -F.col("pos"))
    filled = S.running(filled, {"_fwd": ("last", "_back", True)})
    return filled.withColumn(out, F.coalesce("_fwd", F.lit(1e-8))).drop("_back", "_fwd")


def pooled_diff_vol(df: DataFrame, lookback: int, scale: int, out: str = "vol") -> DataFrame:
    """:func:`diff_vol` with both options where rows of several members share a name and a bar.

    Each row is paired with every row of the bar before, so a bar of ``k`` rows after one of ``m`` holds
    ``k * m`` differences.  They are not formed: a bar keeps count, sum and sum of squares of its prices,
    as integers (``close`` has at most ``scale`` decimals), and frames add those exactly.  Equal rows are
    one result row, whose own differences weigh once per equal row and pair, as a grouped self-join has it.
    """
    rows = cut_lineage(df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_g")))
    cents = F.round(F.col("close") * F.lit(10.0 ** scale)).cast("decimal(18,0)")
    whole = lambda c: c.cast("decimal(38,0)")
    g = F.when(F.col("_c").isNotNull(), F.col("_g"))
    cells = cut_lineage(rows.withColumn("_c", cents).groupBy("symbol", "pos").agg(
        F.sum(F.coalesce(g, F.lit(0))).alias("_k"), whole(F.sum(F.col("_c") * g)).alias("_x"),
        whole(F.sum(F.col("_c") * F.col("_c") * g)).alias("_xx"), F.min("_g").alias("_few"), F.max("_g").alias("_many")))
    looks = cells.groupBy("symbol").agg(_shortened(F.sum("_k"), lookback).alias("_look"))
    paired = S.over_bars(cells, lambda w: {"_p": S.at(F.struct("_k", "_x", "_xx"), -1, w)}, before=1)
    k, m = F.col("_k"), F.col("_p._k")
    paired = paired.join(looks, "symbol").select(
        "symbol", "pos", "_look", "_few", "_many", F.greatest(F.coalesce(m, F.lit(0)), F.lit(1)).alias("_m"), (k * m).alias("_n"),
        whole(m * F.col("_x") - k * F.col("_p._x")).alias("_s"),
        whole(whole(m * F.col("_xx")) - whole(2 * whole(F.col("_x") * F.col("_p._x"))) + whole(k * F.col("_p._xx"))).alias("_q"))
    ends = S.trailing_parts(paired, {c: (F.sum, c) for c in ("_n", "_s", "_q")}, "_look")
    n, s, q = (F.coalesce(F.col(f"{c}_a"), F.lit(0)) + F.coalesce(F.col(f"{c}_b"), F.lit(0)) for c in ("_n", "_s", "_q"))
    ends = ends.select("symbol", "pos", "_look", "_m", "_few", "_many", n.alias("_n"), (
        whole(whole(q) * n) - whole(whole(s) * whole(s))).cast("double").alias("_spread"))

    def deviation(times: Column) -> Column:
        count = times * F.col("_n")
        value = F.sqrt(times * F.col("_spread") / F.nullif(F.col("_n"), F.lit(0)) / F.nullif(count - 1, F.lit(0))) / F.lit(10.0 ** scale)
        return F.when(count >= F.greatest(F.lit(2), F.floor(F.col("_look") / 2)), F.nullif(value, F.lit(0.0)))

    # equal rows reach the least number of differences earlier; other bars fill from the first row that has it
    first = F.coalesce(deviation(F.col("_m") * F.col("_few")), deviation(F.col("_m") * F.col("_many")))
    filled = _filled(ends.withColumn("_dev", first).drop("_few", "_many"), "_dev")
    return rows.join(filled, ["symbol", "pos"]).withColumn(
        out, F.coalesce(deviation(F.col("_m") * F.col("_g")), "_dev")).select(*df.columns, out)


def ewmac(
    df: DataFrame,
    rules: Sequence[tuple[int, int]],
    vol_lookback: int,
    scalars: Mapping[tuple[int, int], float] | None = None,
    cap: float = CAP,
) -> DataFrame:
    """Crossover forecasts in long form: (fast mean - slow mean) / (return deviation * previous price).

    All means of all rules share one pass over the series; warm-up stays null.
    """
    if any(not 0 < fast < slow for fast, slow in rules):
        raise ValueError("a rule needs 0 < fast < slow")
    spans = sorted({s for rule in rules for s in rule})
    means = S.ewma(df, {f"_m{s}": ("close", s) for s in spans}, min_bars={f"_m{s}": s for s in spans})
    lagged = S.over_bars(means, lambda w: {
        "_prev": S.at("close", -1, w),
        "_ret": F.col("close") / F.nullif(S.at("close", -1, w), F.lit(0.0)) - 1}, before=1)
    risk = S.over_bars(lagged, lambda w: {
        "_risk": F.nullif(S.rolling_std("_ret", vol_lookback, w) * F.col("_prev"), F.lit(0.0))},
        before=vol_lookback - 1)
    return _long(risk, {
        f"ewmac_{f}_{s}": capped(
            (F.col(f"_m{f}") - F.col(f"_m{s}")) / F.col("_risk") * float((scalars or {}).get((f, s), 1.0)), cap)
        for f, s in rules})


def _long(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), v.cast("double").alias("value")) for n, v in values.items()])
    return df.select("ts", "symbol", "pos", F.explode(pairs).alias("_p")).select(
        "ts", "symbol", "pos", "_p.rule", "_p.value")


def ewmac_diff(df: DataFrame, rules: Sequence[tuple[int, int]], vol_lookback: int = 365) -> DataFrame:
    """The bot's crossover: weight-adjusted means over the deviation of price differences, uncapped."""
    spans = sorted({s for rule in rules for s in rule})
    means = S.ewma(df, {f"_m{s}": ("close", s) for s in spans}, adjust=True)
    diffs = S.over_bars(means, lambda w: {"_d": F.col("close") - S.at("close", -1, w)}, before=1)
    risk = S.over_bars(diffs, lambda w: {
        "_risk": F.nullif(S.rolling_std("_d", vol_lookback, w), F.lit(0.0))}, before=vol_lookback - 1)
    return _long(risk, {f"ewmac_{f}_{s}": (F.col(f"_m{f}") - F.col(f"_m{s}")) / F.col("_risk") for f, s in rules})


def _channel(df: DataFrame, horizons: Sequence[int], flat: float) -> DataFrame:
    """Location of the close in its trailing channel, +-20, one column ``_c{h}`` per horizon."""
    def build(w):
        out = {}
        for h in horizons:
            frame = S.trailing(w, h)
            high, low = F.max("close").over(frame), F.min("close").over(frame)
            ready = (F.count("close").over(frame) >= h) & (high - low > flat)
            out[f"_c{h}"] = F.when(ready, 40.0 * (F.col("close") - (high + low) / 2) / (high - low))
        return out
    return S.over_bars(df, build, before=max(horizons) - 1)


def breakout(df: DataFrame, horizons: Sequence[int], smooth_div: int = 4, cap: float = CAP,
             scalars: Mapping[int, float] | None = None) -> DataFrame:
    """Channel forecasts smoothed over a quarter of the horizon, scaled and capped."""
    raw = _channel(df, horizons, flat=1e-8)
    smooth = S.ewma(raw, {f"_s{h}": (f"_c{h}", max(1, h // smooth_div)) for h in horizons})
    return _long(smooth, {
        f"breakout_{h}": capped(F.col(f"_s{h}") * float((scalars or {}).get(h, 1.0)), cap) for h in horizons})


def breakout_raw(df: DataFrame, horizons: Sequence[int] = BREAKOUT_HORIZONS, cap: float = CAP) -> DataFrame:
    """Channel forecasts without smoothing, kept as a control."""
    raw = _channel(df, horizons, flat=0.0)
    return _long(raw, {f"breakout_{h}": capped(F.col(f"_c{h}"), cap) for h in horizons})


def rsi(df: DataFrame, n: int = 14) -> DataFrame:
    """Relative strength from simple means of up and down moves; all-up windows give 100."""
    moves = S.over_bars(df, lambda w: {"_d": F.col("close") - S.at("close", -1, w)}, before=1)
    parts = moves.withColumn("_u", F.when(F.col("_d").isNotNull(), F.greatest("_d", F.lit(0.0)))) \
        .withColumn("_v", F.when(F.col("_d").isNotNull(), F.greatest(-F.col("_d"), F.lit(0.0))))
    means = S.over_bars(parts, lambda w: {
        "_up": S.rolling_mean("_u", n, w), "_down": S.rolling_mean("_v", n, w)}, before=n - 1)
    value = F.when((F.col("_down") == 0) & (F.col("_up") > 0), F.lit(100.0)).otherwise(
        100 - 100 / (1 + F.col("_up") / F.nullif(F.col("_down"), F.lit(0.0))))
    return means.withColumn("rsi", value).drop("_d", "_u", "_v", "_up", "_down")


def pair_ratios(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Ratio series of ``pairs(pair)`` written ``A/B``; a malformed pair or an unknown leg is dropped."""
    legs = pairs.filter(F.size(F.split("pair", "/")) == 2).select(
        "pair", F.split_part("pair", F.lit("/"), F.lit(1)).alias("_a"),
        F.split_part("pair", F.lit("/"), F.lit(2)).alias("_b"))
    top = legs.join(df.select("ts", "pos", F.col("symbol").alias("_a"), F.col("close").alias("_x")), "_a")
    bottom = df.select("pos", F.col("symbol").alias("_b"), F.col("close").alias("_y"))
    both = top.join(bottom, ["_b", "pos"])
    return both.select("ts", F.col("pair").alias("symbol"), "pos", (
        F.col("_x") / F.nullif(F.col("_y"), F.lit(0.0))).alias("close"))


def bar_features(df: DataFrame, benchmark: str, *, volume_bars: int = 30, atr_bars: int = 14,
                 vol_bars: int = 30, regime_bars: int = 180, trend_span: int = 128, pivot: int = 3) -> DataFrame:
    """Context of each bar for the event study: rvol, imbalance, atr, vol, vol_high, bench_bull, trough, peak.

    Medians of the trailing frames are exact and bounded by the frame.  Troughs
    and peaks use bars on both sides and are evaluation targets only.
    """
    step = S.over_bars(df, lambda w: {
        "rvol": F.col("quote") / F.nullif(F.when(
            F.count("quote").over(w.rangeBetween(-volume_bars, -1)) >= volume_bars,
            F.percentile("quote", F.lit(0.5)).over(w.rangeBetween(-volume_bars, -1))), F.lit(0.0)),
        "imbalance": 2 * F.col("taker") / F.nullif(F.col("quote"), F.lit(0.0)) - 1,
        "_tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - S.at("close", -1, w)),
                          F.abs(F.col("low") - S.at("close", -1, w))),
        "_ret": F.col("close") / F.nullif(S.at("close", -1, w), F.lit(0.0)) - 1,
        "trough": _centred(w, pivot, F.min("close")),
        "peak": _centred(w, pivot, F.max("close")),
    }, before=max(volume_bars, pivot), after=pivot)
    rolled = S.over_bars(step, lambda w: {
        "atr": S.rolling_mean("_tr", atr_bars, w), "vol": S.rolling_std("_ret", vol_bars, w)},
        before=max(atr_bars, vol_bars) - 1)
    regime = S.over_bars(rolled, lambda w: {
        "vol_high": F.coalesce(F.col("vol") > F.when(
            F.count("vol").over(w.rangeBetween(-regime_bars, -1)) >= regime_bars,
            F.percentile("vol", F.lit(0.5)).over(w.rangeBetween(-regime_bars, -1))), F.lit(False))},
        before=regime_bars)
    bench = S.ewma(df.filter(F.col("symbol") == benchmark), {"_m": ("close", trend_span)}, adjust=True).select(
        "pos", (F.col("close") > F.col("_m")).alias("bench_bull"))
    return regime.join(bench, "pos", "left").drop("_tr", "_ret")


def _centred(w, reach: int, extreme: Column) -> Column:
    frame = w.rangeBetween(-reach, reach)
    return F.coalesce(
        (F.count("close").over(frame) >= 2 * reach + 1) & (F.col("close") == extreme.over(frame)), F.lit(False))


def rolling_beta(df: DataFrame, benchmark: str, n: int, value: str = "ret", out: str = "beta") -> DataFrame:
    """Trailing covariance with the benchmark over its variance; both windows have to be full."""
    bench = df.filter(F.col("symbol") == benchmark).select("symbol", "pos", F.col(value).alias("_b"))
    spread = S.over_bars(bench, lambda w: {"_var": F.nullif(S.full(
        "_b", n, w, F.var_samp("_b").over(S.trailing(w, n))), F.lit(0.0))}, before=n - 1).drop("symbol")
    paired = df.join(spread, "pos", "left")
    both = F.when(F.col(value).isNotNull() & F.col("_b").isNotNull(), F.lit(1))
    return S.over_bars(paired.withColumn("_both", both), lambda w: {
        out: F.when(F.count("_both").over(S.trailing(w, n)) >= n,
                    F.covar_samp(value, "_b").over(S.trailing(w, n))) / F.col("_var")},
        before=n - 1).drop("_b", "_var", "_both")


def ols_beta(df: DataFrame, benchmark: str, value: str = "ret") -> DataFrame:
    """Whole-sample slope of each symbol on the benchmark: symbol, beta, n."""
    bench = df.filter((F.col("symbol") == benchmark) & F.col(value).isNotNull()).select(
        "pos", F.col(value).alias("_b"))
    paired = df.filter(F.col(value).isNotNull()).join(bench, "pos")
    return paired.groupBy("symbol").agg(
        F.regr_slope(value, "_b").alias("beta"), F.count(F.lit(1)).alias("n"))


def ffill(df: DataFrame, value: str, out: str) -> DataFrame:
    """Last known value up to each row."""
    return S.running(df, {out: ("last", value, True)})
