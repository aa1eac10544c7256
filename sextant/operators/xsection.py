"""Cross-sections: ranks, weights and risk scaling across the symbols of one bar.

Totals of a bar are partial aggregates joined back, ranks are bucketed (see
:mod:`sextant.functions.spread`); no window is partitioned by the bar alone
except where a top-n filter cuts it before the shuffle.  Tables carry
(ts, symbol, pos, ...); weights are in column ``w``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions import series as S
from sextant.functions import spread as D
from sextant.session import cut_lineage

BAR = ("pos",)


def _ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or either is missing."""
    return F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))


def xs_percentile(df: DataFrame, value: str = "f", out: str = "p", by: Sequence[str] = BAR) -> DataFrame:
    """Percentile rank of each bar: average rank over the ranked count, nulls unranked."""
    return D.percentile_rank(df, by, value, out)


def normalised(df: DataFrame, x: Column, out: str = "w", by: Sequence[str] = BAR) -> DataFrame:
    """``x`` divided by the sum of its absolute values per bar."""
    return D.with_totals(df.withColumn("_x", x), by, _g=F.sum(F.abs("_x"))).withColumn(
        out, _ratio(F.col("_x"), F.col("_g"))).drop("_x", "_g")


def signed_norm(df: DataFrame, value: str = "f", out: str = "w", by: Sequence[str] = BAR) -> DataFrame:
    return normalised(df, F.col(value), out, by)


def rank_weights(df: DataFrame, p: str = "p", out: str = "w", by: Sequence[str] = BAR) -> DataFrame:
    """(percentile - 0.5) scaled to gross 1."""
    return normalised(df, F.col(p) - 0.5, out, by)


def dollar_neutral(df: DataFrame, p: str = "p", out: str = "w", by: Sequence[str] = BAR) -> DataFrame:
    """Percentiles less their mean, scaled to gross 1: the weights sum to zero."""
    return normalised(D.with_totals(df, by, _m=F.avg(p)), F.col(p) - F.col("_m"), out, by).drop("_m")


def _sides(df: DataFrame, long: Column, short: Column, out: str, by: Sequence[str]) -> DataFrame:
    """+0.5 shared by the longs and -0.5 shared by the shorts of each bar."""
    marked = df.withColumn("_l", F.coalesce(long, F.lit(False))).withColumn("_s", F.coalesce(short, F.lit(False)))
    marked = D.with_totals(marked, by, _nl=F.count_if("_l"), _ns=F.count_if("_s"))
    weight = F.when(F.col("_l"), 0.5 / F.col("_nl")).otherwise(0.0) - F.when(
        F.col("_s"), 0.5 / F.col("_ns")).otherwise(0.0)
    return marked.withColumn(out, weight).drop("_l", "_s", "_nl", "_ns")


def basket(df: DataFrame, fraction: float, p: str = "p", out: str = "w", by: Sequence[str] = BAR) -> DataFrame:
    """Equal long and short baskets of the top and bottom ``fraction``."""
    if not 0.0 < fraction < 0.5:
        raise ValueError("fraction must be between zero and one half")
    return _sides(df, F.col(p) >= 1.0 - fraction, F.col(p) <= fraction, out, by)


def long_only(df: DataFrame, fraction: float, p: str = "p", f: str = "f", out: str = "w",
              by: Sequence[str] = BAR) -> DataFrame:
    """Equal weights of the top ``fraction`` with a positive forecast."""
    chosen = F.coalesce((F.col(p) >= 1.0 - fraction) & (F.col(f) > 0), F.lit(False))
    marked = D.with_totals(df.withColumn("_l", chosen), by, _n=F.count_if("_l"))
    return marked.withColumn(out, F.when(F.col("_l"), 1.0 / F.col("_n")).otherwise(0.0)).drop("_l", "_n")


def buffered_basket(df: DataFrame, fraction: float, buffer: float, p: str = "p", out: str = "w",
                    keys: Sequence[str] = ("symbol",), by: Sequence[str] = BAR) -> DataFrame:
    """Baskets with memory: enter at ``fraction``, stay until ``fraction + buffer``.

    Entering implies staying, so membership is the last event of the series: an
    entry, a row outside the band, or a bar without a rank (also an absent one).
    """
    rank = F.col(p)
    seen = S.over_bars(df, lambda w: {"_gone": S.at(F.lit(1), -1, w).isNull()}, before=1, keys=keys)

    def event(enter: Column, keep: Column) -> Column:
        kept = F.coalesce(keep, F.lit(False)) & ~F.col("_gone")
        return F.when(F.coalesce(enter, F.lit(False)), F.lit(1)).when(~kept, F.lit(0))

    marked = seen.withColumn("_el", event(rank >= 1 - fraction, rank >= 1 - fraction - buffer)).withColumn(
        "_es", event(rank <= fraction, rank <= fraction + buffer))
    state = S.running(marked, {"_sl": ("last", "_el", True), "_ss": ("last", "_es", True)}, keys=keys)
    return _sides(state, F.col("_sl") == 1, F.col("_ss") == 1, out, by).drop("_gone", "_el", "_es", "_sl", "_ss")


def rank_buffer(desired: DataFrame, previous: DataFrame, buffer: float, p: str = "p") -> DataFrame:
    """Keep the previous weight while its side has not crossed the outer percentile."""
    if buffer <= 0:
        return desired
    prior = previous.select("pos", "symbol", F.col("w").alias("_prev"))
    joined = desired.join(prior, ["pos", "symbol"], "left")
    stay = ((F.col("_prev") > 0) & (F.col(p) >= buffer)) | ((F.col("_prev") < 0) & (F.col(p) <= 1.0 - buffer))
    return joined.withColumn("w", F.when(stay, F.col("_prev")).otherwise(F.col("w"))).drop("_prev")


def residualize(df: DataFrame, benchmark: str, f: str = "f", beta: str = "beta", out: str = "f") -> DataFrame:
    """Forecast less beta times the benchmark's forecast of the same bar."""
    bench = df.filter(F.col("symbol") == benchmark).select("pos", F.col(f).alias("_b"))
    return df.join(bench, "pos", "left").withColumn(out, F.col(f) - F.col(beta) * F.col("_b")).drop("_b")


def beta_neutral(df: DataFrame, gross_cap: float = 1.0, w: str = "w", beta: str = "beta",
                 out: str = "w", by: Sequence[str] = BAR) -> DataFrame:
    """Weights projected away from beta, gross at most ``gross_cap``."""
    x = df.withColumn("_w", F.coalesce(F.col(w), F.lit(0.0))).withColumn("_z", F.coalesce(F.col(beta), F.lit(0.0)))
    x = D.with_totals(x, by, _wz=F.sum(F.col("_w") * F.col("_z")), _zz=F.sum(F.col("_z") * F.col("_z")))
    x = x.withColumn("_v", F.when(
        F.col("_zz") > 0, F.col("_w") - F.col("_z") * F.col("_wz") / F.col("_zz")).otherwise(F.col("_w")))
    x = D.with_totals(x, by, _g=F.sum(F.abs("_v")))
    scale = F.when(F.col("_g") > 0, F.least(F.lit(float(gross_cap)), F.col("_g")) / F.col("_g")).otherwise(F.lit(1.0))
    return x.withColumn(out, F.col("_v") * scale).drop("_w", "_z", "_wz", "_zz", "_v", "_g")


def beta_hedge(df: DataFrame, benchmark: str, w: str = "w", beta: str = "beta") -> DataFrame:
    """Offset the weighted beta of each bar with the benchmark, then gross 1.

    A bar without a benchmark row gets one.  Input and output: (ts, symbol, pos, w).
    """
    base = df.select("ts", "symbol", "pos", F.coalesce(F.col(w), F.lit(0.0)).alias("w"), F.col(beta).alias("_z"))
    bars = base.groupBy("ts", "pos").agg(
        F.coalesce(F.sum(F.col("w") * F.col("_z")), F.lit(0.0)).alias("_b"),
        F.coalesce(F.nullif(F.max(F.when(F.col("symbol") == benchmark, F.col("_z"))), F.lit(0.0)),
                   F.lit(1.0)).alias("_bb"))
    hedge = bars.select("ts", F.lit(benchmark).alias("symbol"), "pos", (-F.col("_b") / F.col("_bb")).alias("w"))
    both = base.drop("_z").unionByName(hedge).groupBy("ts", "symbol", "pos").agg(F.sum("w").alias("w"))
    return signed_norm(both, "w")


def cap_budget(df: DataFrame, cap: float | str, raw: str = "raw", out: str = "budget",
               by: Sequence[str] = BAR, smallest: float | None = None) -> DataFrame:
    """Absolute weights as shares of the bar, none above max(cap, 1 / active rows).

    ``cap`` may name a column of ``by`` whose values are ``smallest`` or more.
    """
    x = df.withColumn("_a", F.coalesce(F.abs(F.col(raw)), F.lit(0.0)))
    return D.capped_shares(x, by, "_a", cap, out, widen=True, smallest=smallest).drop("_a")


def predicted_vol(units: DataFrame, returns: DataFrame, lookback: int, column: str = "unit",
                  keys: Sequence[str] = ()) -> DataFrame:
    """Trailing annualised deviation of what the previous bar's units earned: (keys, pos, predicted).

    The previous bar is reached by shifting its number in the join key.  Bars
    without an earning row count as zero, before the first full window is null.
    """
    earlier = units.select(*keys, (F.col("pos") + 1).alias("pos"), "symbol", F.col(column).alias("_u"))
    earned = earlier.join(returns.select("pos", "symbol", "ret"), ["pos", "symbol"]).groupBy(*keys, "pos").agg(
        F.sum(F.col("_u") * F.coalesce(F.col("ret"), F.lit(0.0))).alias("_e"))
    bars = units.select(*keys, "pos").distinct()
    daily = bars.join(earned, [*keys, "pos"], "left").withColumn("_e", F.coalesce("_e", F.lit(0.0)))
    return S.over_bars(daily, lambda w: {
        "predicted": S.rolling_std("_e", lookback, w) * math.sqrt(365)}, before=lookback - 1, keys=keys
    ).select(*keys, "pos", "predicted")


def inverse_vol_units(df: DataFrame, cap: float, raw: str = "raw", vol: str = "vol",
                      by: Sequence[str] = BAR) -> DataFrame:
    """Signed capped risk budgets over volatility in ``unit``; no volatility gives 0."""
    shares = cap_budget(df, cap, raw, "_share", by)
    signed = F.signum(F.coalesce(F.col(raw), F.lit(0.0))) * F.col("_share")
    return shares.withColumn("unit", F.when(F.col(vol) > 0, signed / F.col(vol)).otherwise(F.lit(0.0))).drop("_share")


def risk_unit(df: DataFrame, cap: float, lookback: int, raw: str = "raw", vol: str = "vol",
              returns: DataFrame | None = None) -> DataFrame:
    """Unit-risk weights in ``unit``: inverse-vol budgets over their predicted volatility.

    With ``returns`` (pos, symbol, ret) the prediction is the trailing deviation
    of what the units earned, otherwise the root sum of squares of unit x vol.
    """
    units = inverse_vol_units(df, cap, raw, vol)
    if returns is None:
        sized = D.with_totals(units, BAR, predicted=F.sqrt(F.sum(
            F.pow(F.col("unit") * F.coalesce(F.col(vol), F.lit(0.0)), F.lit(2.0)))))
    else:
        sized = units.join(predicted_vol(units, returns, lookback), "pos", "left")
    unit = F.when(F.col("predicted") > 0, F.col("unit") / F.col("predicted")).otherwise(F.lit(0.0))
    return sized.withColumn("unit", unit).drop("predicted")


def scale_to_target(df: DataFrame, target: float, gross_cap: float, unit: str = "unit", out: str = "w",
                    by: Sequence[str] = BAR) -> DataFrame:
    """Unit weights times min(target, gross cap / gross) per bar."""
    x = D.with_totals(df, by, _g=F.sum(F.abs(unit)))
    m = F.least(F.lit(float(target)), F.coalesce(
        F.lit(float(gross_cap)) / F.nullif(F.col("_g"), F.lit(0.0)), F.lit(float(target))))
    return x.withColumn(out, F.col(unit) * m).drop("_g")


def apply_membership(df: DataFrame, membership: DataFrame, value: str) -> DataFrame:
    """Null ``value`` outside the membership (pos, symbol, member); unknown means outside."""
    joined = df.join(membership.select("pos", "symbol", F.col("member").alias("_m")), ["pos", "symbol"], "left")
    return joined.withColumn(value, F.when(F.coalesce("_m", F.lit(False)), F.col(value))).drop("_m")


def construct_sleeve(df: DataFrame, sleeve: str, *, cap: float, lookback: int, target: float, gross_cap: float,
                     fraction: float = 0.2, membership: DataFrame | None = None) -> DataFrame:
    """Target weights of one sleeve from (ts, symbol, pos, f, vol, ret).

    ``time_series`` uses forecast / 20; ``continuous``, ``basket`` and
    ``long_only`` use the percentile of the forecast among the members.
    """
    x = df if membership is None else apply_membership(df, membership, "f")
    if sleeve == "time_series":
        raw = x.withColumn("raw", F.col("f") / 20.0)
    else:
        ranked = xs_percentile(x)
        makers = {
            "continuous": lambda d: rank_weights(d, out="raw"),
            "basket": lambda d: basket(d, fraction, out="raw"),
            "long_only": lambda d: long_only(d, fraction, out="raw"),
        }
        if sleeve not in makers:
            raise ValueError(f"unknown sleeve {sleeve!r}")
        raw = makers[sleeve](ranked)
    units = risk_unit(raw, cap, lookback, returns=df)
    return scale_to_target(units, target, gross_cap)


def constructions(df: DataFrame, benchmark: str, *, buffers: bool = True) -> DataFrame:
    """All weight constructions of one forecast: (ts, symbol, pos, construction, w).

    Input (ts, symbol, pos, f, beta).  The ranked forecasts are checkpointed, since
    eleven constructions read them.
    """
    ranked = cut_lineage(xs_percentile(df))
    neutral = dollar_neutral(ranked)
    residual = dollar_neutral(xs_percentile(residualize(ranked, benchmark)))
    parts = {
        "signed_unhedged": signed_norm(ranked),
        "dollar_neutral": neutral,
        "basket_10": basket(ranked, 0.10),
        "basket_20": basket(ranked, 0.20),
        "basket_30": basket(ranked, 0.30),
        "long_only_20": long_only(ranked, 0.20),
        "bench_hedged": beta_hedge(neutral, benchmark),
        "beta_constrained": beta_neutral(neutral),
        "bench_residualized": residual,
    }
    if buffers:
        parts["basket20_buffer5"] = buffered_basket(ranked, 0.20, 0.05)
        parts["basket20_buffer10"] = buffered_basket(ranked, 0.20, 0.10)
    out = None
    for name, part in parts.items():
        rows = part.select("ts", "symbol", "pos", F.lit(name).alias("construction"), "w")
        out = rows if out is None else out.unionByName(rows)
    return out


def benchmark_weights(df: DataFrame, kind: str, *, benchmark: str = "", fdv: DataFrame | None = None,
                      seed: int = 0) -> DataFrame:
    """Reference weights over the rows with a close: buy_hold, equal, fdv, no_skill or random_sign.

    ``no_skill`` alternates signs by the order of the symbols, ``random_sign``
    draws a fair sign per cell from a hash, so it does not depend on partitions.
    """
    live = F.when(F.col("close").isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0))
    if kind == "buy_hold":
        return df.withColumn("w", F.when(F.col("symbol") == benchmark, live).otherwise(F.lit(0.0)))
    if kind == "equal":
        return normalised(df, live)
    if kind == "fdv":
        sized = df.join(fdv.select("symbol", F.col("fdv").alias("_v")), "symbol", "left")
        return normalised(sized, live * F.coalesce("_v", F.lit(0.0))).drop("_v")
    if kind == "no_skill":
        order = D.symbol_order(df)
        return normalised(df.join(order, "symbol"), live * F.when(F.col("_i") % 2 == 0, 1.0).otherwise(-1.0)).drop("_i")
    if kind == "random_sign":
        digits = F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "symbol")), 1, 8)
        coin = F.conv(digits, 16, 10).cast("bigint") % 2
        return normalised(df, live * F.when(coin == 0, 1.0).otherwise(-1.0))
    raise ValueError(f"unknown benchmark {kind!r}")


def equal_risk_ensemble(held: DataFrame, target: float = 0.20, gross_cap: float = 3.0, ticker_cap: float = 0.40,
                        by: Sequence[str] = BAR) -> DataFrame:
    """Mean of held / selected target over all strategies of a bar, scaled, gross and ticker capped.

    ``held`` is (ts, symbol, pos, strategy, held, target_vol); a strategy without a
    row for a cell counts as zero.
    """
    strategies = held.groupBy(*[c for c in by if c != "pos"]).agg(F.countDistinct("strategy").alias("_n"))
    summed = held.groupBy("ts", "symbol", *by).agg(F.sum(F.col("held") / F.col("target_vol")).alias("_s"))
    extra = [c for c in by if c != "pos"]
    mean = (summed.join(strategies, extra) if extra else summed.crossJoin(strategies)).withColumn(
        "_u", F.col("_s") / F.col("_n") * target)
    x = D.with_totals(mean, by, _g=F.sum(F.abs("_u")))
    m = F.least(F.lit(1.0), F.coalesce(gross_cap / F.nullif(F.col("_g"), F.lit(0.0)), F.lit(0.0)))
    w = F.greatest(F.least(F.col("_u") * m, F.lit(ticker_cap)), F.lit(-ticker_cap))
    return x.withColumn("w", w).drop("_s", "_n", "_u", "_g")


def sleeve_blend(a: DataFrame, b: DataFrame, returns: DataFrame, lookback: int) -> DataFrame:
    """Half and half of two unit portfolios, renormalised to unit predicted volatility."""
    x = a.select("ts", "symbol", "pos", F.col("unit").alias("_a")).join(
        b.select("ts", "symbol", "pos", F.col("unit").alias("_b")), ["ts", "symbol", "pos"], "full")
    half = x.withColumn("unit", (F.coalesce("_a", F.lit(0.0)) + F.coalesce("_b", F.lit(0.0))) / 2).drop("_a", "_b")
    sized = half.join(predicted_vol(half, returns, lookback), "pos", "left")
    return sized.withColumn("unit", F.when(
        F.col("predicted") > 0, F.col("unit") / F.col("predicted")).otherwise(F.lit(0.0))).drop("predicted")


def average_of_norms(a: DataFrame, b: DataFrame, value: str = "w") -> DataFrame:
    """Average of two sleeves, each scaled to gross 1 per bar."""
    x = signed_norm(a, value, "_a").select("ts", "symbol", "pos", "_a").join(
        signed_norm(b, value, "_b").select("ts", "symbol", "pos", "_b"), ["ts", "symbol", "pos"], "full")
    return x.withColumn("w", (F.coalesce("_a", F.lit(0.0)) + F.coalesce("_b", F.lit(0.0))) / 2).drop("_a", "_b")


def topn_long_short(df: DataFrame, n_long: int, n_short: int, f: str = "f", vol: str = "vol") -> DataFrame:
    """The strongest positive and negative forecasts of a bar, inverse-vol weighted, 0.5 per side.

    The row_number filters are pushed below the shuffle, so a bar never gathers
    more than n rows per task and side.
    """
    sides = []
    for sign, n in ((1.0, n_long), (-1.0, n_short)):
        strength = F.col(f) * sign
        order = Window.partitionBy("pos").orderBy(F.desc("_k"), "symbol")
        side = df.filter(strength > 0).withColumn("_k", strength).withColumn(
            "_n", F.row_number().over(order)).filter(F.col("_n") <= n)
        inv = 1.0 / F.coalesce(F.nullif(F.col(vol), F.lit(0.0)), F.lit(0.0001))
        side = D.with_totals(side.withColumn("_i", inv), BAR, _t=F.sum("_i"))
        sides.append(side.withColumn("w", F.lit(0.5 * sign) * F.col("_i") / F.col("_t")).drop("_k", "_n", "_i", "_t"))
    return sides[0].unionByName(sides[1])
