"""Pooled calibration of rules and combination of their forecasts.

Forecasts are long: (ts, symbol, pos, rule, value).  Refits are a small table
(refit, start): a refit at bar ``refit`` uses bars start <= pos < refit and is
active from the next bar.  History rows are aggregated once per segment between
refits (:mod:`sextant.operators.refits`), and refits merge those aggregates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions import series as S
from sextant.functions import spread as D
from sextant.functions.stats import safe_corr
from sextant.operators import refits as R
from sextant.operators.signals import capped, legacy_cap
from sextant.session import cut_lineage

TARGET_FORECAST = 10.0


def _scalar(median: Column, fallback: Column | float = 1.0) -> Column:
    return F.coalesce(TARGET_FORECAST / F.nullif(median, F.lit(0.0)), F.lit(fallback))


def pooled_scalars(fc: DataFrame, by: Sequence[str] = ("rule",)) -> DataFrame:
    """10 over the median absolute forecast of all symbols and bars; none or zero gives 1."""
    medians = D.quantiles(fc.withColumn("_a", F.abs("value")), by, "_a", {"_m": 0.5})
    groups = fc.select(*by).distinct()
    return groups.join(medians, list(by), "left").select(*by, _scalar(F.col("_m")).alias("scalar"))


def calibrated_scalars(fc: DataFrame, fallback: DataFrame) -> DataFrame:
    """10 over the median of per-symbol mean absolute forecasts, else the value of ``fallback`` (rule, scalar)."""
    means = fc.groupBy("symbol", "rule").agg(F.avg(F.abs("value")).alias("_a")).filter(F.col("_a") > 0)
    medians = D.quantiles(means, ["rule"], "_a", {"_m": 0.5})
    default = fallback.select("rule", F.col("scalar").alias("_f"))
    return fc.select("rule").distinct().join(medians, "rule", "left").join(default, "rule", "left").select(
        "rule", _scalar(F.col("_m"), F.col("_f")).alias("scalar"))


def rule_pnl(fc: DataFrame, returns: DataFrame, lag: int) -> DataFrame:
    """Forecast / 10 times the return ``lag`` bars later, null where either is missing."""
    later = returns.select("symbol", (F.col("pos") - lag).alias("pos"), F.col("ret").alias("_r"))
    return fc.join(later, ["symbol", "pos"], "left").withColumn("pnl", F.col("value") / 10.0 * F.col("_r")).drop("_r")


def pooled_rule_scores(fc: DataFrame, returns: DataFrame, lag: int = 1, by: Sequence[str] = ("rule",)) -> DataFrame:
    """Median over symbols of max(mean / deviation of the rule's P&L, 0); no spread scores 0."""
    return _scores(rule_pnl(fc, returns, lag), by)


def _scores(pnl: DataFrame, by: Sequence[str]) -> DataFrame:
    each = pnl.groupBy("symbol", *by).agg(F.avg("pnl").alias("_m"), F.stddev_samp("pnl").alias("_s"))
    each = each.withColumn("_score", F.when(F.col("_s") > 0, F.greatest(F.col("_m") / F.col("_s"), F.lit(0.0))).otherwise(F.lit(0.0)))
    return D.quantiles(each, by, "_score", {"score": 0.5})


def future_returns(px: DataFrame, horizon: int, value: str = "close", out: str = "future") -> DataFrame:
    """Return of ``value`` over the next ``horizon`` bars: (symbol, pos, future)."""
    later = px.select("symbol", (F.col("pos") - horizon).alias("pos"), F.col(value).alias("_l"))
    return px.select("symbol", "pos", value).join(later, ["symbol", "pos"]).select(
        "symbol", "pos", (F.col("_l") / F.nullif(F.col(value), F.lit(0.0)) - 1).alias(out))


def rank_ic(fc: DataFrame, px: DataFrame, horizons: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """Spearman correlation per bar with later returns, ranked on complete pairs: (keys, pos, horizon, ic)."""
    out = None
    for h in horizons:
        pairs = fc.join(future_returns(px, h), ["symbol", "pos"]).filter(
            F.col("value").isNotNull() & F.col("future").isNotNull())
        by = [*keys, "pos"]
        ranked = D.rank_within(D.rank_within(pairs, by, "value", "_rf"), by, "future", "_rr")
        part = ranked.groupBy(*by).agg(safe_corr("_rf", "_rr").alias("ic")).withColumn("horizon", F.lit(h))
        out = part if out is None else out.unionByName(part)
    return out


def mean_rank_ic(fc: DataFrame, px: DataFrame, horizons: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """Rank IC per bar averaged over the horizons that have one."""
    return rank_ic(fc, px, horizons, keys).groupBy(*keys, "pos").agg(F.avg("ic").alias("ic"))


def pooled_ic_scores(fc: DataFrame, px: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Mean over horizons of the mean rank IC of each rule, at least 0."""
    each = rank_ic(fc, px, horizons, ["rule"]).groupBy("rule", "horizon").agg(F.avg("ic").alias("_m"))
    return each.groupBy("rule").agg(F.coalesce(F.greatest(F.avg("_m"), F.lit(0.0)), F.lit(0.0)).alias("score"))


def row_corr(a: DataFrame, b: DataFrame, min_n: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """Correlation per bar of percentile ranks taken inside each panel before pairing.

    ``a``: (keys, symbol, pos, value), ``b``: (symbol, pos, future).  Needs ``min_n`` pairs.
    """
    ra = D.percentile_rank(a, [*keys, "pos"], "value", "_ra").select(*keys, "symbol", "pos", "_ra")
    rb = D.percentile_rank(b, ["pos"], "future", "_rb").select("symbol", "pos", "_rb")
    pairs = ra.join(rb, ["symbol", "pos"]).filter(F.col("_ra").isNotNull() & F.col("_rb").isNotNull())
    return pairs.groupBy(*keys, "pos").agg(
        F.when(F.count(F.lit(1)) >= min_n, safe_corr("_ra", "_rb")).alias("ic"))


def shrink_cap(weights: DataFrame, shrink: float, cap: float, by: Sequence[str] = (), raw: str = "weight") -> DataFrame:
    """Weights (by, rule, weight) shrunk to equal and projected on the simplex capped at ``cap``."""
    if not 0.0 <= shrink <= 1.0:
        raise ValueError("shrink must be in [0, 1]")
    x = F.col(raw)
    clean = F.when(x.isNull() | F.isnan(x) | (x == float("inf")), F.lit(0.0)).otherwise(F.greatest(x, F.lit(0.0)))
    t = D.with_totals(weights.withColumn("_w", clean), by, _s=F.sum("_w"), _n=F.count(F.lit(1)))
    equal = 1.0 / F.col("_n")
    share = F.when(F.col("_s") > 0, F.col("_w") / F.col("_s")).otherwise(equal)
    t = t.withColumn("_v", (1.0 - shrink) * share + shrink * equal)
    return D.capped_shares(t, by, "_v", cap, "weight").drop("_w", "_s", "_n", "_v")


def _wide(fc: DataFrame, rules: Sequence[str], keys: Sequence[str] = ("symbol", "pos")) -> DataFrame:
    return fc.groupBy(*keys).pivot("rule", list(rules)).agg(F.first("value"))


def _corr_table(wide: DataFrame, rules: Sequence[str], by: Sequence[str], column=F.col) -> DataFrame:
    """Pearson correlation per rule pair over complete pairs: (by, a, b, corr), null as 0, diagonal 1."""
    cols = {r: column(r) for r in rules}
    aggs = [safe_corr(cols[a], cols[b]).alias(f"_{i}")
            for i, (a, b) in enumerate(combinations(rules, 2))]
    table = wide.groupBy(*by).agg(*aggs, F.count(F.lit(1)).alias("_n"))
    return _cells(table.filter(F.col("_n") > 0), rules, by)


def _cells(table: DataFrame, rules: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Both halves and the diagonal of a matrix from columns ``_0``, ``_1``, ... of its pairs."""
    cells = [F.struct(F.lit(r).alias("a"), F.lit(r).alias("b"), F.lit(1.0).alias("corr")) for r in rules]
    for i, (a, b) in enumerate(combinations(rules, 2)):
        c = F.coalesce(F.col(f"_{i}"), F.lit(0.0)).alias("corr")
        cells += [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), c), F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), c)]
    return table.select(*by, F.explode(F.array(*cells)).alias("_c")).select(
        *by, "_c.a", "_c.b", "_c.corr")


def rule_corr(fc: DataFrame, rules: Sequence[str]) -> DataFrame:
    """Correlation of rules pooled over all symbols; rules become columns, so no rows are paired."""
    return _corr_table(_wide(fc, rules), rules, [])


def avg_ticker_corr(fc: DataFrame, rules: Sequence[str], least: int = 20) -> DataFrame:
    """Mean of the per-symbol correlations over complete rows, floored at 0.

    A pair undefined for one symbol is 0 altogether, as a sum of matrices has it.
    """
    complete = _wide(fc, rules).dropna(subset=list(rules))
    pairs = list(combinations(rules, 2))
    each = complete.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"), *[
        safe_corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)]).filter(F.col("_n") >= least)
    table = each.agg(*[F.when(F.count_if(F.col(f"_{i}").isNull()) == 0, F.avg(f"_{i}")).alias(f"_{i}")
                       for i in range(len(pairs))])
    cells = [F.struct(F.lit(r).alias("a"), F.lit(r).alias("b"), F.lit(1.0).alias("corr")) for r in rules]
    for i, (a, b) in enumerate(pairs):
        c = F.greatest(F.coalesce(F.col(f"_{i}"), F.lit(0.0)), F.lit(0.0)).alias("corr")
        cells += [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), c), F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), c)]
    return table.select(F.inline(F.array(*cells)))


def fdm(weights: DataFrame, corr: DataFrame, cap: float = 2.5, by: Sequence[str] = ()) -> DataFrame:
    """Diversification multiplier min(1 / sqrt(w'Cw), cap), 1 without variance: (by, fdm)."""
    wa = weights.select(*by, F.col("rule").alias("a"), F.col("weight").alias("_wa"))
    wb = weights.select(*by, F.col("rule").alias("b"), F.col("weight").alias("_wb"))
    v = corr.join(wa, [*by, "a"]).join(wb, [*by, "b"]).groupBy(*by).agg(
        F.sum(F.col("_wa") * F.col("_wb") * F.col("corr")).alias("_v"))
    return v.select(*by, F.when(F.col("_v") > 0, F.least(1.0 / F.sqrt("_v"), F.lit(float(cap)))).otherwise(F.lit(1.0)).alias("fdm"))


def refit_dates(calendar: DataFrame, schedule: str, least: int = 365, history_days: int | None = None) -> DataFrame:
    """Refit bars with at least ``least`` earlier bars: (refit, refit_ts, activation, start).

    Starts of quarters, of every second quarter from the first, or of years;
    ``frozen`` keeps the first only.  ``start`` is the first bar of the trailing
    ``history_days`` or of the calendar.
    """
    months = {"quarterly": 3, "semiannual": 3, "annual": 12, "frozen": 12}
    if schedule not in months:
        raise ValueError(f"unsupported schedule {schedule!r}")
    unit = "quarter" if months[schedule] == 3 else "year"
    ends = calendar.agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"), F.min("pos").alias("_p"), F.max("pos").alias("_last"))
    begin = F.trunc(F.to_date("_a"), unit)
    stamps = ends.select("_p", "_last", "_a", F.posexplode(F.filter(
        F.sequence(begin, F.to_date("_b"), F.make_ym_interval(F.lit(0), F.lit(months[schedule]))),
        lambda d: d.cast("timestamp_ntz") >= F.col("_a"))).alias("_i", "_d"))
    if schedule == "semiannual":
        stamps = stamps.filter(F.col("_i") % 2 == 0)
    # the first bar at or after the stamp
    found = stamps.join(calendar.select("pos", "ts"), F.col("ts") >= F.col("_d").cast("timestamp_ntz")).groupBy(
        "_d", "_p", "_last").agg(F.min("pos").alias("refit"), F.min("ts").alias("refit_ts"))
    good = found.filter(F.col("refit") - F.col("_p") >= least)
    if schedule == "frozen":
        good = good.orderBy("_d").limit(1)
    out = good.withColumn("activation", F.least(F.col("refit") + 1, F.col("_last")))
    if history_days is None:
        out = out.withColumn("start", F.col("_p"))
    else:
        back = out.select("refit", (F.col("refit_ts") - F.make_dt_interval(F.lit(history_days))).alias("_from"))
        starts = back.join(calendar.select("pos", "ts"), F.col("ts") >= F.col("_from")).groupBy("refit").agg(
            F.min("pos").alias("start"))
        out = out.join(starts, "refit")
    return out.select("refit", "refit_ts", "activation", "start")


def calibration_path(fc: DataFrame, returns: DataFrame, refits: DataFrame, rules: Sequence[str], *, shrink: float,
                     cap: float, lag: int = 2, cap_fdm: float = 2.5, cap_forecast: float = 20.0,
                     fixed_scalars: Mapping[str, float] | None = None, fit_weights: bool = True) -> DataFrame:
    """Scalar, weight and multiplier of every refit: (refit, rule, scalar, weight, fdm).

    At each refit, on the rows before it only: scalars from pooled medians,
    scores from the capped scaled forecast times the return ``lag`` bars later,
    weights shrunk and capped, and the multiplier from the pooled correlation.
    Rows are aggregated per segment of the calendar between refits, not per refit.
    The forecasts, the refit table and the fitted scalars and weights are
    checkpointed: each feeds several of these steps.
    """
    fc, histories = cut_lineage(fc), R.Histories(refits, [lag])
    # one row per refit and rule: kept in one partition, so the steps below need no exchange
    if fixed_scalars is None:
        found = R.medians(fc, histories, F.abs("value"), "_m")
        every = histories.cover().select("refit").distinct().select("refit", F.explode(F.array(*[F.lit(r) for r in rules])).alias("rule"))
        scalars = every.join(found, ["refit", "rule"], "left").select("refit", "rule", _scalar(F.col("_m")).alias("scalar"))
    else:
        table = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(float(s)).alias("scalar")) for r, s in fixed_scalars.items()])
        scalars = refits.select("refit", F.inline(table))
    scalars = cut_lineage(scalars.coalesce(1))
    if fit_weights:
        # the paired return has to be known before the refit; the cap needs the refit's own scalar
        later = returns.select("symbol", (F.col("pos") - lag).alias("pos"), "ret")
        outcomes = fc.select("symbol", "rule", "pos", "value").join(later, ["symbol", "pos"], "left")
        scores = R.scores(outcomes, histories, scalars, cap_forecast, lag).withColumnRenamed("score", "weight")
    else:
        present = histories.of(fc).select("rule", "seg").distinct().join(histories.cover(), "seg").select("refit", "rule").distinct()
        scores = scalars.join(present, ["refit", "rule"]).select("refit", "rule", F.lit(1.0).alias("weight"))
    weights = cut_lineage(shrink_cap(cut_lineage(scores.coalesce(1)), shrink, cap, ["refit"]).select("refit", "rule", "weight"))
    corr = _history_corr(fc, histories, rules, scalars, cap_forecast).coalesce(1)
    multiplier = fdm(weights, corr, cap_fdm, ["refit"])
    return scalars.join(weights, ["refit", "rule"]).join(multiplier, "refit").select("refit", "rule", "scalar", "weight", "fdm")


def history_corr(fc: DataFrame, refits: DataFrame, rules: Sequence[str], scalars: DataFrame,
                 cap: float = 20.0) -> DataFrame:
    """Pooled correlation of the capped scaled forecasts before each refit: (refit, a, b, corr)."""
    return _history_corr(fc, R.Histories(refits), rules, scalars, cap)


def _history_corr(fc: DataFrame, histories: R.Histories, rules: Sequence[str], scalars: DataFrame, cap: float) -> DataFrame:
    table = R.rule_corrs(_wide(fc, rules), histories, scalars, rules, cap)
    return _cells(table.select("refit", *[F.get("corrs", F.lit(i)).alias(f"_{i}") for i in range(len(rules) * (len(rules) - 1) // 2)]),
                  rules, ["refit"])


def step_path(steps: DataFrame, calendar: DataFrame, refits: DataFrame, values: Mapping[str, float],
              keys: Sequence[str] = ("rule",), smooth: int = 1, normalise: str | None = None) -> DataFrame:
    """Refit values on every bar from their activation on: (keys, pos, ts, values).

    Before the first activation the default of ``values`` holds; smoothing is an
    exponential mean along the calendar, after which ``normalise`` sums to 1 per bar.
    """
    active = steps.join(refits.select("refit", "activation"), "refit").select(
        *keys, F.col("activation").alias("pos"), *values)
    latest = active.groupBy(*keys, "pos").agg(*[F.last(v).alias(v) for v in values])
    bars = calendar.crossJoin(steps.select(*keys).distinct()) if keys else calendar
    path = bars.join(latest, [*keys, "pos"], "left")
    path = S.running(path, {v: ("last", v, True) for v in values}, keys=keys)
    path = path.select(*keys, "pos", "ts", *[F.coalesce(v, F.lit(float(d))).alias(v) for v, d in values.items()])
    if smooth > 1:
        path = S.ewma(path.select(*keys, "pos", "ts", *[F.col(v).alias(f"_{v}") for v in values]),
                      {v: (f"_{v}", smooth) for v in values}, keys=keys).select(*keys, "pos", "ts", *values)
    if normalise:
        path = D.with_totals(path, ["pos"], _t=F.sum(normalise)).withColumn(
            normalise, F.col(normalise) / F.col("_t")).drop("_t")
    return path


def ic_weights(fc: DataFrame, px: DataFrame, refits: DataFrame, calendar: DataFrame, rules: Sequence[str],
               horizons: Sequence[int], *, value: str = "open", shrink: float = 0.8, cap: float = 0.25,
               smooth: int = 125, min_n: int = 5) -> DataFrame:
    """Rule weights from floored mean rank correlations with later open returns: (rule, pos, ts, weight).

    A bar counts only if its outcome of ``h + 1`` bars ended before the refit.  The
    daily correlations are computed once; refits average that small table.
    """
    fc, refits = cut_lineage(fc), cut_lineage(refits)
    following = px.select("symbol", (F.col("pos") - 1).alias("pos"), F.col(value).alias("_next"))
    scores, histories = None, R.Histories(refits, [h + 1 for h in horizons])
    for h in horizons:
        ahead = future_returns(following.withColumnRenamed("_next", "close"), h)
        daily = row_corr(fc, ahead, min_n, ["rule"])
        part = R.means(daily, histories, h + 1, "ic", ["rule"], "ic")
        scores = part if scores is None else scores.unionByName(part)
    table = F.array(*[F.lit(r) for r in rules])
    every = refits.select("refit", F.explode(table).alias("rule"))
    mean = every.join(scores.groupBy("refit", "rule").agg(F.avg("ic").alias("_m")), ["refit", "rule"], "left")
    raw = mean.withColumn("weight", F.greatest(F.coalesce("_m", F.lit(0.0)), F.lit(0.0))).drop("_m")
    fitted = cut_lineage(shrink_cap(cut_lineage(raw), shrink, cap, ["refit"]))
    return step_path(fitted, calendar, refits, {"weight": 1.0 / len(rules)}, smooth=smooth, normalise="weight")


def eligibility(vol: DataFrame, costs: DataFrame, refits: DataFrame, turnover: Mapping[str, float], *,
                budget: float = 0.15, taker_share: float = 1.0, slippage_bps: float = 5.0) -> DataFrame:
    """Is each rule affordable for each symbol at each refit, with the numbers and the reason.

    A rule is usable if its expected turnover is at most budget / (cost rate /
    annual volatility of the bar before the refit).  ``vol``: (symbol, pos, vol);
    ``costs``: (symbol, maker, taker).
    """
    cells = refits.select("refit", "refit_ts", "activation").crossJoin(costs)
    prior = vol.select("symbol", (F.col("pos") + 1).alias("refit"), "vol")
    x = cells.join(prior, ["symbol", "refit"], "left")
    rate = F.col("maker") * (1 - taker_share) + F.col("taker") * taker_share + slippage_bps / 10_000.0
    x = x.withColumn("_rate", rate).withColumn("cost_sr", F.when(F.col("vol") > 0, rate / F.col("vol")))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(float(t)).alias("expected_turnover")) for r, t in turnover.items()])
    x = x.select("refit", "refit_ts", "activation", "symbol", "_rate", "cost_sr", F.inline(rules))
    free = F.col("_rate") <= 0
    limit = F.when(F.col("cost_sr") > 0, budget / F.col("cost_sr")).otherwise(F.lit(0.0))
    usable = free | (F.col("expected_turnover") <= limit)
    return x.withColumn("maximum_turnover", F.when(~free, limit)).withColumn("eligible", usable).withColumn(
        "reason", F.when(usable, "within_cost_budget").otherwise("exceeds_cost_budget")).drop("_rate")


def eligibility_daily(records: DataFrame, calendar: DataFrame) -> DataFrame:
    """Eligibility on every bar from its activation on, before it none: (symbol, rule, pos, eligible)."""
    latest = records.groupBy("symbol", "rule", F.col("activation").alias("pos")).agg(
        F.max_by("eligible", "refit").alias("_e"))
    bars = calendar.crossJoin(records.select("symbol", "rule").distinct())
    path = S.running(bars.join(latest, ["symbol", "rule", "pos"], "left"), {"_e": ("last", "_e", True)}, keys=("symbol", "rule"))
    return path.select("symbol", "rule", "pos", F.coalesce("_e", F.lit(False)).alias("eligible"))


def combine(fc: DataFrame, weights: DataFrame, on: Sequence[str] = ("rule",), cap: float = 20.0,
            keys: Sequence[str] = ()) -> DataFrame:
    """Weighted mean of the available rules times the multiplier: (keys, ts, symbol, pos, f).

    ``weights`` holds ``weight`` and optionally ``scalar`` and ``fdm`` per ``on``.
    """
    x = fc.join(weights, list(on))
    value = capped(F.col("value") * F.col("scalar"), cap) if "scalar" in weights.columns else F.col("value")
    dm = F.max("fdm") if "fdm" in weights.columns else F.lit(1.0)
    # few rules meet in a cell; they are added in a fixed order, so equal reruns rank alike
    terms = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(
        *on, (value * F.col("weight")).alias("_p"), F.col("weight").cast("double").alias("_w")))))

    def add(field: str) -> Column:
        return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + F.coalesce(t[field], F.lit(0.0)))

    g = x.groupBy(*keys, "ts", "symbol", "pos").agg((add("_p") / F.nullif(add("_w"), F.lit(0.0)) * dm).alias("_f"))
    return g.withColumn("f", capped(F.col("_f"), cap)).drop("_f")


def combine_eligible(fc: DataFrame, params: DataFrame, corr: DataFrame, eligible: DataFrame, rules: Sequence[str], *,
                     fixed_fdm: float | None = None, cap_fdm: float = 2.5) -> DataFrame:
    """Combination over the usable rules with a multiplier per cell: (ts, symbol, pos, f, fdm), f / 20.

    ``params``: (rule, pos, scalar, weight), ``corr``: (pos, a, b, corr).  Weights are
    renormalised over the active rules; a single one has multiplier 1, none gives 0.
    """
    x = fc.join(params.select("rule", "pos", "scalar", "weight"), ["rule", "pos"]).join(
        eligible.select("symbol", "rule", "pos", "eligible"), ["symbol", "rule", "pos"], "left")
    scaled = capped(F.col("value") * F.col("scalar"))
    active = F.coalesce("eligible", F.lit(False)) & scaled.isNotNull()
    x = x.withColumn("_v", F.when(active, scaled)).withColumn("_w", F.when(active, F.col("weight")))
    wide = x.groupBy("ts", "symbol", "pos").pivot("rule", list(rules)).agg(F.first("_v").alias("v"), F.first("_w").alias("w"))
    w = {r: F.coalesce(F.col(f"{r}_w"), F.lit(0.0)) for r in rules}
    total = sum(w.values(), F.lit(0.0))
    count = sum((F.col(f"{r}_v").isNotNull().cast("int") for r in rules), F.lit(0))
    share = {r: F.when(total > 0, w[r] / total).otherwise(F.lit(0.0)) for r in rules}
    mean = sum((F.coalesce(F.col(f"{r}_v"), F.lit(0.0)) * share[r] for r in rules), F.lit(0.0))
    if fixed_fdm is None:
        pairs = list(combinations(rules, 2))
        flat = corr.groupBy("pos").agg(*[F.max(F.when((F.col("a") == a) & (F.col("b") == b), F.col("corr"))).alias(f"_c{i}")
                                         for i, (a, b) in enumerate(pairs)])
        wide = wide.join(flat, "pos", "left")
        var = sum((share[r] * share[r] for r in rules), F.lit(0.0))
        for i, (a, b) in enumerate(pairs):
            var = var + 2 * share[a] * share[b] * F.coalesce(F.col(f"_c{i}"), F.lit(0.0))
        dm = F.greatest(F.least(F.when(var > 0, 1.0 / F.sqrt(var)).otherwise(F.lit(1.0)), F.lit(cap_fdm)), F.lit(1.0))
    else:
        dm = F.when(count > 1, F.lit(float(fixed_fdm))).otherwise(F.lit(1.0))
    out = wide.withColumn("fdm", dm)
    return out.select("ts", "symbol", "pos", F.when(count > 0, capped(mean * F.col("fdm"))).otherwise(
        F.lit(0.0)).alias("_f"), "fdm").withColumn("f", F.col("_f") / 20.0).drop("_f")


def combine_fixed(fc: DataFrame, weights: DataFrame, fdm_value: float, cap: bool = True) -> DataFrame:
    """The bot's dot product: missing forecasts count as 0, weights are not renormalised."""
    x = fc.join(weights.select("rule", "weight"), "rule").groupBy("ts", "symbol", "pos").agg(
        (F.sum(F.coalesce("value", F.lit(0.0)) * F.col("weight")) * fdm_value).alias("f"))
    return x.withColumn("f", capped(F.col("f"))) if cap else x


def weights_or_equal(params: DataFrame, n_rules: int) -> DataFrame:
    """Normalised weight arrays where complete, finite and positive in sum, else equal: (..., weights, fallback)."""
    w = F.col("weights")
    finite = F.forall(w, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    total = F.aggregate(w, F.lit(0.0), lambda a, v: a + v)
    good = F.coalesce((F.size(w) == n_rules) & finite & (total > 0), F.lit(False))
    equal = F.array_repeat(F.lit(1.0 / n_rules), n_rules)
    return params.withColumn("fallback", ~good).withColumn(
        "weights", F.when(good, F.transform(w, lambda v: v / total)).otherwise(equal))


def reference_forecasts(fc: DataFrame, mode: str, weights: DataFrame | None = None) -> DataFrame:
    """Comparable models: equal weights, pooled (rule, pos) weights, or per_symbol (symbol, rule) weights."""
    if mode == "equal":
        return combine(fc, fc.select("rule").distinct().withColumn("weight", F.lit(1.0)))
    if mode == "pooled":
        return combine(fc, weights.select("rule", "pos", "weight"), ("rule", "pos"))
    if mode == "per_symbol":
        return combine(fc, weights.select("symbol", "rule", "weight"), ("symbol", "rule"))
    raise ValueError(f"unknown mode {mode!r}")


def forecast_blend(a: DataFrame, b: DataFrame, refits: DataFrame, calendar: DataFrame, cap_fdm: float = 2.5) -> DataFrame:
    """Half and half of two forecasts (ts, symbol, pos, f) times their causal pairwise multiplier, over 20."""
    x = a.select("ts", "symbol", "pos", F.col("f").alias("_a")).join(
        b.select("symbol", "pos", F.col("f").alias("_b")), ["symbol", "pos"])
    c = R.pair_corr(x.select("pos", F.col("_a").alias("a"), F.col("_b").alias("b")), R.Histories(refits))
    c = refits.select("refit").join(c, "refit", "left").withColumn("corr", F.coalesce("corr", F.lit(0.0)))
    path = step_path(c, calendar, refits, {"corr": 0.0}, keys=())
    var = 0.5 + 0.5 * F.col("corr")
    dm = F.greatest(F.least(F.when(var > 0, 1.0 / F.sqrt(var)).otherwise(F.lit(1.0)), F.lit(cap_fdm)), F.lit(1.0))
    return x.join(path.select("pos", dm.alias("fdm")), "pos").select(
        "ts", "symbol", "pos", (capped((F.col("_a") + F.col("_b")) / 2 * F.col("fdm")) / 20.0).alias("f"))


def ensemble_trials(trials: DataFrame, share: float) -> DataFrame:
    """Mean of the normalised weights of the best share of trials: (rule position, weight, score).

    ``trials``: (trial, objective to minimise, weights array).  Rank and selection
    go through bucket counts; at least one trial is kept.
    """
    good = trials.filter(F.col("objective").isNotNull() & ~F.isnan("objective"))
    ranked = D.rank_within(good, [], "objective", "_k", how="row", ties=["trial"], count_as="_n")
    top = ranked.filter(F.col("_k") <= F.greatest(F.lit(1), F.floor(F.col("_n") * min(max(share, 0.0), 1.0))))
    total = F.aggregate("weights", F.lit(0.0), lambda a, v: a + v)
    norm = F.when(total > 0, F.transform("weights", lambda v: v / total)).otherwise(
        F.transform("weights", lambda v: 1.0 / F.size("weights")))
    flat = top.select("objective", F.posexplode(norm).alias("rule", "_w"))
    mean = flat.groupBy("rule").agg(F.avg("_w").alias("_m"), (-F.avg("objective")).alias("score"), F.count(F.lit(1)).alias("trials"))
    return D.with_totals(mean, [], _t=F.sum("_m")).select(
        "rule", (F.col("_m") / F.col("_t")).alias("weight"), "score", "trials")


def mean_rule_signal(fc: DataFrame, scalars: DataFrame, multiplier: float = 1.12) -> DataFrame:
    """Mean of the legacy-capped scaled rules times a fixed multiplier; missing forecasts turn to +20 there."""
    x = fc.join(scalars.select("rule", "scalar"), "rule").groupBy("ts", "symbol", "pos").agg(
        (F.avg(legacy_cap(F.col("value") * F.col("scalar"))) * multiplier).alias("f"))
    return x.withColumn("f", F.coalesce("f", F.lit(0.0)))
