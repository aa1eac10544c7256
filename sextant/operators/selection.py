"""Walk-forward folds, grid scoring, selection and study tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions import series as S
from sextant.functions import spread as D
from sextant.functions import timeaxis as T
from sextant.functions.dedupe import keep_first, keep_last
from sextant.functions.stats import safe_corr
from sextant.operators import metrics as M
from sextant.operators.accounting import activation_map, position_state
from sextant.operators.quality import config_id, coverage_stats, quality_flag
from sextant.session import cut_lineage


def numbered(df: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Row number ``rn`` from 0 along each series and its row count ``n``."""
    x = S.running(df, {"rn": ("count", F.lit(1), False)}, keys=keys)
    return D.with_totals(x, list(keys), n=F.count(F.lit(1)))


def train_oos_split(df: DataFrame, fraction: float | None = None, periods: int | None = None,
                    keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Adds ``part`` train or oos: the last ``periods`` rows or ``fraction`` of them, never all."""
    x = numbered(df, keys)
    if periods:
        size = F.least(F.lit(periods), F.col("n") - 1)
    elif fraction:
        size = F.least(F.greatest(F.lit(1), F.floor(F.col("n") * fraction)), F.col("n") - 1)
    else:
        size = F.lit(0)
    return x.withColumn("part", F.when(F.col("rn") >= F.col("n") - size, "oos").otherwise("train")).drop("rn", "n")


def fold_table(calendar: DataFrame, first_year: int, last_year: int, history_days: int | None = None) -> DataFrame:
    """Annual outer folds with their cutoff and selection window (expanding after a year, or trailing)."""
    ends = calendar.agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    x = ends.select("_a", "_b", F.explode(F.sequence(F.lit(first_year), F.lit(last_year))).alias("_y"))
    first = F.make_date("_y", F.lit(1), F.lit(1)).cast("timestamp_ntz")
    x = x.withColumn("test_start", first).filter(F.col("test_start") <= F.col("_b"))
    last = F.make_date("_y", F.lit(12), F.lit(31)).cast("timestamp_ntz")
    x = x.withColumn("test_end", F.least(last, F.col("_b"))).withColumn("cutoff", F.col("test_start") - F.expr("INTERVAL 1 DAY"))
    year_on = F.col("_a") + F.expr("INTERVAL 365 DAY")
    if history_days is None:
        start = year_on
    else:
        start = F.greatest(year_on, F.col("cutoff") - F.make_dt_interval(F.lit(history_days - 1)))
    name = F.when(F.col("test_end") < last, F.concat(F.col("_y").cast("string"), F.lit("_ytd"))).otherwise(F.col("_y").cast("string"))
    return x.select(name.alias("fold"), "cutoff", "test_start", "test_end", start.alias("select_start"))


def wf_windows(df: DataFrame, train: int, test: int, step: int, mode: str = "rolling",
               keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Test rows of every walk-forward window: (keys, ts, window, train_from, train_to, ...).

    Window k trains on the rows before ``train + k * step`` (the last ``train`` of them
    when rolling) and tests on the next ``test`` rows, as long as all of them exist.
    """
    step = max(1, step)
    x = numbered(df, keys).filter(F.col("rn") >= train)
    newest = F.floor((F.col("n") - train - test) / step)
    hi = F.least(F.floor((F.col("rn") - train) / step), newest)
    lo = F.greatest(F.lit(0), F.ceil((F.col("rn") - train - test + 1) / step))
    x = x.withColumn("_lo", lo).withColumn("_hi", hi).filter(F.col("_lo") <= F.col("_hi"))
    x = x.withColumn("window", F.explode(F.sequence(F.col("_lo").cast("bigint"), F.col("_hi").cast("bigint"))))
    to = train + F.col("window") * step
    since = F.greatest(F.lit(0), to - train) if mode == "rolling" else F.lit(0).cast("bigint")
    return x.withColumn("train_from", since).withColumn("train_to", to - 1).drop("_lo", "_hi", "rn", "n")


def stitch_windows(rows: DataFrame, keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """One row per key, the latest window wins where tests overlap."""
    return keep_last(rows, list(keys), "window")


def _grid(grid: Sequence[tuple[float, float]]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("_g"), F.lit(float(t)).alias("target_vol"), F.lit(float(c)).alias("gross_cap"))
                     for i, (t, c) in enumerate(grid)])


def grid_daily(units: DataFrame, calendar: DataFrame, returns: DataFrame, grid: Sequence[tuple[float, float]],
               frequencies: Sequence[str], *, funding: DataFrame | None = None, taker: DataFrame | None = None,
               default_taker: float = 0.0004, slippage_bps: float = 5.0, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Net return and turnover per bar of every (keys, frequency, target, gross cap).

    The holding of a bar is ``m * unit`` of its source bar with ``m = min(target,
    cap / gross)``, so return and funding are summed over symbols once and scaled
    per grid point.  Only trades need the grid per symbol: they are evaluated as
    one aggregate column per grid point, on activation bars alone, and no
    exploded row is ever shuffled.
    """
    unit = cut_lineage(units.filter(F.col("unit") != 0).select(*keys, "symbol", "pos", "unit"))
    gross = unit.groupBy(*keys, "pos").agg(F.sum(F.abs("unit")).alias("gross"))
    sources = None
    for freq in frequencies:
        part = activation_map(calendar, freq).withColumn("rebalance", F.lit(freq))
        sources = part if sources is None else sources.unionByName(part)
    before = sources.select("rebalance", (F.col("pos") + 1).alias("pos"), F.col("source").alias("before"))
    sources = cut_lineage(sources.join(before, ["rebalance", "pos"], "left"))

    # sums over symbols, linear in m: current holding x return and same-day funding, previous x midnight funding
    flow = returns.select("symbol", "pos", "ret")
    if funding is not None:
        flow = flow.join(funding.select("symbol", "pos", "same", "midnight"), ["symbol", "pos"], "full")
    else:
        flow = flow.withColumn("same", F.lit(0.0)).withColumn("midnight", F.lit(0.0))
    zero = F.lit(0.0)
    now = unit.withColumnRenamed("pos", "source").join(sources.select("rebalance", "pos", "source"), "source").join(
        flow, ["symbol", "pos"]).groupBy(*keys, "rebalance", "pos").agg(
        F.sum(F.col("unit") * (F.coalesce("ret", zero) + F.coalesce("same", zero))).alias("_now"))
    then = unit.withColumnRenamed("pos", "before").join(sources.select("rebalance", "pos", "before"), "before").join(
        flow, ["symbol", "pos"]).groupBy(*keys, "rebalance", "pos").agg(
        F.sum(F.col("unit") * F.coalesce("midnight", zero)).alias("_then"))

    # trades on activation bars: both unit vectors of a cell meet in one row
    moves = sources.filter(F.col("before").isNull() | (F.col("before") != F.col("source")))
    a = unit.withColumnRenamed("pos", "source").join(moves.select("rebalance", "pos", "source"), "source").select(
        *keys, "rebalance", "pos", "symbol", F.col("unit").alias("_a"), zero.alias("_b"))
    b = unit.withColumnRenamed("pos", "before").join(moves.select("rebalance", "pos", "before"), "before").select(
        *keys, "rebalance", "pos", "symbol", zero.alias("_a"), F.col("unit").alias("_b"))
    cells = a.unionByName(b).groupBy(*keys, "rebalance", "pos", "symbol").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    ga = gross.select(*keys, F.col("pos").alias("source"), F.col("gross").alias("_ga"))
    gb = gross.select(*keys, F.col("pos").alias("before"), F.col("gross").alias("_gb"))
    cells = cells.join(moves, ["rebalance", "pos"]).join(ga, [*keys, "source"], "left").join(gb, [*keys, "before"], "left")
    if taker is None:
        cells = cells.withColumn("_t", F.lit(default_taker))
    else:
        cells = cells.join(taker.select("symbol", F.col("taker").alias("_t")), "symbol", "left").withColumn(
            "_t", F.coalesce("_t", F.lit(default_taker)))

    def m(target: Column | float, cap: Column | float, g: str) -> Column:
        return F.coalesce(F.least(F.lit(target), F.lit(cap) / F.nullif(F.col(g), zero)), F.lit(target))

    aggs = []
    for i, (target, cap) in enumerate(grid):
        trade = F.abs(m(float(target), float(cap), "_ga") * F.col("_a") - m(float(target), float(cap), "_gb") * F.col("_b"))
        aggs += [F.sum(trade).alias(f"_v{i}"), F.sum(trade * F.col("_t")).alias(f"_f{i}")]
    traded = cells.groupBy(*keys, "rebalance", "pos").agg(*aggs)
    packed = traded.select(*keys, "rebalance", "pos", F.array(*[
        F.struct(F.col(f"_v{i}").alias("v"), F.col(f"_f{i}").alias("f")) for i in range(len(grid))]).alias("_trades"))

    bars = sources.crossJoin(unit.select(*keys).distinct())
    x = bars.join(now, [*keys, "rebalance", "pos"], "left").join(then, [*keys, "rebalance", "pos"], "left").join(
        packed, [*keys, "rebalance", "pos"], "left").join(ga, [*keys, "source"], "left").join(gb, [*keys, "before"], "left")
    x = x.withColumn("_p", F.explode(_grid(grid)))
    target, cap = F.col("_p.target_vol"), F.col("_p.gross_cap")
    mine = F.try_element_at("_trades", F.col("_p._g") + 1)
    turnover = F.coalesce(mine["v"], zero)
    linear = m(target, cap, "_ga") * F.coalesce("_now", zero) + m(target, cap, "_gb") * F.coalesce("_then", zero)
    return x.select(*keys, "rebalance", target.alias("target_vol"), cap.alias("gross_cap"), "ts", "pos",
                    (linear - F.coalesce(mine["f"], zero) - turnover * (slippage_bps / 10_000.0)).alias("net"),
                    turnover.alias("turnover"))


def held_of_configs(units: DataFrame, calendar: DataFrame, configs: DataFrame, frequencies: Sequence[str],
                    keys: Sequence[str] = ("model",)) -> DataFrame:
    """Holdings of the given configurations alone: (config_id, ts, symbol, pos, held).

    ``configs`` has config_id, the keys, rebalance, target_vol and gross_cap; the rest of the
    grid is never positioned.
    """
    unit = units.filter(F.col("unit") != 0).select(*keys, "symbol", "pos", "unit")
    gross = unit.groupBy(*keys, "pos").agg(F.sum(F.abs("unit")).alias("_g"))
    sources = None
    for freq in frequencies:
        part = activation_map(calendar, freq).withColumn("rebalance", F.lit(freq))
        sources = part if sources is None else sources.unionByName(part)
    wanted = configs.select("config_id", *keys, "rebalance", "target_vol", "gross_cap").distinct()
    m = F.least(F.col("target_vol"), F.col("gross_cap") / F.col("_g"))
    scaled = unit.join(gross, [*keys, "pos"]).join(wanted, list(keys)).select(
        "config_id", "rebalance", "symbol", F.col("pos").alias("source"), (F.col("unit") * m).alias("held"))
    return scaled.join(sources, ["rebalance", "source"]).select("config_id", "ts", "symbol", "pos", "held")


def score_grid(daily: DataFrame, folds: DataFrame, config: Sequence[str], least: int = 180) -> DataFrame:
    """Selection score of each configuration in each fold's window, with its deterministic id."""
    window = (F.col("ts") >= F.col("select_start")) & (F.col("ts") <= F.col("cutoff"))
    rows = daily.join(folds.select("fold", "select_start", "cutoff"), window)
    scores = M.search_score(rows, [*config, "fold"], least)
    return scores.withColumn("config_id", config_id(list(config)))


def cost_grid(contrib: DataFrame, taker_shares: Sequence[float], slippages: Sequence[float], *, maker: float = 0.0002,
              taker: float = 0.0004, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Daily net returns under every taker share and slippage: (keys, taker_share, slippage_bps, ts, pos, net, turnover).

    Costs are linear in turnover, so symbols are summed once and the grid meets
    only the daily rows.  ``contrib`` is the output of ``asset_contribution``.
    """
    daily = contrib.groupBy(*keys, "ts", "pos").agg(
        F.sum(F.col("gross") + F.col("funding")).alias("_g"), F.sum("trade").alias("turnover"))
    points = F.array(*[F.struct(F.lit(float(t)).alias("taker_share"), F.lit(float(s)).alias("slippage_bps"))
                       for t in taker_shares for s in slippages])
    x = daily.select("*", F.inline(points))
    rate = F.col("taker_share") * taker + (1 - F.col("taker_share")) * maker + F.col("slippage_bps") / 10_000.0
    return x.select(*keys, "taker_share", "slippage_bps", "ts", "pos", (F.col("_g") - F.col("turnover") * rate).alias("net"), "turnover")


def delay_funding(held: DataFrame, calendar: DataFrame, coef: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Funding of next-close activation: the funding position lags the holding by one bar."""
    late = held.withColumn("pos", F.col("pos") + 1).drop("ts")
    x = position_state(late, calendar, keys).join(coef.select("pos", "symbol", "same", "midnight"), ["pos", "symbol"])
    return x.groupBy(*keys, "ts", "pos").agg(
        F.sum(F.col("held") * F.col("same") + F.col("prev") * F.col("midnight")).alias("funding"))


def _preference(sharpe: str, turnover: str) -> Column:
    """Ordering of configurations: Sharpe down (missing last), turnover, gross cap, target, id."""
    return F.struct(F.col(sharpe).isNull(), -F.col(sharpe), F.col(turnover), F.col("gross_cap"), F.col("target_vol"), F.col("config_id"))


def select_rosters(scores: DataFrame, k: int = 3, group: Sequence[str] = ("variant", "fold", "family"),
                   sharpe: str = "selection_net_sharpe", turnover: str = "selection_annual_turnover") -> DataFrame:
    """Best configuration of each model, ranked per group; the first ``k`` are selected."""
    scored = scores.filter(F.col(sharpe).isNotNull())
    best = keep_first(scored, [*group, "model"], _preference(sharpe, turnover))
    order = Window.partitionBy(*group).orderBy(_preference(sharpe, turnover))
    ranked = best.withColumn("rank", F.row_number().over(order))
    chosen = F.col("rank") <= k
    return ranked.withColumn("selected", chosen).withColumn(
        "selection_reason", F.when(chosen, f"top_{k}_distinct_models").otherwise(f"below_top_{k}"))


def select_best(configs: DataFrame, sharpe: str = "validation_net_sharpe", turnover: str = "validation_annual_turnover") -> DataFrame:
    """Best headline configuration of each family: taker 1, 5 bps, next open, not a static reference."""
    ok = (F.coalesce("taker_share", F.lit(1.0)) == 1.0) & (F.coalesce("slippage_bps", F.lit(5.0)) == 5.0) & (
        F.coalesce("activation", F.lit("next_open")) == "next_open") & ~F.coalesce(
        F.col("optimization_scope").startswith("legacy_static"), F.lit(False)) & F.col(sharpe).isNotNull()
    return keep_first(configs.filter(ok), ["family"], _preference(sharpe, turnover))


def stitch_oos(held: DataFrame, rosters: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows of each fold's selected configurations inside its test span: (..., fold, rank, family).

    ``held``: config_id, ts, symbol, pos, held; ``rosters``: fold, family, rank, config_id, target_vol, selected.
    """
    chosen = rosters.filter("selected").select("fold", "family", "rank", "config_id", "target_vol").join(
        folds.select("fold", "test_start", "test_end"), "fold")
    inside = (F.col("h.config_id") == F.col("c.config_id")) & (F.col("ts") >= F.col("test_start")) & (F.col("ts") <= F.col("test_end"))
    return held.alias("h").join(chosen.alias("c"), inside).select(
        "fold", "family", "rank", "c.config_id", "target_vol", "ts", "symbol", "pos", "held")


def stitch_ensembles(stitched: DataFrame, rosters: DataFrame, target: float = 0.20, gross_cap: float = 3.0,
                     ticker_cap: float = 0.40) -> DataFrame:
    """Stitched strategies (fold, strategy, ts, symbol, pos, held): roster slots, an ensemble per family, their even mix.

    An ensemble is the mean of held / selected target over the family's selected models, at the
    common target, with gross and ticker caps; a model without a row for a cell counts as zero.
    """
    models = rosters.filter("selected").groupBy("fold", "family").agg(F.count(F.lit(1)).alias("_n"))
    cells = stitched.groupBy("fold", "family", "ts", "symbol", "pos").agg(F.sum(F.col("held") / F.col("target_vol")).alias("_s"))
    mean = cells.join(models, ["fold", "family"]).withColumn("_u", F.col("_s") / F.col("_n") * target)
    x = D.with_totals(mean, ["fold", "family", "pos"], _g=F.sum(F.abs("_u")))
    scale = F.least(F.lit(1.0), F.coalesce(gross_cap / F.nullif(F.col("_g"), F.lit(0.0)), F.lit(0.0)))
    x = x.withColumn("held", F.greatest(F.least(F.col("_u") * scale, F.lit(ticker_cap)), F.lit(-ticker_cap)))
    cell = ("ts", "symbol", "pos", "held")
    families = models.groupBy("fold").agg(F.count(F.lit(1)).alias("_f"))
    even = x.join(families, "fold").groupBy("fold", "ts", "symbol", "pos").agg((F.sum("held") / F.max("_f")).alias("held"))
    slots = stitched.select("fold", F.concat_ws("_", "family", F.lit("slot"), F.col("rank").cast("string")).alias("strategy"), *cell)
    return slots.unionByName(x.select("fold", F.concat_ws("_", "family", F.lit("ensemble")).alias("strategy"), *cell)).unionByName(
        even.select("fold", F.lit("combined").alias("strategy"), *cell))


def window_report(series: DataFrame, weights: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Return, Sharpe, drawdown, turnover and dominant rule of each refit window.

    ``series``: keys, ts, pos, net, turnover; ``weights``: keys, refit_ts, rule, weight.  A
    window runs to the next refit.
    """
    top = weights.groupBy(*keys, "refit_ts").agg(F.max_by("rule", F.struct("weight", F.col("rule"))).alias("dominant"))
    top = top.withColumn("pos", T.epoch_second(F.col("refit_ts")))
    turned = S.running(top.withColumn("pos", -F.col("pos")), {"next_refit": ("last", "refit_ts", False)}, keys=keys,
                       block=366 * T.DAY).drop("pos")
    inside = [series[k] == turned[k] for k in keys]
    joined = series.join(turned, (inside[0] if inside else F.lit(True)) & (series["ts"] >= turned["refit_ts"]) & (
        turned["next_refit"].isNull() | (series["ts"] < turned["next_refit"])))
    rows = joined.select(*[series[k] for k in keys], "refit_ts", "dominant", "ts", "pos", "net", "turnover")
    by = [*keys, "refit_ts", "dominant"]
    stats = M.series_metrics(rows, by=by).select(*by, "total_return", "sharpe", "max_drawdown")
    more = rows.groupBy(*by).agg(F.min("ts").alias("test_start"), F.max("ts").alias("test_end"), F.sum("turnover").alias("turnover"))
    return more.join(stats, by, "left")


def universe_summary(metrics: DataFrame, series: DataFrame, status: DataFrame, prices: DataFrame, value: float) -> DataFrame:
    """One row per symbol: static and walk-forward metrics, deltas, exposure, coverage, score and flag.

    ``metrics``: symbol, source (oos, wfo), sharpe, total_return, max_drawdown;
    ``series``: symbol, position, turnover, total_cost; ``status``: symbol, wfo_status, wfo_windows.
    """
    def side(source: str, prefix: str) -> DataFrame:
        return metrics.filter(F.col("source") == source).select("symbol", *[
            F.col(c).alias(f"{prefix}_{c}") for c in ("sharpe", "total_return", "max_drawdown")])

    x = status.join(side("oos", "static"), "symbol", "left").join(side("wfo", "wfo"), "symbol", "left")
    x = x.join(M.exposure_stats(series, value), "symbol", "left").join(coverage_stats(prices), "symbol", "left")
    w = {c: F.col(f"wfo_{c}") for c in ("sharpe", "total_return", "max_drawdown")}
    x = x.withColumn("sharpe_delta", w["sharpe"] - F.col("static_sharpe")).withColumn(
        "return_delta", w["total_return"] - F.col("static_total_return")).withColumn(
        "return_over_mdd", w["total_return"] / F.nullif(F.abs(w["max_drawdown"]), F.lit(0.0)))
    score = w["sharpe"] + 0.5 * w["total_return"] - F.abs(w["max_drawdown"]) - 0.1 * F.col("cost_drag")
    x = x.withColumn("robust_score", F.when(F.col("wfo_status") == "success", score))
    return x.withColumn("quality_flag", quality_flag(
        F.col("wfo_status"), F.col("wfo_windows"), w["max_drawdown"], F.col("max_gap_days"), F.col("days_stale"), F.col("symbol")))


def filter_summary(summary: DataFrame, status: str = "all", min_windows: int = 0, search: str | None = None,
                   sort_by: str = "wfo_sharpe") -> DataFrame:
    """Summary rows by status, windows and substring, sorted with missing values last."""
    x = summary
    if status == "success":
        x = x.filter(F.col("wfo_status") == "success")
    elif status == "skipped":
        x = x.filter(F.col("wfo_status") == "skipped_insufficient_data")
    if min_windows > 0:
        x = x.filter((F.col("wfo_status") != "success") | (F.col("wfo_windows") >= min_windows))
    if search:
        x = x.filter(F.contains(F.upper("symbol"), F.lit(search.upper())))
    if sort_by not in x.columns:
        return x
    up = sort_by in ("wfo_max_drawdown", "cost_drag")
    return x.orderBy(F.asc_nulls_last(sort_by) if up else F.desc_nulls_last(sort_by), "symbol")


def roster_churn(selection: DataFrame) -> DataFrame:
    """Selected models per family and fold: how many stay from the fold before and how many are new.

    ``selection``: family, fold, cutoff, model, selected.
    """
    chosen = selection.filter("selected").select("family", "fold", "cutoff", "model").distinct()
    folds = chosen.select("family", "fold", "cutoff").distinct()
    order = Window.partitionBy("family").orderBy("cutoff")
    folds = folds.withColumn("_prior", F.lag("fold").over(order))
    earlier = chosen.select("family", F.col("fold").alias("_prior"), "model", F.lit(1).alias("_was"))
    x = chosen.join(folds.select("family", "fold", "_prior"), ["family", "fold"]).join(earlier, ["family", "_prior", "model"], "left")
    return x.groupBy("family", "fold").agg(
        F.when(F.max("_prior").isNotNull(), F.count("_was")).alias("retained"),
        (F.count(F.lit(1)) - F.count("_was")).alias("new"), F.count(F.lit(1)).alias("roster_size"))


def family_robustness(selection: DataFrame) -> DataFrame:
    """Per family: models, median validation and holdout Sharpe, positive share, rank correlation, the selected one."""
    v, h = "validation_net_sharpe", "holdout_net_sharpe"
    base = selection.groupBy("family").agg(
        F.count(F.lit(1)).alias("models"), F.avg(F.coalesce(F.col(h) > 0, F.lit(False)).cast("double")).alias("positive_holdout_share"),
        F.max(F.when(F.col("selected"), F.col(h))).alias("selected_holdout"))
    mv = D.quantiles(selection, ["family"], v, {"median_validation": 0.5})
    mh = D.quantiles(selection, ["family"], h, {"median_holdout": 0.5})
    pairs = selection.filter(F.col(v).isNotNull() & F.col(h).isNotNull())
    ranked = D.rank_within(D.rank_within(pairs, ["family"], v, "_rv"), ["family"], h, "_rh")
    rho = ranked.groupBy("family").agg(safe_corr("_rv", "_rh").alias("rank_correlation"))
    return base.join(mv, "family", "left").join(mh, "family", "left").join(rho, "family", "left")


def dedupe_configs(configs: DataFrame, order: str = "seq") -> DataFrame:
    """Last row of each configuration id."""
    return keep_last(configs, ["config_id"], order)


def best_per_model(configs: DataFrame, sharpe: str = "validation_net_sharpe") -> DataFrame:
    """Row with the highest validation Sharpe of each model, id as the tie-break."""
    return keep_first(configs, ["model"], F.struct(F.col(sharpe).isNull(), -F.col(sharpe), F.col("config_id")))


def pivot_metric(df: DataFrame, row: str | Sequence[str], column: str, value: str, columns: Sequence) -> DataFrame:
    """``value`` as a table of ``row`` (one or more columns) by the listed values of ``column``."""
    return df.groupBy(*([row] if isinstance(row, str) else row)).pivot(column, list(columns)).agg(F.first(value))


def melt_metrics(df: DataFrame, ids: Sequence[str], measures: Mapping[str, str]) -> DataFrame:
    """Metric columns as rows: (ids, split, value)."""
    named = df.select(*ids, *[F.col(c).alias(label) for label, c in measures.items()])
    return named.unpivot(list(ids), list(measures), "split", "value")


def best_run(runs: DataFrame, metric_schema: str = "net_sharpe double, max_drawdown double") -> DataFrame:
    """Runs with their metrics JSON expanded, the best net Sharpe first; the first row is the best run."""
    x = runs.select("*", F.from_json("metrics_json", metric_schema).alias("_m")).select(*runs.columns, "_m.*")
    return x.orderBy(F.desc_nulls_last("net_sharpe"), "run_id").limit(1)


# fixed values: the volatility windows, refit schedules, weightings and name forms in use
VOL_WINDOWS = (60, 90, 180, 360)
SCHEDULE = "(quarterly|semiannual|annual|frozen)"
WEIGHTING = "(shrink_75|shrink_80_primary|shrink_90)"
# pattern of a name up to its volatility suffix, and what its fields are: a text, or the number of a group
NAME_FORMS = (
    ("ts_equal", {"rule_weights": "equal", "refit": "quarterly_scalars"}),
    (f"ts_{WEIGHTING}_{SCHEDULE}", {"rule_weights": 1, "refit": 2}),
    ("breakout_carver5_equal_causal_fdm", {
        "method": "carver_fixed_scalars_equal", "fdm_mode": "causal_expanding", "refit": "quarterly"}),
    ("breakout_carver5_equal_fixed_fdm", {"method": "carver_fixed_scalars_equal", "fdm_mode": "fixed_1.20", "refit": "quarterly"}),
    (f"breakout_crypto_equal_{SCHEDULE}", {
        "method": "crypto_expanding_scalars_equal", "fdm_mode": "causal_expanding", "refit": 1}),
    (f"breakout_crypto_{WEIGHTING}_{SCHEDULE}", {
        "method": "crypto_expanding_scalars_shrunk_weights", "weight_spec": 1, "fdm_mode": "causal_expanding", "refit": 2}),
)
CONFIG_FIELDS = ("rule_weights", "method", "weight_spec", "fdm_mode", "refit")


def model_config(df: DataFrame, name: str = "model", strict: bool = True) -> DataFrame:
    """The typed configuration that a model name stands for: text fields and volatility_window.

    A name of no known form, or with a window that is not in use, raises an error; with
    ``strict`` off its fields are null and ``supported`` is false.
    """
    text = F.coalesce(F.col(name), F.lit(""))
    window = F.nullif(F.regexp_extract(text, r"_vol(\d{1,9})$", 1), F.lit("")).cast("int")
    used = F.coalesce(window.isin(*VOL_WINDOWS), F.lit(False))
    fields = {f: F.lit(None).cast("string") for f in CONFIG_FIELDS}
    supported = F.lit(False)
    for form, values in NAME_FORMS:
        pattern = f"^{form}_vol\\d+$"
        fits = used & text.rlike(pattern)
        supported = supported | fits
        for field, value in values.items():
            shown = F.regexp_extract(text, pattern, value) if isinstance(value, int) else F.lit(value)
            fields[field] = F.coalesce(fields[field], F.when(fits, shown))
    out = df.withColumn("supported", supported)
    if strict:
        refused = F.raise_error(F.concat(F.lit("unsupported model name: "), text)).cast("boolean")
        out = out.withColumn("supported", F.when(F.col("supported"), F.lit(True)).otherwise(refused))
    return out.withColumns(fields).withColumn("volatility_window", F.when(F.col("supported"), window))
