"""Positions, trades, costs, funding and attribution.

Held weights are sparse (absent = 0) on a regular calendar (pos, ts).  What a
position was one bar earlier is reached by shifting ``pos`` in a join or an
aggregation key, never by a window over a whole series.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions import series as S
from sextant.functions import spread as D
from sextant.functions import timeaxis as T
from sextant.functions.dedupe import keep_last
from sextant.operators.signals import diff_vol, ffill, pooled_diff_vol

BARS_PER_YEAR = {"1d": 365, "4h": 365 * 6, "1h": 365 * 24}
# slots of an hour, the finest grain at which a key is cut
ASOF_CELL = 2 * T.HOUR


def size_positions(df: DataFrame, *, value: float, target: float, freq: str, lookback: int,
                   max_leverage: float | None = None, f: str = "f", shared_scale: int | None = None) -> DataFrame:
    """Forecast to units and notional: (f / 10) x per-bar risk / deviation of price differences.

    A series with fewer prices than ``lookback`` uses as many as it has.  ``shared_scale`` is given where
    several rows may share a symbol and a bar: the decimals of their prices.
    """
    risk = value * target / math.sqrt(BARS_PER_YEAR.get(freq, 365))
    if shared_scale is None:
        vol = diff_vol(df, lookback, out="_vol", backfill=True, shorten=True)
    else:
        vol = pooled_diff_vol(df, lookback, shared_scale, out="_vol")
    # the deviation is never null here, so neither are the units
    units = vol.withColumn("units", F.coalesce(F.col(f), F.lit(0.0)) / 10.0 * (risk / F.col("_vol")))
    out = units.withColumn("notional", F.col("units") * F.col("close"))
    if max_leverage is not None:
        cap = max_leverage * value
        out = out.withColumn("notional", F.when(
            F.col("notional").isNotNull(), F.greatest(F.least("notional", F.lit(cap)), F.lit(-cap))))
        out = out.withColumn("_u", F.col("notional") / F.nullif(F.col("close"), F.lit(0.0)))
        out = ffill(out, "_u", "units").withColumn("units", F.coalesce("units", F.lit(0.0)))
    return out.drop("_vol", "_u")


def rebalance_mask(calendar: DataFrame, freq: str) -> DataFrame:
    """Calendar with ``rebalance``: every bar, Mondays, or the first bar of a month."""
    if freq == "daily":
        return calendar.withColumn("rebalance", F.lit(True))
    if freq == "weekly":
        return calendar.withColumn("rebalance", F.weekday("ts") == 0)
    if freq == "monthly":
        firsts = calendar.groupBy(T.month(F.col("ts")).alias("_m")).agg(F.min("pos").alias("_first"))
        return calendar.withColumn("_m", T.month(F.col("ts"))).join(firsts, "_m").withColumn(
            "rebalance", F.col("pos") == F.col("_first")).drop("_m", "_first")
    raise ValueError(f"unsupported rebalance frequency {freq!r}")


def activation_map(calendar: DataFrame, freq: str) -> DataFrame:
    """For each bar the last rebalance bar strictly before it: (pos, ts, source)."""
    marked = rebalance_mask(calendar, freq).withColumn("_r", F.when(F.col("rebalance"), F.col("pos")))
    found = S.running(marked, {"source": ("last", "_r", False)}, keys=())
    return found.filter(F.col("source").isNotNull()).select("pos", "ts", "source")


def held_positions(target: DataFrame, calendar: DataFrame, freq: str, w: str = "w",
                   keys: Sequence[str] = ()) -> DataFrame:
    """Targets of the last rebalance bar, active from the next bar on: (keys, ts, symbol, pos, held).

    The calendar is tiny and says which bar a holding comes from, so this is one
    equi-join on the source bar.
    """
    sources = activation_map(calendar, freq)
    chosen = target.select(*keys, F.col("pos").alias("source"), "symbol", F.col(w).alias("held"))
    return chosen.filter(F.col("held") != 0).join(sources, "source").select(*keys, "ts", "symbol", "pos", "held")


def position_state(held: DataFrame, calendar: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Holding, previous holding and trade of each cell that has any: (keys, ts, symbol, pos, held, prev, trade).

    Every holding is counted at its bar and as the previous one of the next bar;
    one map-side combined aggregation brings the two together.
    """
    both = F.array(
        F.struct(F.col("pos").alias("pos"), F.col("held").alias("held"), F.lit(0.0).alias("prev")),
        F.struct((F.col("pos") + 1).alias("pos"), F.lit(0.0).alias("held"), F.col("held").alias("prev")))
    cells = held.select(*keys, "symbol", F.explode(both).alias("_s")).groupBy(
        *keys, "symbol", F.col("_s.pos").alias("pos")).agg(
        F.sum("_s.held").alias("held"), F.sum("_s.prev").alias("prev"))
    return cells.join(calendar, "pos").select(
        *keys, "ts", "symbol", "pos", "held", "prev", F.abs(F.col("held") - F.col("prev")).alias("trade"))


def position_pnl(prices: DataFrame, positions: DataFrame, point_value: float = 1.0,
                 fx: DataFrame | None = None, delay: bool = True) -> DataFrame:
    """P&L of positions filled one bar late: (ts, symbol, pos, position, trade, pnl, pnl_base).

    Positions and prices are filled forward; ``fx`` (ts, rate) is the last rate at or
    before the bar.
    """
    joined = prices.select("ts", "symbol", "pos", "close").join(
        positions.select("symbol", "pos", F.col("position").alias("_x")), ["symbol", "pos"], "left")
    shifted = S.over_bars(joined, lambda w: {"_y": S.at("_x", -1, w)}, before=1) if delay else \
        joined.withColumn("_y", F.col("_x"))
    filled = S.running(shifted, {"position": ("last", "_y", True), "_c": ("last", "close", True)})
    pnl = S.over_bars(filled, lambda w: {
        "trade": F.col("position") - S.at("position", -1, w),
        "pnl": S.at("position", -1, w) * (F.col("_c") - S.at("_c", -1, w)) * point_value}, before=1)
    if fx is None:
        rated = pnl.withColumn("_rate", F.lit(1.0))
    else:
        bars = pnl.select("ts").distinct().withColumn("_k", F.lit(0))
        rates = asof_last(bars, fx.select("ts", F.lit(0).alias("_k"), F.col("rate").alias("_rate")),
                          keys=("_k",), values=("_rate",), strict=False)
        rated = pnl.join(rates.drop("_k"), "ts", "left")
    return rated.select("ts", "symbol", "pos", "position", "trade", "pnl",
                        (F.col("pnl") * F.col("_rate")).alias("pnl_base"))


def asof_last(events: DataFrame, states: DataFrame, *, keys: Sequence[str], values: Sequence[str],
              time: str = "ts", strict: bool = True, rows: int = S.BLOCK_ROWS) -> DataFrame:
    """Each event with the last state of its key before it (``strict``) or at it.

    Events and states are put on one axis (two slots per second), which is cut per key into
    blocks of about ``rows`` rows; the last state of a block is carried over its border.
    So a hot key is split however dense it is, and a sparse one is not.
    """
    slot = T.epoch_second(F.col(time)) * 2
    pack = F.struct(*values)
    e = events.withColumn("pos", slot + (0 if strict else 1)).withColumn("_state", F.lit(None).cast(
        states.select(pack.alias("s")).schema["s"].dataType)).withColumn("_event", F.lit(True))
    s = states.select(*keys, (slot + (1 if strict else 0)).alias("pos"), pack.alias("_state"), F.lit(False).alias("_event"))
    s = keep_last(s, [*keys, "pos"], "pos")
    both = e.unionByName(s, allowMissingColumns=True)
    cut = S.row_blocks(both, "_rows", cell=ASOF_CELL, keys=keys, rows=rows)
    found = S.running(cut, {"_found": ("last", "_state", True)}, keys=keys, block="_rows")
    return found.filter("_event").select(
        *[c for c in events.columns if c not in values], *[F.col(f"_found.{v}").alias(v) for v in values])


def position_costs(pos: DataFrame, rates: DataFrame | None = None, *, maker: float = 0.0002, taker: float = 0.0004,
                   taker_share: float = 1.0, slippage_bps: float = 0.0) -> DataFrame:
    """Turnover, fees, slippage and funding of position series (ts, symbol, pos, position).

    The first row trades from zero; funding is the previous position times the
    last rate (``rates``: ts, symbol, rate) at or before the bar.
    """
    share = min(max(taker_share, 0.0), 1.0)
    fee = share * taker + (1.0 - share) * maker
    held = pos.withColumn("position", F.coalesce("position", F.lit(0.0)))
    lagged = S.running(held, {"_prev": ("last", "position", False)}).withColumn(
        "_prev", F.coalesce("_prev", F.lit(0.0)))
    rated = lagged.withColumn("rate", F.lit(0.0)) if rates is None else asof_last(
        lagged, rates, keys=("symbol",), values=("rate",), strict=False)
    turnover = F.abs(F.col("position") - F.col("_prev"))
    out = rated.select("ts", "symbol", "pos", turnover.alias("turnover"), (turnover * fee).alias("fees"),
                       (turnover * (slippage_bps / 10_000.0)).alias("slippage"),
                       (F.col("_prev") * F.coalesce("rate", F.lit(0.0))).alias("funding"))
    return out.withColumn("total", F.col("fees") + F.col("slippage") + F.col("funding"))


def asset_contribution(held: DataFrame, calendar: DataFrame, returns: DataFrame, funding: DataFrame | None = None,
                       fees: DataFrame | None = None, *, maker: float = 0.0002, taker: float = 0.0004,
                       taker_share: float = 1.0, slippage_bps: float = 5.0, keys: Sequence[str] = ()) -> DataFrame:
    """Net contribution of every cell: held x return - fee - slippage + funding.

    ``returns`` is (pos, symbol, ret), ``funding`` (pos, symbol, same, midnight): the
    midnight part meets the previous holding; ``fees`` (symbol, maker, taker)
    overrides the default rates.
    """
    state = position_state(held, calendar, keys).join(
        returns.select("pos", "symbol", "ret"), ["pos", "symbol"], "left")
    if funding is not None:
        state = state.join(funding.select("pos", "symbol", "same", "midnight"), ["pos", "symbol"], "left")
    else:
        state = state.withColumn("same", F.lit(0.0)).withColumn("midnight", F.lit(0.0))
    rates = fees.select("symbol", "maker", "taker") if fees is not None else None
    state = state.join(rates, "symbol", "left") if rates is not None else state.withColumn(
        "maker", F.lit(maker)).withColumn("taker", F.lit(taker))
    blended = F.coalesce("taker", F.lit(taker)) * taker_share + F.coalesce("maker", F.lit(maker)) * (1 - taker_share)
    zero = F.lit(0.0)
    out = state.select(
        *keys, "ts", "symbol", "pos", "held", "prev", "trade",
        (F.col("held") * F.coalesce("ret", zero)).alias("gross"),
        (F.col("trade") * blended).alias("fee"),
        (F.col("trade") * (slippage_bps / 10_000.0)).alias("slippage"),
        (F.col("held") * F.coalesce("same", zero) + F.col("prev") * F.coalesce("midnight", zero)).alias("funding"))
    return out.withColumn("contribution", F.col("gross") - F.col("fee") - F.col("slippage") + F.col("funding"))


def portfolio_daily(contrib: DataFrame, calendar: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sums of the contributions per bar, bars without a holding as zeros."""
    sums = contrib.groupBy(*keys, "pos").agg(
        F.sum("contribution").alias("net"), F.sum("gross").alias("gross"), F.sum("fee").alias("fee"),
        F.sum("slippage").alias("slippage"), F.sum("funding").alias("funding"), F.sum("trade").alias("turnover"),
        F.sum(F.abs("held")).alias("gross_exposure"), F.sum("held").alias("net_exposure"),
        F.sum(F.greatest("held", F.lit(0.0))).alias("long_exposure"),
        F.sum(F.least("held", F.lit(0.0))).alias("short_exposure"),
        F.count_if(F.col("held") > 0).alias("long_count"), F.count_if(F.col("held") < 0).alias("short_count"))
    bars = calendar.crossJoin(contrib.select(*keys).distinct()) if keys else calendar
    out = bars.join(sums, [*keys, "pos"], "left")
    counts = ("long_count", "short_count")
    measures = [c for c in sums.columns if c not in (*keys, "pos")]
    return out.select(*keys, "ts", "pos", *[
        F.coalesce(c, F.lit(0) if c in counts else F.lit(0.0)).alias(c) for c in measures])


def portfolio_state(contrib: DataFrame, calendar: DataFrame, keys: Sequence[str] = (), vol_bars: int = 60) -> DataFrame:
    """Daily state with top-5 concentration, NAV, drawdown and trailing realised volatility."""
    daily = portfolio_daily(contrib, calendar, keys)
    largest = F.row_number().over(Window.partitionBy(*keys, "pos").orderBy(F.desc(F.abs("held")), "symbol"))
    top = contrib.withColumn("_k", largest).filter(F.col("_k") <= 5).groupBy(*keys, "pos").agg(
        F.sum(F.abs("held")).alias("_top"))
    x = daily.join(top, [*keys, "pos"], "left").withColumn(
        "top5", F.coalesce(F.col("_top") / F.nullif(F.col("gross_exposure"), F.lit(0.0)), F.lit(0.0))).drop("_top")
    x = equity_and_drawdown(x, "net", keys)
    return S.over_bars(x, lambda w: {
        "realised_vol": S.rolling_std("net", vol_bars, w) * math.sqrt(365)}, before=vol_bars - 1, keys=keys)


def equity_and_drawdown(daily: DataFrame, value: str = "net", keys: Sequence[str] = ()) -> DataFrame:
    """Compounded ``equity`` from 1 and ``drawdown`` from its running maximum."""
    grown = S.running(daily, {"equity": ("product", 1 + F.coalesce(F.col(value), F.lit(0.0)), True)}, keys=keys)
    peaked = S.running(grown, {"_peak": ("max", "equity", True)}, keys=keys)
    return peaked.withColumn("drawdown", F.col("equity") / F.col("_peak") - 1).drop("_peak")


def funding_coefficients(prices: DataFrame, events: DataFrame, guard: bool = True) -> DataFrame:
    """Funding per unit of weight, day and symbol: (ts, symbol, pos, same, midnight).

    A midnight event settles on its day against the previous day's close.  An
    event without a mark after the first marked one is an error unless ``guard`` is off.
    """
    at_midnight = F.hour("funding_time") == 0
    work = events.select(
        "symbol", "funding_time", "funding_rate", "mark_price", at_midnight.alias("_mid"),
        T.day(F.col("funding_time")).alias("ts"), T.epoch_day(F.col("funding_time")).alias("pos"))
    work = work.withColumn("_ref", F.col("pos") - F.col("_mid").cast("bigint"))
    ref = prices.filter(F.col("close").isNotNull()).select(
        "symbol", F.col("pos").alias("_ref"), F.col("close").alias("_price"))
    work = work.join(ref, ["symbol", "_ref"])
    if guard:
        covered = work.groupBy("symbol").agg(F.min(F.when(
            F.col("mark_price").isNotNull(), F.col("funding_time"))).alias("_first"))
        work = work.join(covered, "symbol").withColumn("mark_price", F.when(
            F.col("mark_price").isNull() & (F.col("funding_time") >= F.col("_first")),
            F.raise_error(F.concat(F.lit("mark price missing after first coverage: "), "symbol"))
        ).otherwise(F.col("mark_price")))
    priced = work.filter(F.col("mark_price").isNotNull())
    coef = -F.col("mark_price") / F.col("_price") * F.col("funding_rate")
    return priced.groupBy("ts", "symbol", "pos").agg(
        F.coalesce(F.sum(F.when(~F.col("_mid"), coef)), F.lit(0.0)).alias("same"),
        F.coalesce(F.sum(F.when(F.col("_mid"), coef)), F.lit(0.0)).alias("midnight"))


def settle_funding(events: DataFrame, positions: DataFrame, strict: bool = True) -> DataFrame:
    """Cost and cash-flow of each event on the last quantity strictly before it.

    ``positions`` is (ts, symbol, quantity).  Without an earlier position ``strict``
    raises and otherwise the quantity is 0.
    """
    found = asof_last(events.withColumn("ts", F.col("funding_time")), positions,
                      keys=("symbol",), values=("quantity",))
    missing = F.raise_error(F.concat(F.lit("no position before the event of "), "symbol")).cast("double") \
        if strict else F.lit(0.0)
    sized = found.withColumn("quantity", F.when(F.col("quantity").isNull(), missing).otherwise(F.col("quantity")))
    cost = F.col("quantity") * F.col("mark_price") * F.col("funding_rate")
    return sized.drop("ts").withColumn("cost", cost).withColumn("cashflow", -cost)


def missing_funding(events: DataFrame, symbols: DataFrame, start, end) -> DataFrame:
    """Required symbols without an event in [start, end]."""
    seen = events.filter(F.col("funding_time").between(T.ntz(start), T.ntz(end))).select("symbol")
    return symbols.select("symbol").distinct().join(seen, "symbol", "left_anti")


def backfill_marks(events: DataFrame, marks: DataFrame) -> DataFrame:
    """Missing marks from ``marks`` (symbol, ts, mark) at the event time floored to 8 h.

    Adds mark_source and ``unresolved``: none, before or after the first own mark.
    """
    known = marks.select("symbol", F.col("ts").alias("_slot"), F.col("mark").alias("_mark"))
    x = events.withColumn("_slot", T.floor_to(F.col("funding_time"), 8 * T.HOUR)).join(
        known, ["symbol", "_slot"], "left").drop("_slot")
    x = x.withColumn("mark_source", F.when(F.col("mark_price").isNotNull(), F.lit("history")).when(
        F.col("_mark").isNotNull(), F.lit("mark_kline_open"))).withColumn(
        "mark_price", F.coalesce("mark_price", "_mark")).drop("_mark")
    first = x.groupBy("symbol").agg(F.min(F.when(
        F.col("mark_price").isNotNull(), F.col("funding_time"))).alias("_first"))
    return x.join(first, "symbol").withColumn("unresolved", F.when(F.col("mark_price").isNotNull(), F.lit("none")).when(
        F.col("funding_time") >= F.col("_first"), F.lit("after")).otherwise(F.lit("before"))).drop("_first")


def backfill_summary(filled: DataFrame) -> DataFrame:
    return filled.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("events"), F.count("mark_price").alias("priced"),
        F.count_if(F.col("mark_source") == "mark_kline_open").alias("resolved"),
        F.count_if(F.col("unresolved") == "before").alias("unresolved_before"),
        F.count_if(F.col("unresolved") == "after").alias("unresolved_after"))


def reconcile_funding(actual: DataFrame, model: DataFrame, notionals: DataFrame | None = None) -> DataFrame:
    """Account funding rows against the settled model events of the same symbol and time.

    ``actual``: transaction_id, symbol, ts, income; ``model``: output of
    :func:`settle_funding`; ``notionals``: transaction_id, notional.
    """
    events = keep_last(model.select(
        "symbol", F.col("funding_time").alias("ts"), F.abs(F.col("quantity") * F.col("mark_price")).alias("_n"),
        F.col("cashflow").alias("_cf")), ["symbol", "ts"], F.struct("_n", "_cf"))
    x = actual.join(events, ["symbol", "ts"], "left")
    modelled = F.coalesce("_n", F.lit(0.0))
    if notionals is None:
        x = x.withColumn("_account", modelled)
    else:
        x = x.join(notionals, "transaction_id", "left").withColumn(
            "_account", F.abs(F.coalesce("notional", F.lit(0.0)))).drop("notional")
    agrees = F.coalesce(F.signum("income") == F.signum("_cf"), F.lit(False))
    x = x.withColumn("matched_notional", F.when(agrees, F.least(modelled, F.col("_account"))).otherwise(F.lit(0.0)))
    hit = F.col("matched_notional") != 0
    return x.withColumn("unmatched_notional", F.greatest(F.col("_account") - F.col("matched_notional"), F.lit(0.0))) \
        .withColumn("reason", F.when(hit, F.lit(None)).when(F.col("_cf").isNotNull(), F.lit("direction_mismatch"))
                    .otherwise(F.lit("no_model_event"))).drop("_n", "_cf", "_account")


def reconcile_archive(sources: Sequence[tuple[str, DataFrame]], public: DataFrame, weights: DataFrame) -> DataFrame:
    """Account rows of several archives with the public rate and the model weight of their effective day.

    Later sources win per transaction id.  ``public``: symbol, ts, funding_rate;
    ``weights``: symbol, ts (day), weight.  A midnight event belongs to the day before.
    """
    rows = None
    for rank, (name, df) in enumerate(sources):
        part = df.select("transaction_id", "symbol", "ts", "income", F.lit(name).alias("source"), F.lit(rank).alias("_rank"))
        rows = part if rows is None else rows.unionByName(part)
    rows = keep_last(rows.filter(F.col("ts").isNotNull() & F.col("income").isNotNull()), ["transaction_id"],
                     F.struct("_rank", "ts", "symbol", "income")).drop("_rank")
    rates = keep_last(public.select("symbol", "ts", "funding_rate"), ["symbol", "ts"], "funding_rate")
    x = rows.join(rates, ["symbol", "ts"], "left").withColumn(
        "_day", F.when(F.hour("ts") == 0, F.date_sub(F.to_date("ts"), 1)).otherwise(F.to_date("ts")).cast("timestamp_ntz"))
    x = x.join(weights.select("symbol", F.col("ts").alias("_day"), F.col("weight").alias("_w")), ["symbol", "_day"], "left")
    x = x.withColumn("modelled", -F.col("_w") * F.col("funding_rate")).withColumn(
        "implied_notional", F.abs("income") / F.nullif(F.abs("funding_rate"), F.lit(0.0)))
    status = F.when(F.col("funding_rate").isNull(), F.lit("unmatched_missing_public_rate")).when(
        F.coalesce("_w", F.lit(0.0)) == 0, F.lit("unmatched_no_model_exposure")).when(
        F.signum("income") == F.signum("modelled"), F.lit("direction_agrees")).otherwise(
        F.lit("unmatched_direction_disagrees"))
    return x.withColumn("status", status).drop("_day", "_w")


def reconciliation_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source", "symbol", "status").agg(
        F.count("income").alias("n"), F.sum("income").alias("income"))


def funding_detail(held: DataFrame, calendar: DataFrame, coef: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Funding of each cell with a non-zero flow: (keys, ts, symbol, side, period, funding)."""
    x = position_state(held, calendar, keys).join(coef.select("pos", "symbol", "same", "midnight"), ["pos", "symbol"])
    flow = F.col("held") * F.col("same") + F.col("prev") * F.col("midnight")
    side = F.when(F.col("held") > 0, F.lit("long")).when(F.col("held") < 0, F.lit("short")).otherwise(F.lit("flat"))
    return x.select(*keys, "ts", "symbol", side.alias("side"), F.year("ts").cast("string").alias("period"),
                    flow.alias("funding")).filter(F.col("funding") != 0)


def funding_summary(detail: DataFrame) -> DataFrame:
    """Paid, received, net and events per model, symbol, side and year, with ALL-period totals."""
    detail = detail.select("model", "symbol", "side", "period", "funding")
    grouped = detail.groupingSets(
        [["model", "symbol", "side", "period"], ["model", "symbol", "side"]], "model", "symbol", "side", "period")
    return grouped.agg(
        F.grouping("period").alias("_all"),
        F.coalesce(F.sum(F.when(F.col("funding") < 0, F.col("funding"))), F.lit(0.0)).alias("paid"),
        F.coalesce(F.sum(F.when(F.col("funding") > 0, F.col("funding"))), F.lit(0.0)).alias("received"),
        F.sum("funding").alias("net"), F.count("funding").alias("events"),
    ).withColumn("period", F.when(F.col("_all") == 1, F.lit("ALL")).otherwise(F.col("period"))).drop("_all")


def expected_funding(positions: DataFrame, events: DataFrame, settlements: int = 3) -> DataFrame:
    """Next and 24 h cash-flow at the latest observed rate of each symbol (positions: symbol, position)."""
    latest = events.groupBy("symbol").agg(F.max_by("funding_rate", "funding_time").alias("rate"))
    x = positions.join(latest, "symbol", "left")
    return x.withColumn("next", -F.col("position") * F.col("rate")).withColumn(
        "next_24h", -F.col("position") * F.col("rate") * settlements)


def round_qty(quantity: Column, step: Column, min_qty: Column | None = None) -> Column:
    """Quantity rounded toward zero to a step; below the minimum or missing is 0."""
    whole = F.signum(quantity) * F.floor(F.abs(quantity) / step + 1e-12) * step
    stepped = F.when(step > 0, F.round(whole, 12)).otherwise(quantity)
    rounded = F.coalesce(F.when(~F.isnan(quantity), stepped), F.lit(0.0))
    if min_qty is None:
        return rounded
    return F.when((min_qty > 0) & (F.abs(rounded) < min_qty), F.lit(0.0)).otherwise(rounded)


def exchange_rules(info: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Step, minimum quantity and notional per symbol from nested filters (keys, filters array of maps)."""
    x = info.select(*keys, F.explode("filters").alias("_f"))

    def pick(kind: str, field: str) -> Column:
        return F.max(F.when(F.col("_f")["filterType"] == kind, F.col("_f")[field].cast("double")))

    return x.groupBy(*keys).agg(
        pick("PRICE_FILTER", "tickSize").alias("tick_size"), pick("LOT_SIZE", "stepSize").alias("step_size"),
        pick("LOT_SIZE", "minQty").alias("min_qty"), pick("MIN_NOTIONAL", "notional").alias("min_notional"))


def rounded_portfolio(latest: DataFrame, rules: DataFrame) -> DataFrame:
    """Target and held quantities under the exchange rules (latest: symbol, price, target_notional, held_notional)."""
    x = latest.join(rules, "symbol", "left")
    price = F.nullif(F.col("price"), F.lit(0.0))
    target = F.when(F.abs("target_notional") >= 1e-8, F.col("target_notional") / price).otherwise(F.lit(0.0))
    x = x.withColumn("target_qty", round_qty(target, F.col("step_size"), F.col("min_qty"))).withColumn(
        "held_qty", round_qty(F.coalesce(F.col("held_notional") / price, F.lit(0.0)), F.col("step_size"), F.col("min_qty")))
    small = (F.col("min_notional") > 0) & (F.abs(F.col("target_qty") * F.col("price")) < F.col("min_notional"))
    return x.withColumn("target_qty", F.when(small, F.lit(0.0)).otherwise(F.col("target_qty")))


def rebalance_sheet(rounded: DataFrame, floor: float = 1.0) -> DataFrame:
    """Trades worth more than ``floor`` and the minimum notional, with their action."""
    x = rounded.withColumn("trade_qty", F.col("target_qty") - F.col("held_qty")).withColumn(
        "trade_notional", (F.col("target_qty") - F.col("held_qty")) * F.col("price"))
    x = x.filter((F.abs("trade_notional") > floor) & (
        F.col("min_notional").isNull() | (F.abs("trade_notional") >= F.col("min_notional"))))
    held, target = F.col("held_qty"), F.col("target_qty")
    action = F.when(held == 0, "OPEN").when(target == 0, "CLOSE").when(held * target < 0, "FLIP").when(
        F.abs(target) < F.abs(held), "REDUCE").otherwise("INCREASE")
    return x.withColumn("action", action).orderBy(F.desc(F.abs("trade_notional")), "symbol")


def ticker_attribution(contrib: DataFrame, cutoff=None, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Contribution, funding and turnover of each symbol after the cutoff."""
    x = contrib if cutoff is None else contrib.filter(F.col("ts") > T.ntz(cutoff))
    return x.groupBy(*keys, "symbol").agg(
        F.sum("contribution").alias("contribution"), F.sum("funding").alias("funding"), F.sum("trade").alias("turnover"))


def quartile_labels(meta: DataFrame, column: str) -> DataFrame:
    """``column`` cut at its quartiles, lower edge of the first included, into {column}_group."""
    edges = D.quantiles(meta, [], column, {"_q1": .25, "_q2": .5, "_q3": .75})
    label = F.when(F.col(column).isNull(), F.lit("nan")).when(F.col(column) <= F.col("_q1"), "Q1").when(
        F.col(column) <= F.col("_q2"), "Q2").when(F.col(column) <= F.col("_q3"), "Q3").otherwise("Q4")
    return meta.crossJoin(edges).withColumn(f"{column}_group", label).drop("_q1", "_q2", "_q3")


def group_attribution(attr: DataFrame, meta: DataFrame, groupings: Sequence[str],
                      keys: Sequence[str] = ("model",)) -> DataFrame:
    """Attribution summed by each grouping column of ``meta`` (symbol, groupings)."""
    x = attr.join(meta.select("symbol", *groupings), "symbol")
    kinds = F.array(*[F.struct(F.lit(g).alias("grouping"), F.col(g).alias("label")) for g in groupings])
    x = x.withColumn("_g", F.explode(kinds))
    return x.groupBy(*keys, F.col("_g.grouping").alias("grouping"), F.col("_g.label").alias("label")).agg(
        F.count(F.lit(1)).alias("assets"), F.sum("contribution").alias("contribution"),
        F.sum("funding").alias("funding"), F.sum("turnover").alias("turnover"))


def capacity(state: DataFrame, volume: DataFrame, rates: Sequence[float] = (0.01, 0.05, 0.10)) -> DataFrame:
    """Median and 5th percentile over bars of the tightest capacity: participation x volume / trade."""
    limits = state.filter(F.col("trade") > 0).join(volume.filter(F.col("volume") > 0), "symbol")
    daily = limits.groupBy("pos").agg(F.min(F.col("volume") / F.col("trade")).alias("_c"))
    daily = daily.select("pos", F.explode(F.array(*[F.lit(float(r)) for r in rates])).alias("participation"), "_c")
    daily = daily.withColumn("_c", F.col("participation") * F.col("_c"))
    return D.quantiles(daily, ["participation"], "_c", {"median": 0.5, "p05": 0.05})


def exposure(positions: DataFrame) -> DataFrame:
    """Positions (symbol, side, notional, upnl) with a total row per side."""
    detail = positions.select("side", "symbol", "notional", "upnl", F.lit(False).alias("total"))
    totals = positions.groupBy("side").agg(F.sum("notional").alias("notional"), F.sum("upnl").alias("upnl")).select(
        "side", F.concat(F.lit("TOTAL "), "side").alias("symbol"), "notional", "upnl", F.lit(True).alias("total"))
    return detail.unionByName(totals)


def net_exposure(positions: DataFrame) -> DataFrame:
    """One row: long, short and net exposure, unrealised P&L and the sign of the net."""
    x = positions.agg(
        F.coalesce(F.sum(F.when(F.col("notional") > 0, F.col("notional"))), F.lit(0.0)).alias("long_expo"),
        F.coalesce(F.sum(F.when(F.col("notional") < 0, F.col("notional"))), F.lit(0.0)).alias("short_expo"),
        F.coalesce(F.sum("notional"), F.lit(0.0)).alias("net_expo"),
        F.coalesce(F.sum("upnl"), F.lit(0.0)).alias("upnl"))
    return x.withColumn("sign", F.signum("net_expo"))


def book_beta(positions: DataFrame, betas: DataFrame) -> DataFrame:
    """Beta of each position weighted by its share of the side and the side's share of the book."""
    x = positions.join(betas.select("symbol", "beta"), "symbol").withColumn(
        "beta", F.when(F.col("side") == "SHORT", -F.col("beta")).otherwise(F.col("beta")))
    x = D.with_totals(x, ["side"], _side=F.sum("notional"))
    x = D.with_totals(x, [], _book=F.sum(F.abs("notional")))
    share = F.abs("_side") / F.col("_book")
    return x.withColumn("w_beta", F.col("notional") / F.col("_side") * F.col("beta") * share).drop("_side", "_book")


def alignment(positions: DataFrame, latest: DataFrame) -> DataFrame:
    """Is each position on the side of its signal: YES, NO, or UNSUPPORTED without one."""
    signals = latest.select("symbol", F.col("signal").alias("_s"))
    both = positions.join(signals, "symbol").withColumn("aligned", F.when(
        F.signum("notional") == F.signum("_s"), "YES").otherwise("NO")).withColumn("signal", F.col("_s")).drop("_s")
    loose = positions.join(signals, "symbol", "left_anti").withColumn("aligned", F.lit("UNSUPPORTED")).withColumn(
        "signal", F.lit(None).cast("double"))
    return both.unionByName(loose)
