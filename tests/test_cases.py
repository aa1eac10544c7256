"""Hand-made cases of the operators with their expected values."""

import numpy as np
import pandas as pd
import pytest
from conftest import as_wide
from pyspark.sql import functions as F

from sextant.functions import series as S
from sextant.functions import timeaxis as T
from sextant.operators import accounting as G
from sextant.operators import calibrate as K
from sextant.operators import events as J
from sextant.operators import quality as B
from sextant.operators import selection as I
from sextant.operators import signals as X
from sextant.operators import snapshot as N
from sextant.operators import universe as U
from sextant.operators import xsection as C
from sextant.plans import panels as P
from sextant.sources import ledger as L
from sextant.streaming import candles as Z


def days(spark, rows, columns):
    """Rows that start with a day of January 2024."""
    data = [(f"2024-01-{r[0]:02d} {r[1] if isinstance(r[1], str) and ':' in r[1] else '00:00:00'}", *[
        v for i, v in enumerate(r[1:]) if not (i == 0 and isinstance(v, str) and ":" in v)]) for r in rows]
    names = columns.split(", ")
    df = spark.createDataFrame(data, "t string, " + ", ".join(names))
    return df.withColumn("ts", F.to_timestamp_ntz("t")).drop("t")


def test_turnover_fee_and_funding_of_one_position(spark):
    pos = T.with_pos(days(spark, [(1, "A", 1000.0), (2, "A", -500.0), (3, "A", 0.0)], "symbol string, position double"), T.DAY)
    rates = days(spark, [(1, "A", 0.01), (2, "A", 0.02), (3, "A", -0.03)], "symbol string, rate double")
    out = G.position_costs(pos, rates, taker_share=0.5).orderBy("pos").collect()
    assert [r.turnover for r in out] == [1000.0, 1500.0, 500.0]
    assert [r.fees for r in out] == pytest.approx([0.3, 0.45, 0.15])
    assert [r.funding for r in out] == pytest.approx([0.0, 20.0, 15.0])


def test_funding_settles_on_the_position_strictly_before(spark):
    ev = days(spark, [(2, "A", 0.01, 100.0)], "symbol string, funding_rate double, mark_price double").withColumnRenamed("ts", "funding_time")
    pos = days(spark, [(1, "A", 2.0), (2, "A", -3.0)], "symbol string, quantity double")
    row = G.settle_funding(ev, pos).first()
    assert (row.quantity, row.cost, row.cashflow) == (2.0, 2.0, -2.0)
    with pytest.raises(Exception, match="no position before"):
        G.settle_funding(ev, pos.filter("quantity < 0")).collect()


def test_missing_mark_after_first_coverage_is_an_error(spark):
    px = T.with_pos(days(spark, [(1, "A", 10.0), (2, "A", 10.0), (3, "A", 10.0)], "symbol string, close double"), T.DAY)
    ev = days(spark, [(1, "08:00:00", "A", 0.01, None), (2, "08:00:00", "A", 0.01, 10.0), (3, "00:00:00", "A", 0.02, 10.0)],
              "symbol string, funding_rate double, mark_price double").withColumnRenamed("ts", "funding_time")
    got = {r.ts.day: (r.same, r.midnight) for r in G.funding_coefficients(px, ev).collect()}
    assert got == {2: (-0.01, 0.0), 3: (0.0, -0.02)}
    late = ev.withColumn("mark_price", F.when(F.dayofmonth("funding_time") != 3, F.lit(10.0)))
    with pytest.raises(Exception, match="mark price missing"):
        G.funding_coefficients(px, late).collect()


def test_tradable_from_the_day_after_the_first_priced_event(spark):
    ev = days(spark, [(1, "A", None), (2, "A", 5.0)], "symbol string, mark_price double").withColumnRenamed("ts", "funding_time")
    cal = P.calendar(T.with_pos(days(spark, [(1, "A"), (4, "A")], "symbol string"), T.DAY))
    out = U.tradability_mask(cal, ev, ev).orderBy("pos").collect()
    assert [r.tradable for r in out] == [False, False, True, True]


def test_held_weights_activate_on_the_next_bar(spark):
    w = T.with_pos(days(spark, [(d, "A", float(d)) for d in range(1, 6)], "symbol string, w double"), T.DAY)
    cal = P.calendar(w)
    held = {r.ts.day: r.held for r in G.held_positions(w, cal, "daily").collect()}
    assert held == {2: 1.0, 3: 2.0, 4: 3.0, 5: 4.0}
    weekly = {r.ts.day: r.held for r in G.held_positions(w, cal, "weekly").collect()}  # 1 January 2024 is a Monday
    assert weekly == {2: 1.0, 3: 1.0, 4: 1.0, 5: 1.0}
    state = {r.ts.day: r.trade for r in G.position_state(G.held_positions(w, cal, "daily"), cal).collect()}
    assert state == {2: 1.0, 3: 1.0, 4: 1.0, 5: 1.0}


def test_contributions_sum_to_the_net_return_and_the_grid_agrees(spark):
    rng = np.random.default_rng(1)
    rows = [(d, s, float(rng.normal()), float(rng.normal(0, .02))) for d in range(1, 21) for s in ("A", "B")]
    x = T.with_pos(days(spark, rows, "symbol string, unit double, ret double"), T.DAY).cache()
    cal = P.calendar(x)
    grid = [(0.1, 0.05), (0.2, 1.0)]
    got = I.grid_daily(x.withColumn("model", F.lit("m")), cal, x, grid, ["weekly", "daily"]).collect()
    for target, cap in grid:
        for freq in ("weekly", "daily"):
            w = C.scale_to_target(x, target, cap)
            contrib = G.asset_contribution(G.held_positions(w, cal, freq), cal, x)
            one = {r.pos: r.net for r in G.portfolio_daily(contrib, cal).collect()}
            mine = {r.pos: r.net for r in got if (r.target_vol, r.gross_cap, r.rebalance) == (target, cap, freq)}
            assert mine and all(one[p] == pytest.approx(v, abs=1e-12) for p, v in mine.items())
            state = G.portfolio_daily(contrib, cal)
            assert all(r.ok for r in B.reconcile_accounting(state, contrib).collect())


def test_chosen_configurations_are_held_as_each_alone(spark):
    rng = np.random.default_rng(2)
    rows = [(d, s, float(rng.normal())) for d in range(1, 25) for s in ("A", "B", "C")]
    raw = T.with_pos(days(spark, rows, "symbol string, raw double"), T.DAY)
    caps = (0.4, 0.9)
    both = raw.withColumn("ticker_cap", F.explode(F.array(*[F.lit(c) for c in caps])))
    unit = C.cap_budget(both, "ticker_cap", out="unit", by=("ticker_cap", "pos"), smallest=min(caps)).cache()
    for cap in caps:
        one = {(r.pos, r.symbol): r.budget for r in C.cap_budget(raw, cap).collect()}
        many = {(r.pos, r.symbol): r.unit for r in unit.filter(F.col("ticker_cap") == cap).collect()}
        assert many == pytest.approx(one)
    with pytest.raises(ValueError):
        C.cap_budget(both, "ticker_cap")
    cal = P.calendar(raw)
    configs = [("a", 0.4, "weekly", 0.2, 0.1), ("b", 0.9, "daily", 0.3, 2.0), ("b", 0.9, "daily", 0.3, 2.0)]
    table = spark.createDataFrame(configs, "config_id string, ticker_cap double, rebalance string, target_vol double, gross_cap double")
    got = I.held_of_configs(unit, cal, table, ("daily", "weekly"), ("ticker_cap",)).collect()
    for name, cap, freq, target, gross in configs[:2]:
        w = C.scale_to_target(unit.filter(F.col("ticker_cap") == cap), target, gross)
        alone = {(r.pos, r.symbol): r.held for r in G.held_positions(w, cal, freq).collect()}
        assert alone and {(r.pos, r.symbol): r.held for r in got if r.config_id == name} == pytest.approx(alone)
    assert len({(r.config_id, r.pos, r.symbol) for r in got}) == len(got)


def test_catalog_with_a_wrong_id_is_an_error(spark):
    rows = spark.createDataFrame([("a", 0.1), ("b", 0.2)], "family string, target double")
    good = rows.withColumn("config_id", B.config_id(("family", "target")))
    assert L.catalog_check(L.config_catalog(good, ("family", "target"))).first().configurations == 2
    bad = good.withColumn("target", F.col("target") + 1)
    assert not any(r.matches for r in L.config_catalog(bad, ("family", "target")).collect())
    with pytest.raises(Exception, match="configuration hash mismatch"):
        L.catalog_check(L.config_catalog(bad, ("family", "target"))).collect()


def test_splice_scales_older_rows_that_stay_untradable(spark):
    main = T.with_pos(days(spark, [(d, "A", 20.0 + d) for d in range(14, 30)], "symbol string, close double"), T.DAY)
    old = T.with_pos(days(spark, [(d, "A", (20.0 + d) / 2) for d in range(1, 21)], "symbol string, close double"), T.DAY)
    out = B.splice_history(main, old).orderBy("pos").collect()
    assert len(out) == 29 and all(r.ratio == 2.0 for r in out)
    assert [r.tradable for r in out] == [False] * 13 + [True] * 16 and out[0].close == 21.0
    noisy = old.withColumn("close", F.col("close") * (1 + F.col("pos") % 4))
    assert B.splice_history(main, noisy).count() == 0


def test_provider_collision_takes_the_highest_fdv(spark):
    assets = spark.createDataFrame([("ABCUSDT", "ABC"), ("XYZUSDT", "XYZ")], "symbol string, base_asset string")
    rows = spark.createDataFrame([("low", "abc", 1.0), ("high", "abc", 9.0), ("none", "abc", None)], "provider_id string, symbol string, fdv double")
    got = {r.symbol: (r.provider_id, r.candidate_count) for r in U.resolve_assets(assets, rows, "p").collect()}
    assert got == {"ABCUSDT": ("high", 3), "XYZUSDT": (None, None)}


def test_weights_shrink_and_cap(spark):
    raw = spark.createDataFrame([("a", 10.0), ("b", 0.0), ("c", 0.0), ("d", 0.0), ("e", -1.0)], "rule string, weight double")
    out = {r.rule: r.weight for r in K.shrink_cap(raw, 0.8, 0.25).collect()}
    assert sum(out.values()) == pytest.approx(1.0) and max(out.values()) == pytest.approx(0.25)


def test_combination_ignores_missing_rules(spark):
    fc = T.with_pos(days(spark, [(1, "A", "x", 10.0), (1, "A", "y", None), (2, "A", "x", None), (2, "A", "y", None)],
                         "symbol string, rule string, value double"), T.DAY)
    w = spark.createDataFrame([("x", 0.25), ("y", 0.75)], "rule string, weight double")
    assert [r.f for r in K.combine(fc, w).orderBy("pos").collect()] == [10.0, None]
    assert [r.f for r in K.combine_fixed(fc, w, 1.0).orderBy("pos").collect()] == [2.5, 0.0]


def test_legacy_cap_turns_missing_into_plus_twenty(spark):
    df = spark.createDataFrame([(None,), (-20.0,), (-25.0,), (3.0,)], "x double")
    assert [r.y for r in df.select(X.legacy_cap(F.col("x")).alias("y")).collect()] == [20.0, 20.0, -20.0, 3.0]


def test_zero_cross_needs_to_leave_the_band(spark):
    values = [None] * 20 + [-3.0, -1.0, 1.0, 3.0, 1.0, -1.0, -3.0]
    sig = spark.createDataFrame([(i, "A", v) for i, v in enumerate(values)], "pos bigint, symbol string, s double").withColumn(
        "ts", T.from_epoch(F.col("pos") * T.DAY))
    got = [(r.pos, r.direction) for r in J.zero_events(sig, 2.0, 20).orderBy("pos").collect()]
    assert got == [(23, 1), (26, -1)]


def test_both_barriers_in_one_bar_stay_ambiguous(spark):
    rows = [(1, "A", 100.0, 101.0, 99.0, 100.0, 5.0), (2, "A", 110.0, 130.0, 90.0, 115.0, 5.0)]
    bars = T.with_pos(days(spark, rows, "symbol string, open double, high double, low double, close double, atr double"), T.DAY)
    ev = bars.filter("close = 100").select("ts", "symbol", "pos", F.lit(1).alias("direction"))
    out = J.event_outcomes(ev, bars, (1,)).first()
    assert out.gross == pytest.approx(115 / 110 - 1) and out.net == pytest.approx(115 / 110 - 1 - 0.0012)
    assert J.first_touch(ev, bars, 1).first().kind == "ambiguous"


def test_greedy_subset_equals_the_scan(spark):
    rng = np.random.default_rng(2)
    starts = np.sort(rng.choice(2000, 300, replace=False))
    rows = [("A", int(p), int(p) + 1, int(p) + 1 + int(rng.integers(1, 25))) for p in starts]
    df = spark.createDataFrame(rows, "symbol string, pos bigint, entry_pos bigint, exit_pos bigint")
    kept, end = [], -1
    for _, pos, entry, stop in rows:
        if entry >= end:
            kept.append(pos)
            end = stop
    assert sorted(r.pos for r in J.non_overlap(df).collect()) == kept


def test_roster_takes_three_distinct_models(spark):
    rows = [("v", "f", "x", "m0", "c0", 3.0), ("v", "f", "x", "m0", "c1", 2.9), ("v", "f", "x", "m1", "c2", 2.0),
            ("v", "f", "x", "m2", "c3", 1.0), ("v", "f", "x", "m3", "c4", 0.5)]
    df = spark.createDataFrame(rows, "variant string, fold string, family string, model string, config_id string, selection_net_sharpe double")
    df = df.withColumns({"selection_annual_turnover": F.lit(1.0), "gross_cap": F.lit(1.0), "target_vol": F.lit(.1)})
    got = {r.model: (r.rank, r.selected) for r in I.select_rosters(df).collect()}
    assert got == {"m0": (1, True), "m1": (2, True), "m2": (3, True), "m3": (4, False)}


def test_ledger_ignores_known_keys(spark, tmp_path):
    path = str(tmp_path / "ledger")
    one = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert L.append_ledger(one, path, ["k"], "v").count() == 2
    two = spark.createDataFrame([("a", 9), ("c", 3)], "k string, v int")
    assert {(r.k, r.v) for r in L.append_ledger(two, path, ["k"], "v").collect()} == {("a", 1), ("b", 2), ("c", 3)}


def test_stream_ignores_unfinished_and_unknown_and_repeats(spark, tmp_path):
    def message(symbol, close, done, at):
        return '{"data": {"E": %d, "k": {"s": "%s", "i": "1d", "t": 1717200000000, "c": "%s", "x": %s}}}' % (at, symbol, close, str(done).lower())

    rows = [message("btcusdt", 1.5, True, 2), message("btcusdt", 9.0, False, 3), message("zzz", 4.0, True, 1), message("btcusdt", 1.0, True, 1)]
    spark.createDataFrame([(r,) for r in rows], "value string").write.text(str(tmp_path / "in"))
    known = spark.createDataFrame([("BTCUSDT",)], "symbol string")
    for attempt in ("one", "two"):  # a new checkpoint delivers the same batch again
        stream = spark.readStream.schema("value string").text(str(tmp_path / "in"))
        Z.upsert_candles(Z.known_only(Z.closed_candles(stream), known), str(tmp_path / "panel"), str(tmp_path / attempt)).awaitTermination()
    out = Z.current_panel(spark, str(tmp_path / "panel")).collect()
    assert [(r.symbol, str(r.ts), r.close) for r in out] == [("BTCUSDT", "2024-06-01 00:00:00", 1.5)]


def test_rounding_never_adds_risk(spark):
    df = spark.createDataFrame([(-1.29, .1, .5), (1.29, .1, .5), (.4, .1, .5), (float("nan"), .1, .5)], "q double, s double, m double")
    got = [r.x for r in df.select(G.round_qty(F.col("q"), F.col("s"), F.col("m")).alias("x")).collect()]
    assert got == pytest.approx([-1.2, 1.2, 0.0, 0.0])


def test_lookback_tokens():
    assert [N.lookback_days(t) for t in ("7d", "4W", "6m", "1y", "all")] == [7, 28, 180, 365, None]
    for bad in ("0d", "11y", "x"):
        with pytest.raises(ValueError):
            N.lookback_days(bad)


@pytest.mark.parametrize("name", ["ewmac", "breakout", "channel", "vol", "buffer"])
def test_a_later_price_never_changes_an_earlier_value(panel, name):
    df, _ = panel
    cut = df.agg(F.expr("percentile(pos, 0.6)").cast("bigint").alias("c")).first().c

    def compute(d):
        if name == "ewmac":
            return X.ewmac(d, ((4, 16),), 10)
        if name == "breakout":
            return X.breakout(d, (8, 16))
        if name == "channel":
            return X.breakout_raw(d, (8, 16))
        if name == "vol":
            return X.causal_vol(d, 10, "value").withColumn("rule", F.lit("v"))
        p = C.xs_percentile(X.pct_change(d, k=3, out="f"))
        return C.buffered_basket(p, 0.34, 0.2, out="value").withColumn("rule", F.lit("b"))

    keep = ["symbol", "pos", "rule", F.round("value", 9).alias("value")]
    whole = compute(df).filter(F.col("pos") <= cut).select(*keep)
    short = compute(df.filter(F.col("pos") <= cut)).select(*keep)
    assert whole.exceptAll(short).count() == 0 and short.exceptAll(whole).count() == 0


def test_ewmac_equals_the_wide_formula(panel):
    df, wide = panel
    got = as_wide(X.ewmac(df, ((4, 16),), 10), "value")
    fast = wide.ewm(span=4, adjust=False, min_periods=4).mean()
    slow = wide.ewm(span=16, adjust=False, min_periods=16).mean()
    risk = wide.pct_change(fill_method=None).rolling(10, min_periods=10).std() * wide.shift(1)
    expected = ((fast - slow) / risk).clip(-20, 20).where(wide.notna()).reindex(index=got.index, columns=got.columns)
    np.testing.assert_allclose(got.to_numpy(), expected.to_numpy(), rtol=1e-9)


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("rows", [7, 1000, 65_536])
def test_asof_equals_pandas_for_dense_and_sparse_keys(spark, rows, strict):
    rng = np.random.default_rng(rows)
    start = pd.Timestamp("2024-01-01")
    spans = {"dense": 5_000, "sparse": 300_000_000, "late": 10}
    events = pd.DataFrame([(k, start + pd.Timedelta(seconds=int(t)), i) for k, span in spans.items()
                           for i, t in enumerate(rng.integers(0, span, 400))], columns=["symbol", "ts", "id"])
    states = pd.DataFrame([(k, start + pd.Timedelta(seconds=int(t)), float(i)) for k, span in spans.items() if k != "late"
                           for i, t in enumerate(rng.choice(span, 150, replace=False))], columns=["symbol", "ts", "v"])
    states = pd.concat([states, pd.DataFrame([("late", start + pd.Timedelta(days=9), 1.0)], columns=states.columns)])
    e = spark.createDataFrame(events).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    s = spark.createDataFrame(states).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = G.asof_last(e, s, keys=("symbol",), values=("v",), strict=strict, rows=rows).toPandas().set_index(["symbol", "id"]).v.sort_index()
    want = pd.merge_asof(events.sort_values("ts"), states.sort_values("ts"), on="ts", by="symbol", allow_exact_matches=not strict)
    pd.testing.assert_series_equal(got, want.set_index(["symbol", "id"]).v.sort_index())


def test_blocks_of_one_hot_key_are_bounded(spark):
    """A million rows of one key in two days, most of them in one hour."""
    df = spark.range(1_000_000).select(F.lit("hot").alias("symbol"), F.when(F.col("id") % 10 < 8, F.col("id") % 7_200).otherwise(
        F.col("id") % 345_600).alias("pos"))
    cut = S.row_blocks(df, "b", cell=600, rows=20_000)
    sizes = cut.groupBy("symbol", "b").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("low"), F.max("pos").alias("high")).orderBy("b").collect()
    assert sum(r.n for r in sizes) == 1_000_000 and len(sizes) >= 10
    cell = df.groupBy(F.floor(F.col("pos") / 600)).count().agg(F.max("count")).first()[0]
    assert max(r.n for r in sizes) <= 20_000 + cell
    assert all(a.high < b.low for a, b in zip(sizes, sizes[1:]))


def test_combined_forecast_does_not_depend_on_the_order_of_the_rules(spark):
    rows = [("A", 7.1, "r1"), ("A", 19.3, "r2"), ("A", 3.7, "r3"), ("A", 11.9, "r4"), ("A", 0.3, "r5")]
    weights = spark.createDataFrame([(f"r{i}", w) for i, w in enumerate((0.1, 0.2, 0.3, 0.7, 0.9), 1)], "rule string, weight double")

    def one(order):
        fc = spark.createDataFrame([(0, *rows[i]) for i in order], "pos long, symbol string, value double, rule string").coalesce(1)
        return K.combine(fc.withColumn("ts", F.lit("2024-01-01")), F.broadcast(weights)).first().f

    assert len({one(o) for o in ((0, 1, 2, 3, 4), (4, 3, 2, 1, 0), (2, 4, 0, 3, 1), (3, 0, 4, 1, 2))}) == 1


def test_ic_weights_read_the_orders_once(spark):
    import __spark_entry__ as E

    for name in ("e14_ic_weights", "e14_ic_weighted_forecast"):
        plan = E.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "orders.parquet" not in plan  # the panel is written before, later steps read it


@pytest.mark.parametrize("lookback", (6, 40))
def test_shortened_deviation_equals_frames_taken_one_by_one(spark, lookback):
    rng = np.random.default_rng(5)
    rows = [(s, int(p), float(c)) for s, n in (("A", 30), ("B", 7), ("C", 55)) for p, c in zip(
        np.sort(rng.choice(90, n, replace=False)) - 20, np.where(np.arange(n) < n // 2, 5.0, rng.normal(100, 3, n)))]
    df = spark.createDataFrame(rows, "symbol string, pos long, close double")
    got = {(r.symbol, r.pos): r.vol for r in X.diff_vol(df, lookback, shorten=True).collect()}
    for s in "ABC":
        close = {p: c for x, p, c in rows if x == s}
        look = min(lookback, max(2, len(close)))
        for p in close:
            d = [close[b] - close[b - 1] for b in range(p - look + 1, p + 1) if b in close and b - 1 in close]
            want = np.std(d, ddof=1) if len(d) >= max(2, look // 2) else 0.0
            assert got[s, p] == (None if want == 0 else pytest.approx(want, rel=1e-12))
