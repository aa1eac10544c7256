"""Queries users ask of snapshots, and the streaming merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.functions import timeaxis as T
from sextant.operators import calibrate as K
from sextant.operators import signals as X
from sextant.operators import snapshot as N
from sextant.operators import xsection as C
from sextant.plans import panels as P
from sextant.plans import q_accounting as A
from sextant.plans import q_calibrate as QK
from sextant.plans import q_metrics as QM
from sextant.plans import q_sources as QS
from sextant.plans import q_xsection as QX
from sextant.plans import sqltext as Q
from sextant.plans.q_signals import HORIZONS, frame, region_pairs
from sextant.plans.registry import r6, register, shown
from sextant.session import cut_lineage
from sextant.streaming import candles as Z

HIST = (*QX.BASE, QX.NEUTRAL, """srs AS (SELECT symbol, avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(365) AS standalone_sr FROM rets GROUP BY symbol),
hist AS (SELECT r.ts, r.symbol, r.pos, r.close AS price, r.f AS absolute_forecast, p AS rank, round(n.w, 12) AS xsec_signal, round(n.w, 12) * 2 AS target_weight, round(n.w, 12) * 1.5 AS held_weight, standalone_sr,
  CASE WHEN round(n.w, 12) * 2 > 1e-10 THEN 'LONG' WHEN round(n.w, 12) * 2 < -1e-10 THEN 'SHORT' ELSE 'FLAT' END AS xsec_side, CASE WHEN r.f >= 0 THEN 'LONG' ELSE 'SHORT' END AS trend_side
  FROM ranks r JOIN neutral n USING (symbol, pos) JOIN srs ON srs.symbol = r.symbol)""")


def history(spark, sf):
    """Ticker history of the weekly panel, materialised as the snapshot job would."""
    s = cut_lineage(C.dollar_neutral(cut_lineage(C.xs_percentile(QX.signals(spark, sf)))).withColumn("w", r6("w", 12)))
    sr = s.groupBy("symbol").agg((F.avg("ret") / F.nullif(F.stddev_samp("ret"), F.lit(0.0)) * F.sqrt(F.lit(365.0))).alias("standalone_sr"))
    pick = lambda c: s.select("ts", "symbol", c.alias("value"))
    return cut_lineage(N.ticker_history({"price": pick(F.col("close")), "absolute_forecast": pick(F.col("f")), "rank": pick(F.col("p")), "xsec_signal": pick(F.col("w")),
                             "target_weight": pick(F.col("w") * 2), "held_weight": pick(F.col("w") * 1.5)}, sr, 100_000.0))


@register("k01_ticker_history", Q.query(*HIST, select="""
SELECT ts, symbol, price, round(absolute_forecast, 6) AS absolute_forecast, round(rank, 6) AS rank, round(target_weight * 100000, 4) AS target_notional, round(held_weight * 100000, 4) AS held_notional,
  round(target_weight * 100000 / price, 4) AS quantity, xsec_side, trend_side, round(standalone_sr, 6) AS standalone_sr FROM hist"""))
def ticker_history(spark, sf):
    return history(spark, sf).select("ts", "symbol", "price", r6("absolute_forecast").alias("absolute_forecast"), r6("rank").alias("rank"), r6("target_notional", 4).alias("target_notional"),
                                     r6("held_notional", 4).alias("held_notional"), r6("quantity", 4).alias("quantity"), "xsec_side", "trend_side", r6("standalone_sr").alias("standalone_sr"))


@register("k02_signal_records", Q.query(*QK.BASE, QK.FIXW, f"""cf AS (SELECT ts, symbol, pos, {QK.cap('v')} AS f FROM (SELECT ts, symbol, pos, sum(value * weight) / nullif(sum(weight) FILTER (value IS NOT NULL), 0) AS v FROM fc JOIN fw USING (rule) GROUP BY ALL)),
rk AS (SELECT symbol, pos, (rank() OVER (PARTITION BY pos ORDER BY f) + (count(*) OVER (PARTITION BY pos, f) - 1) / 2::DOUBLE) / count(*) OVER (PARTITION BY pos) AS p FROM cf WHERE f IS NOT NULL)""", select="""
SELECT c.ts, c.symbol, round(f, 6) AS f, round(p, 6) AS percentile, CASE WHEN f IS NULL THEN 'UNAVAILABLE' WHEN f > 0 THEN 'LONG' WHEN f < 0 THEN 'SHORT' ELSE 'FLAT' END AS direction,
  round(coalesce(f, 0) * 50, 4) AS target_notional, CASE WHEN f IS NULL THEN 'warmup' ELSE 'valid' END AS quality_flag, 3::BIGINT AS components, round(x.value, 6) AS breakout_8
FROM cf c LEFT JOIN rk USING (symbol, pos) JOIN fc x ON x.symbol = c.symbol AND x.pos = c.pos AND x.rule = 'breakout_8'"""))
def signal_records(spark, sf):
    df = records(spark, sf)
    return df.select("ts", "symbol", r6("f").alias("f"), r6("percentile").alias("percentile"), "direction", r6("target_notional", 4).alias("target_notional"), "quality_flag",
                     F.size("components").cast("bigint").alias("components"), r6(F.col("components")["breakout_8"]).alias("breakout_8"))


def records(spark, sf):
    fc = QK.forecasts(spark, sf)
    combined = K.combine(fc, QK.fixed_weights(fc))
    targets = combined.select("symbol", "pos", (F.coalesce("f", F.lit(0.0)) / 2000).alias("w"))
    return N.signal_records(fc, combined, targets, 100_000.0)


SELECTED = "symbol, side, round(absolute_forecast, 6) AS absolute_forecast, round(rank, 6) AS rank, round(standalone_sr, 6) AS standalone_sr"
LAST = "cur AS (SELECT * FROM hist WHERE ts = (SELECT max(ts) FROM hist WHERE absolute_forecast IS NOT NULL) AND absolute_forecast IS NOT NULL)"


def last_history(spark, sf):
    return N.latest(history(spark, sf).filter("absolute_forecast IS NOT NULL"))


@register("k03_latest", Q.query(*HIST, select="""
SELECT symbol, price, round(rank, 6) AS rank FROM hist WHERE ts = (SELECT max(ts) FROM hist) UNION ALL SELECT symbol, price, round(rank, 6) FROM hist WHERE symbol = 'N07'"""))
def latest(spark, sf):
    h = history(spark, sf)
    return N.latest(h).unionByName(N.ticker(h, "N07")).select("symbol", "price", r6("rank").alias("rank"))


@register("k04_top_signals", Q.query(*HIST, LAST, select="\nUNION ALL ".join(f"SELECT {SELECTED} FROM (SELECT *, '{side}' AS side FROM cur WHERE {cond} ORDER BY {order}, symbol LIMIT 4)" for side, cond, order in (
    ("LONG", "xsec_signal > 0", "rank DESC NULLS LAST"), ("SHORT", "xsec_signal < 0", "rank NULLS LAST"))) + "\nUNION ALL " + "\nUNION ALL ".join(
    f"SELECT {SELECTED} FROM (SELECT *, '{side}' AS side FROM cur WHERE trend_side = '{side}' AND symbol IN (SELECT 'N' || lpad(n_nationkey::VARCHAR, 2, '0') FROM nation WHERE n_regionkey < 3) ORDER BY standalone_sr DESC NULLS LAST, symbol LIMIT 3)" for side in ("LONG", "SHORT"))))
def top_signals(spark, sf):
    h = last_history(spark, sf)
    sector = P.table(spark, sf, "nation").filter("n_regionkey < 3").select(F.format_string("N%02d", "n_nationkey").alias("symbol"))
    both = N.top_signals(h, "rank", 4).unionByName(N.top_signals(h, "sr", 3, sector))
    return both.select("symbol", "side", r6("absolute_forecast").alias("absolute_forecast"), r6("rank").alias("rank"), r6("standalone_sr").alias("standalone_sr"))


@register("k05_shadow_summary", Q.query(*HIST, LAST, Q.FUNDING, A.QUANT, A.SETTLED, select="""
SELECT * FROM (SELECT 'long' AS item, symbol, round(absolute_forecast, 6) AS value FROM cur WHERE absolute_forecast > 0 ORDER BY absolute_forecast DESC, symbol LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'short', symbol, round(absolute_forecast, 6) FROM cur WHERE absolute_forecast < 0 ORDER BY absolute_forecast, symbol LIMIT 5)
UNION ALL SELECT 'paid', NULL, round(sum(cost) FILTER (cost > 0), 6) FROM settled UNION ALL SELECT 'received', NULL, round(-sum(cost) FILTER (cost < 0), 6) FROM settled
UNION ALL SELECT 'net', NULL, round(-sum(cost), 6) FROM settled"""))
def shadow_summary(spark, sf):
    sig = last_history(spark, sf).select("symbol", F.col("absolute_forecast").alias("f"), F.when(F.col("absolute_forecast") > 0, "LONG").when(F.col("absolute_forecast") < 0, "SHORT").alias("direction"))
    return N.shadow_summary(sig, A.settled(spark, sf)).select("item", "symbol", r6("value").alias("value"))


@register("k06_changes", Q.query(*HIST, """t AS (SELECT max(ts) AS now, coalesce((SELECT max(ts) FROM hist WHERE ts <= (SELECT max(ts) FROM hist) - INTERVAL 30 DAY), min(ts)) AS prior FROM hist),
c AS (SELECT a.symbol, a.absolute_forecast - b.absolute_forecast AS fc, a.rank - b.rank AS rc, a.target_weight - b.target_weight AS tc FROM hist a JOIN t ON a.ts = now LEFT JOIN hist b ON b.symbol = a.symbol AND b.ts = prior)""", select="""
SELECT symbol, round(fc, 6) AS forecast_change, round(rc, 6) AS rank_change, round(tc, 6) AS target_change FROM c ORDER BY abs(tc) DESC NULLS LAST, symbol LIMIT 8"""))
def changes(spark, sf):
    return shown(N.changes(history(spark, sf), 30, 8), "symbol", forecast_change="forecast_change", rank_change="rank_change", target_change="target_change")


@register("k07_distribution", Q.query(*HIST, select="""
SELECT ts, round(avg(absolute_forecast), 6) AS mean, round(quantile_cont(absolute_forecast, 0.25), 6) AS p25, round(quantile_cont(absolute_forecast, 0.75), 6) AS p75,
  round(avg((absolute_forecast > 0)::INT::DOUBLE), 6) AS positive_breadth, count(*) AS universe FROM hist WHERE absolute_forecast IS NOT NULL AND ts >= (SELECT max(ts) FROM hist) - INTERVAL 179 DAY GROUP BY ts"""))
def distribution(spark, sf):
    return shown(N.distribution(history(spark, sf), "180d"), "ts", "universe", mean="mean", p25="p25", p75="p75", positive_breadth="positive_breadth")


@register("k08_window_days", Q.query(Q.DAILY, select="\nUNION ALL ".join(
    f"SELECT '{t}' AS token, symbol, ts FROM bars WHERE ts >= (SELECT max(ts) FROM bars) - INTERVAL {d - 1} DAY" for t, d in (("7d", 7), ("4w", 28), ("6m", 180), ("1y", 365)))))
def window_days(spark, sf):
    out = None
    for token in ("7d", "4w", "6m", "1y"):
        part = N.window_days(P.daily_panel(spark, sf), token).select(F.lit(token).alias("token"), "symbol", "ts")
        out = part if out is None else out.unionByName(part)
    return out


@register("k08_lookback_tokens", Q.query(select="""
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 5 THEN NULL ELSE CASE WHEN o_custkey >= 1 AND o_custkey * d <= 3650 THEN o_custkey * d END END::BIGINT AS days
FROM (SELECT *, CASE o_orderkey % 6 WHEN 1 THEN 1 WHEN 2 THEN 7 WHEN 3 THEN 30 WHEN 4 THEN 365 END AS d FROM orders)"""))
def lookback_tokens(spark, sf):
    o = P.table(spark, sf, "orders")
    kind = F.col("o_orderkey") % 6
    unit = F.when(kind == 1, "d").when(kind == 2, "W").when(kind == 3, "m").when(kind == 4, "y").otherwise("x")
    token = F.when(F.col("o_orderkey") % 6 == 0, "all").otherwise(F.concat(F.col("o_custkey").cast("string"), unit))
    return o.select("o_orderkey", N.lookback_column(token).cast("bigint").alias("days"))


PORT = "port AS (SELECT ts, pos, avg(net) AS net, sum(turnover) AS turnover, sum(funding) AS funding FROM perf GROUP BY ts, pos)"


def portfolio(spark, sf):
    return QM.perf(spark, sf).groupBy("ts", "pos").agg(F.avg("net").alias("net"), F.sum("turnover").alias("turnover"), F.sum("funding").alias("funding"))


@register("k09_performance", Q.query(*QM.BASE, PORT, """w AS (SELECT * FROM port WHERE ts >= (SELECT max(ts) FROM port) - INTERVAL 729 DAY),
e AS (SELECT *, product(1 + net) OVER (ORDER BY pos) AS eq FROM w WHERE net IS NOT NULL), d AS (SELECT *, eq / max(eq) OVER (ORDER BY pos) - 1 AS dd FROM e),
al AS (SELECT w.pos, net, bench FROM w JOIN bench USING (ts) WHERE net IS NOT NULL)""", select="""
SELECT round(avg(net) * 365, 6) AS annual_return, round(avg(net) * 365 / (stddev_samp(net) * sqrt(365)), 6) AS net_sharpe, round(min(dd), 6) AS max_drawdown,
  (SELECT round(corr(net, bench), 6) FROM al) AS correlation, (SELECT round(covar_samp(net, bench) / var_samp(bench), 6) FROM al) AS beta, (SELECT count(*) FROM al) AS common FROM d"""))
def performance(spark, sf):
    p = portfolio(spark, sf)
    a = N.performance(p, "2y").select(r6("annual_return").alias("annual_return"), r6("net_sharpe").alias("net_sharpe"), r6("max_drawdown").alias("max_drawdown"))
    b = N.performance(p, "2y", QM.bench(spark, sf)).select(r6("correlation").alias("correlation"), r6("beta").alias("beta"), F.col("observations").alias("common"))
    return a.crossJoin(b)


TSNAP = f"""endp AS (SELECT max(pos) AS e FROM panel),
lst AS (SELECT symbol, arg_max(close, pos) AS last_open, arg_max(close, pos) FILTER (pos <= e - 8) AS s, arg_max(close, pos) FILTER (pos <= e - 20) AS l FROM panel, endp GROUP BY symbol),
rec AS (SELECT r.*, b.ret AS b FROM rets r LEFT JOIN rets b ON b.symbol = 'N00' AND b.pos = r.pos, endp WHERE r.pos > e - 20),
rsk AS (SELECT symbol, CASE WHEN count(ret) >= 6 THEN stddev_samp(ret) * sqrt(365) END AS volatility, CASE WHEN count(*) FILTER (ret IS NOT NULL AND b IS NOT NULL) >= 6 THEN covar_samp(ret, b) END
  / (SELECT CASE WHEN count(ret) >= 6 THEN nullif(var_samp(ret), 0) END FROM rec WHERE symbol = 'N00') AS beta FROM rec GROUP BY symbol),
fnow AS (SELECT symbol, max(value) FILTER (rule = 'breakout_8') AS f8, max(value) FILTER (rule = 'breakout_16') AS f16 FROM fc WHERE ts = (SELECT max(ts) FROM fc) GROUP BY symbol),
inc AS (SELECT 'N' || lpad(c_nationkey::VARCHAR, 2, '0') AS symbol, sum(c_acctbal) AS net, count(*) AS n, sum(c_acctbal) FILTER (c_acctbal < 0) AS paid FROM customer GROUP BY c_nationkey)"""


@register("k10_ticker_snapshot", Q.query(*QK.BASE, TSNAP, select="""
SELECT l.symbol, last_open, round(last_open / s - 1, 6) AS return_short, round(last_open / l - 1, 6) AS return_long, round(volatility, 6) AS volatility, round(beta, 6) AS beta, round(f8, 6) AS f8, round(f16, 6) AS f16,
  round(net, 4) AS funding_net, round(paid, 4) AS funding_paid, coalesce(n, 0) AS funding_events FROM lst l LEFT JOIN rsk USING (symbol) LEFT JOIN fnow USING (symbol) LEFT JOIN inc USING (symbol)"""))
def ticker_snapshot(spark, sf):
    px = P.weekly_panel(spark, sf).withColumn("open", F.col("close"))
    rec = QK.forecasts(spark, sf).select("ts", "symbol", F.col("rule").alias("model"), F.col("value").alias("forecast"), F.lit(None).cast("double").alias("percentile"), F.lit(0.0).alias("position"))
    attr = rec.groupBy("symbol", "model").agg(F.avg("forecast").alias("contribution"))
    income = P.table(spark, sf, "customer").select(F.format_string("N%02d", "c_nationkey").alias("symbol"), F.col("c_acctbal").alias("income"))
    df = N.ticker_snapshot(px, rec, attr, income, "N00", ["breakout_8", "breakout_16"], short=8, long=20, least=6)
    return df.select("symbol", "last_open", r6("return_short").alias("return_short"), r6("return_long").alias("return_long"), r6("volatility").alias("volatility"), r6("beta").alias("beta"),
                     r6("breakout_8_forecast").alias("f8"), r6("breakout_16_forecast").alias("f16"), r6("funding_net", 4).alias("funding_net"), r6("funding_paid", 4).alias("funding_paid"), "funding_events")


@register("k11_signal_stats", Q.query(*QK.BASE, """d AS (SELECT symbol, rule AS model, value, sign(value) AS d, lag(sign(value)) OVER (PARTITION BY symbol, rule ORDER BY pos) AS p FROM fc WHERE value IS NOT NULL)""", select="""
SELECT symbol, model, round(avg(value), 6) AS forecast_mean, round(stddev_samp(value), 6) AS forecast_std, round(avg(abs(value)), 6) AS mean_abs_forecast, round(avg((value > 0)::INT::DOUBLE), 6) AS positive_share,
  count(*) AS valid_days, count(*) FILTER (p IS NOT NULL AND d <> p) AS direction_flips FROM d GROUP BY symbol, model"""))
def signal_stats(spark, sf):
    rec = QK.forecasts(spark, sf).select("symbol", F.col("rule").alias("model"), "pos", F.col("value").alias("forecast"))
    return shown(N.signal_stats(rec), "symbol", "model", "valid_days", "direction_flips", forecast_mean="forecast_mean", forecast_std="forecast_std",
                 mean_abs_forecast="mean_abs_forecast", positive_share="positive_share")


@register("k12_current_components", Q.query(*QK.BASE, select="SELECT symbol, " + ", ".join(
    f"round(arg_max(value, pos) FILTER (rule = '{r}' AND value IS NOT NULL), 6) AS {r}" for r in QK.RULES) + " FROM fc GROUP BY symbol"))
def current_components(spark, sf):
    return shown(N.current_components(QK.forecasts(spark, sf), QK.RULES), "symbol", **{r: r for r in QK.RULES})


@register("k13_holdings_weekly", Q.query(Q.POSITIONS, """tops AS (SELECT symbol FROM positions GROUP BY symbol ORDER BY sum(abs(quantity)) DESC, symbol LIMIT 18),
we AS (SELECT max(ts) AS ts, date_trunc('week', ts)::TIMESTAMP AS week FROM positions GROUP BY date_trunc('week', ts))""", select="""
SELECT week, CASE WHEN symbol IN (SELECT symbol FROM tops) THEN symbol ELSE 'OTHER_NET' END AS label, sum(quantity) AS held FROM positions JOIN we USING (ts) GROUP BY ALL"""))
def holdings_weekly(spark, sf):
    return N.holdings_weekly(P.positions(spark, sf).withColumn("held", F.col("quantity")))


@register("k14_eligibility_share", Q.query(Q.WEEKLY, Q.RETURNS, QK.CAL, QK.refits_sql("semiannual"), QK.ELIG, select="SELECT refit_ts, rule, round(avg(eligible::INT::DOUBLE), 6) AS share FROM elig GROUP BY ALL"))
def eligibility_share(spark, sf):
    return shown(N.eligibility_share(QK.eligible_records(spark, sf)), "refit_ts", "rule", share="share")


@register("k14_multiplier_bands", Q.query(*QX.BASE, select="""
SELECT ts, round(quantile_cont(1 + abs(f), 0.5), 6) AS median, round(quantile_cont(1 + abs(f), 0.1), 6) AS p10, round(quantile_cont(1 + abs(f), 0.9), 6) AS p90 FROM sig WHERE f IS NOT NULL GROUP BY ts"""))
def multiplier_bands(spark, sf):
    cells = QX.signals(spark, sf).filter("f IS NOT NULL").withColumn("fdm", 1 + F.abs("f"))
    return shown(N.multiplier_bands(cells), "ts", median="median", p10="p10", p90="p90")


CURRENT = f"""pw AS (SELECT symbol, rule, CASE rule WHEN 'breakout_8' THEN 0.2::DOUBLE WHEN 'breakout_16' THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END AS weight FROM (SELECT DISTINCT symbol, rule FROM fc) WHERE symbol NOT LIKE '%3'),
cs AS (SELECT ts, symbol, pos, greatest(least(sum(coalesce(value, 0) * weight) * 1.2::DOUBLE, 20), -20) AS f FROM fc JOIN pw USING (symbol, rule) GROUP BY ALL),
cd AS (SELECT cs.*, p.close, p.close - q.close AS d FROM cs JOIN panel p USING (symbol, pos) LEFT JOIN panel q ON q.symbol = cs.symbol AND q.pos = cs.pos - 1),
cv AS (SELECT *, nullif(CASE WHEN count(d) {frame(12)} >= 6 THEN stddev_samp(d) {frame(12)} END, 0) AS raw FROM cd),
cu AS (SELECT *, f / 10 * (1000 * 0.2::DOUBLE / sqrt(365) / coalesce(first_value(raw IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
  last_value(raw IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1e-8)) AS units FROM cv),
cr AS (SELECT a.*, b.units * a.d / 1000 AS r FROM cu a LEFT JOIN cu b ON b.symbol = a.symbol AND b.pos = a.pos - 2)"""
CUR_SELECT = """SELECT symbol, round(arg_max(f, pos), 2) AS signal, round(arg_max(units * close, pos), 4) AS notional, CASE WHEN arg_max(units, pos) > 0 THEN 'LONG' WHEN arg_max(units, pos) < 0 THEN 'SHORT' ELSE 'FLAT' END AS side,
  round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(365), 5) AS sharpe FROM cr GROUP BY symbol"""


def current(px, fc, skip):
    w = F.when(F.col("rule") == "breakout_8", 0.2).when(F.col("rule") == "breakout_16", 0.3).otherwise(0.5)
    weights = fc.select("symbol", "rule").distinct().filter(~F.col("symbol").endswith(skip)).withColumn("weight", w)
    df = N.current_signals(px, fc, weights, multiplier=1.2, value=1000.0, target=0.2, lookback=12)
    return df.select("symbol", "signal", r6("notional", 4).alias("notional"), "side", r6("sharpe", 5).alias("sharpe"))


@register("k15_current_signals", Q.query(*QK.BASE, CURRENT, select=CUR_SELECT))
def current_signals(spark, sf):
    return current(P.weekly_panel(spark, sf), QK.forecasts(spark, sf), "3")


@register("k16_current_pair_signals", Q.query(Q.WEEKLY.replace("panel AS", "panel0 AS"), """panel AS (SELECT x.ts, 'N' || lpad(a.n_nationkey::VARCHAR, 2, '0') || '/N' || lpad(b.n_nationkey::VARCHAR, 2, '0') AS symbol, x.pos, x.close / y.close AS close
  FROM nation a JOIN nation b ON b.n_regionkey = a.n_regionkey AND b.n_nationkey > a.n_nationkey JOIN panel0 x ON x.symbol = 'N' || lpad(a.n_nationkey::VARCHAR, 2, '0')
  JOIN panel0 y ON y.symbol = 'N' || lpad(b.n_nationkey::VARCHAR, 2, '0') AND y.pos = x.pos)""", QK.channel_sql(flat="0"), QK.FC, CURRENT, select=CUR_SELECT))
def current_pair_signals(spark, sf):
    pairs = X.pair_ratios(P.weekly_panel(spark, sf), region_pairs(spark, sf))
    return current(pairs, X.breakout_raw(pairs, HORIZONS), "3")


@register("k17_histogram", Q.query(*QM.BASE, """m AS (SELECT min(net) AS a, max(net) AS b FROM perf)""", select="""
SELECT least(floor((net - a) / ((b - a) / 45)) + 1, 45)::BIGINT AS bin, count(*) AS n FROM perf, m WHERE net IS NOT NULL GROUP BY 1"""))
def histogram(spark, sf):
    return N.histogram(QM.perf(spark, sf), "net", 45).select("bin", "n")


# --- streaming ------------------------------------------------------------------------------

def messages(spark, sf):
    """Candle messages of the hourly bars: an unfinished one, the closed one, for some bars a later correction."""
    b = P.hourly_bars(spark, sf)
    ms = T.epoch_second(F.col("ts")) * 1000

    def message(close, done, late):
        k = F.struct(F.lower("symbol").alias("s"), F.lit("1h").alias("i"), ms.alias("t"), close.cast("string").alias("c"), F.lit(done).alias("x"))
        body = F.struct((ms + late).alias("E"), k.alias("k"))
        wrapped = F.to_json(F.struct(body.alias("data")))
        return F.when(F.col("pos") % 2 == 0, wrapped).otherwise(F.to_json(body))

    one = b.select(message(F.col("open"), False, 1).alias("value"))
    two = b.select(message(F.col("close"), True, 2).alias("value"))
    three = b.filter("pos % 5 = 0").select(message(F.col("high"), True, 3).alias("value"))
    return one.unionByName(two).unionByName(three)


def streamed(spark, sf):
    """The messages as a file stream in several micro-batches."""
    folder = QS.shared_folder(spark)
    messages(spark, sf).repartition(4).write.text(f"{folder}/in")
    raw = spark.readStream.schema("value string").option("maxFilesPerTrigger", 2).text(f"{folder}/in")
    return folder, Z.closed_candles(raw)


CLOSED = """closed AS (SELECT upper(symbol) AS symbol, ts, CASE WHEN pos % 5 = 0 THEN high ELSE close END AS close FROM bars)"""


@register("l01_closed_candles", Q.query(Q.HOURLY, select="""
SELECT upper(symbol) AS symbol, '1h' AS interval, ts, close FROM bars UNION ALL SELECT upper(symbol), '1h', ts, high FROM bars WHERE pos % 5 = 0"""))
def closed_candles(spark, sf):
    return Z.closed_candles(messages(spark, sf)).select("symbol", "interval", "ts", "close")


@register("l02_known_only", Q.query(Q.HOURLY, CLOSED, select="SELECT symbol, ts, close FROM closed WHERE symbol NOT IN ('ERROR', 'VIEW')"))
def known_only(spark, sf):
    folder, stream = streamed(spark, sf)
    universe = P.table(spark, sf, "events").filter("event_type NOT IN ('error', 'view')").select(F.upper("event_type").alias("symbol"))
    Z.upsert_candles(Z.known_only(stream, universe), f"{folder}/panel", f"{folder}/checkpoint").awaitTermination()
    return Z.current_panel(spark, f"{folder}/panel").select("symbol", "ts", "close")


@register("l03_upsert_candles", Q.query(Q.HOURLY, CLOSED, select="SELECT symbol, ts, close FROM closed UNION ALL SELECT 'OLD', ts, close FROM closed WHERE symbol = 'VIEW'"))
def upsert_candles(spark, sf):
    folder, stream = streamed(spark, sf)
    Z.upsert_candles(stream, f"{folder}/panel", f"{folder}/checkpoint").awaitTermination()
    base = Z.current_panel(spark, f"{folder}/panel").filter("symbol = 'VIEW'")
    base = base.unionByName(base.withColumn("symbol", F.lit("OLD"))).withColumn("close", F.when(F.col("symbol") == "OLD", F.col("close")).otherwise(F.lit(0.0)))
    return Z.current_panel(spark, f"{folder}/panel", base).select("symbol", "ts", "close")


@register("l04_append_shadow", Q.query(Q.HOURLY, select="""
SELECT date_trunc('day', ts)::TIMESTAMP AS data_cutoff, 'trend' AS model, symbol, arg_min(close, ts) AS forecast FROM bars GROUP BY ALL"""))
def append_shadow(spark, sf):
    folder = QS.shared_folder(spark)
    rows = P.hourly_bars(spark, sf).select(T.day(F.col("ts")).alias("data_cutoff"), F.lit("trend").alias("model"), "symbol", F.col("close").alias("forecast"), F.col("ts").alias("emitted_at"))
    Z.append_shadow(rows, 0, f"{folder}/signals")
    Z.append_shadow(rows.withColumn("forecast", F.lit(0.0)), 1, f"{folder}/signals")
    return Z.emitted_signals(spark, f"{folder}/signals").select("data_cutoff", "model", "symbol", "forecast")


@register("l05_incremental", Q.query(QS.STATUS, select="""
SELECT o.ts, o.symbol, o.close FROM oth o LEFT JOIN (SELECT symbol, max(ts) AS last FROM fin WHERE ts < TIMESTAMP '1999-01-01' AND symbol <> '5-LOW' GROUP BY symbol) e USING (symbol) WHERE last IS NULL OR o.ts > last"""))
def incremental(spark, sf):
    old = QS.status_panel(spark, sf, True).filter((F.col("ts") < T.ntz("1999-01-01 00:00:00")) & (F.col("symbol") != "5-LOW"))
    return Z.incremental(old, QS.status_panel(spark, sf, False)).select("ts", "symbol", "close")
