"""Queries for returns, volatility and forecasts (weekly and daily order panels, hourly event bars)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.functions import series as S
from sextant.functions import timeaxis as T
from sextant.operators import signals as X
from sextant.plans import panels as P
from sextant.plans import sqltext as Q
from sextant.plans.registry import register, shown
from sextant.session import cut_lineage

RULES = ((2, 8), (4, 16), (8, 32))
VOL = 10
HORIZONS = (8, 16, 32)

RET_FRAME = "OVER (PARTITION BY symbol ORDER BY pos RANGE BETWEEN {0} PRECEDING AND CURRENT ROW)"


def frame(n: int) -> str:
    return RET_FRAME.format(n - 1)


def ewmac_sql(rules=RULES, vol=VOL, cap="20") -> str:
    """CTE ``fc`` (ts, symbol, pos, rule, value) on ``panel``."""
    spans = sorted({s for r in rules for s in r})
    ctes = [Q.RETURNS]
    ctes += [Q.ewma_cte(f"m{s}", "panel", "close", s, s) for s in spans]
    ctes.append(f"""risk AS (
  SELECT r.ts, r.symbol, r.pos, nullif(CASE WHEN count(ret) {frame(vol)} >= {vol} THEN stddev_samp(ret) {frame(vol)} END
         * q.close, 0) AS risk
  FROM rets r LEFT JOIN (SELECT symbol AS qs, pos + 1 AS qp, close FROM panel) q ON qs = symbol AND qp = pos)""")
    parts = []
    for f, s in rules:
        v = f"(a.y - b.y) / k.risk"
        parts.append(f"""SELECT k.ts, k.symbol, k.pos, 'ewmac_{f}_{s}' AS rule,
    CASE WHEN {v} IS NOT NULL THEN greatest(least({v}, {cap}), -{cap}) END AS value
  FROM risk k JOIN m{f} a USING (symbol, pos) JOIN m{s} b USING (symbol, pos)""")
    ctes.append("fc AS (\n  " + "\n  UNION ALL ".join(parts) + ")")
    return ",\n".join(ctes)


def channel_sql(horizons=HORIZONS, source="panel", flat="1e-8") -> str:
    cols = ", ".join(
        f"""CASE WHEN count(close) {frame(h)} >= {h} AND max(close) {frame(h)} - min(close) {frame(h)} > {flat}
      THEN 40.0::DOUBLE * (close - (max(close) {frame(h)} + min(close) {frame(h)}) / 2)
           / (max(close) {frame(h)} - min(close) {frame(h)}) END AS c{h}""" for h in horizons)
    return f"channel AS (SELECT ts, symbol, pos, {cols} FROM {source})"


@register("d01_pct_change", Q.query(Q.WEEKLY, select="""
SELECT p.ts, p.symbol, round(p.close / a.close - 1, 6) AS ret1, round(p.close / b.close - 1, 6) AS ret4,
       round(ln(p.close), 6) AS log_close
FROM panel p LEFT JOIN panel a ON a.symbol = p.symbol AND a.pos = p.pos - 1
LEFT JOIN panel b ON b.symbol = p.symbol AND b.pos = p.pos - 4"""))
def pct_change(spark, sf):
    df = X.pct_change(P.weekly_panel(spark, sf), k=1, out="ret1")
    df = X.pct_change(df, k=4, out="ret4").withColumn("log_close", F.log("close"))
    return shown(df, "ts", "symbol", ret1="ret1", ret4="ret4", log_close="log_close")


@register("d02_forward_returns", Q.query(Q.DAILY, select="""
SELECT p.ts, p.symbol, round(a.open / p.open - 1, 6) AS fwd_open, round(a.close / p.close - 1, 6) AS fwd_close,
       round(b.open / a.open - 1, 6) AS fwd_h
FROM bars p LEFT JOIN bars a ON a.symbol = p.symbol AND a.pos = p.pos + 1
LEFT JOIN bars b ON b.symbol = p.symbol AND b.pos = p.pos + 6"""))
def forward_returns(spark, sf):
    df = X.forward_returns(P.daily_panel(spark, sf), 5)
    return shown(df, "ts", "symbol", fwd_open="fwd_open", fwd_close="fwd_close", fwd_h="fwd_h")


@register("d03_causal_vol", Q.query(Q.WEEKLY, Q.RETURNS, select=f"""
SELECT ts, symbol, round(CASE WHEN count(ret) {frame(VOL)} >= {VOL}
  THEN stddev_samp(ret) {frame(VOL)} END * sqrt(365), 6) AS vol FROM rets"""))
def causal_vol(spark, sf):
    return shown(X.causal_vol(P.weekly_panel(spark, sf), VOL), "ts", "symbol", vol="vol")


@register("d04_diff_vol_lookahead_fill", Q.query(Q.WEEKLY, f"""d AS (
  SELECT p.ts, p.symbol, p.pos, p.close - q.close AS d
  FROM panel p LEFT JOIN panel q ON q.symbol = p.symbol AND q.pos = p.pos - 1),
v AS (SELECT *, nullif(CASE WHEN count(d) {frame(VOL)} >= {VOL // 2} THEN stddev_samp(d) {frame(VOL)} END, 0) AS raw FROM d)""",
    select="""
SELECT ts, symbol, round(raw, 6) AS vol, round(coalesce(
  first_value(raw IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
  last_value(raw IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  1e-8), 6) AS filled FROM v"""))
def diff_vol(spark, sf):
    panel = P.weekly_panel(spark, sf)
    filled = X.diff_vol(panel, VOL, out="filled", backfill=True)
    df = X.diff_vol(filled, VOL, out="vol")
    return shown(df, "ts", "symbol", vol="vol", filled="filled")


@register("d05_ewma", Q.query(Q.HOURLY, Q.ewma_cte("a", "bars", "close", 2, 2), Q.ewma_cte("b", "bars", "close", 32, 32),
    recursive=True, select="""
SELECT a.ts, a.symbol, round(a.y, 6) AS fast, round(b.y, 6) AS slow FROM a JOIN b USING (symbol, pos)"""))
def ewma(spark, sf):
    df = S.ewma(P.hourly_bars(spark, sf), {"fast": ("close", 2), "slow": ("close", 32)},
                min_bars={"fast": 2, "slow": 32})
    return shown(df, "ts", "symbol", fast="fast", slow="slow")


@register("d05_ewma_sparse", Q.query(Q.USER_BARS, Q.ewma_cte("a", "bars", "close", 2), Q.ewma_cte("b", "bars", "close", 128),
    Q.ewma_cte("c", "bars", "close", 2000, 3), recursive=True, select="""
SELECT a.ts, a.symbol, round(a.y, 6) AS fast, round(b.y, 6) AS slow, round(c.y, 6) AS slower
FROM a JOIN b USING (symbol, pos) JOIN c USING (symbol, pos)"""))
def ewma_sparse(spark, sf):
    df = S.ewma(P.user_bars(spark, sf), {"fast": ("close", 2), "slow": ("close", 128), "slower": ("close", 2000)},
                min_bars={"slower": 3})
    return shown(df, "ts", "symbol", fast="fast", slow="slow", slower="slower")


# supplier x day on a dense calendar: most cells are null, in runs of any length
DENSE = """cells AS (SELECT c.pos, s.symbol, p.value AS close FROM (SELECT unnest(range((SELECT min(pos) FROM positions), (SELECT max(pos) FROM positions) + 1)) AS pos) c
  CROSS JOIN (SELECT DISTINCT symbol FROM positions) s LEFT JOIN positions p ON p.pos = c.pos AND p.symbol = s.symbol)"""


@register("d05_ewma_null_runs", Q.query(Q.POSITIONS, DENSE, Q.ewma_cte("a", "cells", "close", 2, 2, keep="pos"),
    Q.ewma_cte("b", "cells", "close", 32, 32, keep="pos"), recursive=True, select="""
SELECT a.pos, a.symbol, round(a.y, 6) AS fast, round(b.y, 6) AS slow FROM a JOIN b USING (symbol, pos)"""))
def ewma_null_runs(spark, sf):
    held = cut_lineage(P.positions(spark, sf))
    # suppliers that share a name have rows of one bar; the SQL leaves their order open, here they go by value
    most = held.groupBy("symbol", "pos").count().agg(F.max("count")).first()[0] or 1
    cells = P.grid(held, "value", step=T.DAY).select("pos", "symbol", F.col("value").alias("close"))
    df = S.ewma(cells, {"fast": ("close", 2), "slow": ("close", 32)}, min_bars={"fast": 2, "slow": 32},
                order=("pos", "close"), most=most)
    if most > 1:  # the SQL joins both means by name and bar, which pairs the rows of a bar
        df = df.groupBy("pos", "symbol").agg(F.collect_list(F.struct("fast", "slow")).alias("_r"))
        df = df.select("pos", "symbol", "_r", F.explode("_r.fast").alias("fast")).select(
            "pos", "symbol", "fast", F.explode("_r.slow").alias("slow"))
    return shown(df, "pos", "symbol", fast="fast", slow="slow")


@register("d06_ewma_adjusted", Q.query(Q.HOURLY, Q.ewma_cte("a", "bars", "close", 2, adjust=True),
    Q.ewma_cte("b", "bars", "close", 32, adjust=True), recursive=True, select="""
SELECT a.ts, a.symbol, round(a.y, 8) AS fast, round(b.y, 8) AS slow FROM a JOIN b USING (symbol, pos)"""))
def ewma_adjusted(spark, sf):
    df = S.ewma(P.hourly_bars(spark, sf), {"fast": ("close", 2), "slow": ("close", 32)}, adjust=True)
    return shown(df, "ts", "symbol", digits=8, fast="fast", slow="slow")


@register("d07_ewmac", Q.query(Q.WEEKLY, ewmac_sql(((4, 16),)), recursive=True,
                               select="SELECT ts, symbol, rule, round(value, 6) AS value FROM fc"))
def ewmac(spark, sf):
    return shown(X.ewmac(P.weekly_panel(spark, sf), ((4, 16),), VOL), "ts", "symbol", "rule", value="value")


@register("d08_ewmac_diff", Q.query(
    Q.HOURLY, Q.ewma_cte("a", "bars", "close", 4, adjust=True), Q.ewma_cte("b", "bars", "close", 16, adjust=True),
    f"""d AS (SELECT p.ts, p.symbol, p.pos, p.close - q.close AS d
  FROM bars p LEFT JOIN bars q ON q.symbol = p.symbol AND q.pos = p.pos - 1),
v AS (SELECT *, nullif(CASE WHEN count(d) {frame(VOL)} >= {VOL} THEN stddev_samp(d) {frame(VOL)} END, 0) AS risk FROM d)""",
    recursive=True, select="""
SELECT v.ts, symbol, 'ewmac_4_16' AS rule, round((a.y - b.y) / risk, 6) AS value
FROM v JOIN a USING (symbol, pos) JOIN b USING (symbol, pos)"""))
def ewmac_diff(spark, sf):
    return shown(X.ewmac_diff(P.hourly_bars(spark, sf), ((4, 16),), VOL), "ts", "symbol", "rule", value="value")


@register("d09_rule_forecasts", Q.query(Q.WEEKLY, ewmac_sql(), recursive=True,
                                        select="SELECT ts, symbol, rule, round(value, 6) AS value FROM fc"))
def rule_forecasts(spark, sf):
    return shown(X.ewmac(P.weekly_panel(spark, sf), RULES, VOL), "ts", "symbol", "rule", value="value")


@register("d10_breakout", Q.query(
    Q.WEEKLY, channel_sql(), *[Q.ewma_cte(f"s{h}", "channel", f"c{h}", max(1, h // 4)) for h in HORIZONS],
    recursive=True, select="\nUNION ALL ".join(f"""
SELECT ts, symbol, 'breakout_{h}' AS rule, round(CASE WHEN y IS NOT NULL THEN greatest(least(y, 20), -20) END, 6) AS value
FROM s{h}""" for h in HORIZONS)))
def breakout(spark, sf):
    return shown(X.breakout(P.weekly_panel(spark, sf), HORIZONS), "ts", "symbol", "rule", value="value")


@register("d11_breakout_raw", Q.query(Q.WEEKLY, channel_sql(flat="0"), select="\nUNION ALL ".join(f"""
SELECT ts, symbol, 'breakout_{h}' AS rule, round(CASE WHEN c{h} IS NOT NULL THEN greatest(least(c{h}, 20), -20) END, 6) AS value
FROM channel""" for h in HORIZONS)))
def breakout_raw(spark, sf):
    return shown(X.breakout_raw(P.weekly_panel(spark, sf), HORIZONS), "ts", "symbol", "rule", value="value")


@register("d12_legacy_cap", Q.query(Q.WEEKLY, Q.RETURNS, select="""
SELECT ts, symbol, round(CASE WHEN x < 20 AND x > -20 THEN x WHEN x < -20 THEN -20 ELSE 20 END, 6) AS signal
FROM (SELECT ts, symbol, ret * 40 AS x FROM rets)"""))
def legacy_cap(spark, sf):
    df = X.pct_change(P.weekly_panel(spark, sf))
    return shown(df, "ts", "symbol", signal=X.legacy_cap(F.col("ret") * 40))


@register("d13_rsi", Q.query(Q.WEEKLY, f"""d AS (
  SELECT p.ts, p.symbol, p.pos, p.close - q.close AS d
  FROM panel p LEFT JOIN panel q ON q.symbol = p.symbol AND q.pos = p.pos - 1),
m AS (SELECT ts, symbol,
  CASE WHEN count(d) {frame(14)} >= 14 THEN avg(CASE WHEN d IS NOT NULL THEN greatest(d, 0) END) {frame(14)} END AS up,
  CASE WHEN count(d) {frame(14)} >= 14 THEN avg(CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END) {frame(14)} END AS down FROM d)""",
    select="SELECT ts, symbol, round(CASE WHEN down = 0 AND up > 0 THEN 100 ELSE 100 - 100 / (1 + up / nullif(down, 0)) END, 6) AS rsi FROM m"))
def rsi(spark, sf):
    return shown(X.rsi(P.weekly_panel(spark, sf)), "ts", "symbol", rsi="rsi")


@register("d14_pair_ratios", Q.query(Q.WEEKLY, """pairs AS (
  SELECT 'N' || lpad(a.n_nationkey::VARCHAR, 2, '0') || '/N' || lpad(b.n_nationkey::VARCHAR, 2, '0') AS pair
  FROM nation a JOIN nation b ON b.n_regionkey = a.n_regionkey AND b.n_nationkey > a.n_nationkey)""", select="""
SELECT x.ts, pair AS symbol, round(x.close / y.close, 6) AS close
FROM pairs JOIN panel x ON x.symbol = split_part(pair, '/', 1)
JOIN panel y ON y.symbol = split_part(pair, '/', 2) AND y.pos = x.pos"""))
def pair_ratios(spark, sf):
    return shown(X.pair_ratios(P.weekly_panel(spark, sf), region_pairs(spark, sf)), "ts", "symbol", close="close")


def region_pairs(spark, sf):
    """Pairs of nations of one region, with a malformed and an unknown pair mixed in."""
    a = P.table(spark, sf, "nation").select("n_regionkey", F.col("n_nationkey").alias("i"))
    b = a.select("n_regionkey", F.col("i").alias("j"))
    good = a.join(b, "n_regionkey").filter("j > i").select(F.format_string("N%02d/N%02d", "i", "j").alias("pair"))
    odd = a.filter("i < 2").select(F.format_string("N%02d/XX", "i").alias("pair"))
    return good.unionByName(odd).unionByName(a.filter("i = 3").select(F.lit("N03").alias("pair")))


FEATURES = f"""bench AS (SELECT * FROM bars WHERE symbol = 'view'),
{Q.ewma_cte("bm", "bench", "close", 24, adjust=True, keep="ts, pos")},
f1 AS (
  SELECT b.*, b.quote / nullif(CASE WHEN count(b.quote) OVER p30 >= 30 THEN quantile_cont(b.quote, 0.5) OVER p30 END, 0) AS rvol,
    2 * b.taker / nullif(b.quote, 0) - 1 AS imbalance,
    greatest(b.high - b.low, abs(b.high - q.close), abs(b.low - q.close)) AS tr,
    b.close / nullif(q.close, 0) - 1 AS ret,
    coalesce(count(b.close) OVER c7 >= 7 AND b.close = min(b.close) OVER c7, false) AS trough,
    coalesce(count(b.close) OVER c7 >= 7 AND b.close = max(b.close) OVER c7, false) AS peak
  FROM bars b LEFT JOIN bars q ON q.symbol = b.symbol AND q.pos = b.pos - 1
  WINDOW p30 AS (PARTITION BY b.symbol ORDER BY b.pos RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING),
         c7 AS (PARTITION BY b.symbol ORDER BY b.pos RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
f2 AS (
  SELECT *, CASE WHEN count(tr) {frame(14)} >= 14 THEN avg(tr) {frame(14)} END AS atr,
    CASE WHEN count(ret) {frame(20)} >= 20 THEN stddev_samp(ret) {frame(20)} END AS vol FROM f1),
feat AS (
  SELECT f2.*, coalesce(vol > CASE WHEN count(vol) OVER p40 >= 40 THEN quantile_cont(vol, 0.5) OVER p40 END, false) AS vol_high
  FROM f2 WINDOW p40 AS (PARTITION BY symbol ORDER BY pos RANGE BETWEEN 40 PRECEDING AND 1 PRECEDING)),
features AS (
  SELECT feat.*, bench.close > bm.y AS bench_bull
  FROM feat LEFT JOIN bm ON bm.pos = feat.pos LEFT JOIN bench ON bench.pos = feat.pos)"""


def features(spark, sf):
    return X.bar_features(P.hourly_bars(spark, sf), "view", vol_bars=20, regime_bars=40, trend_span=24)


@register("d15_bar_features", Q.query(Q.HOURLY, FEATURES, recursive=True, select="""
SELECT ts, symbol, round(rvol, 6) AS rvol, round(imbalance, 6) AS imbalance, round(atr, 6) AS atr, round(vol, 6) AS vol,
       vol_high, bench_bull, trough, peak FROM features"""))
def bar_features(spark, sf):
    df = features(spark, sf)
    return shown(df, "ts", "symbol", "vol_high", "bench_bull", "trough", "peak",
                 rvol="rvol", imbalance="imbalance", atr="atr", vol="vol")


BETA = f"""bench AS (SELECT pos, ret AS b, CASE WHEN count(ret) {frame(12)} >= 12 THEN var_samp(ret) {frame(12)} END AS v
  FROM rets WHERE symbol = 'N00'),
betas AS (
  SELECT r.ts, r.symbol, r.pos, CASE WHEN count(CASE WHEN ret IS NOT NULL AND b IS NOT NULL THEN 1 END) {frame(12)} >= 12
    THEN covar_samp(ret, b) {frame(12)} END / nullif(v, 0) AS beta
  FROM rets r LEFT JOIN bench USING (pos))"""


@register("d16_rolling_beta", Q.query(Q.WEEKLY, Q.RETURNS, BETA,
                                      select="SELECT ts, symbol, round(beta, 6) AS beta FROM betas"))
def rolling_beta(spark, sf):
    df = X.rolling_beta(X.pct_change(P.weekly_panel(spark, sf)), "N00", 12)
    return shown(df, "ts", "symbol", beta="beta")


@register("d17_ols_beta", Q.query(Q.WEEKLY, Q.RETURNS, select="""
SELECT a.symbol, round(regr_slope(a.ret, b.ret), 6) AS beta, count(*) AS n
FROM rets a JOIN rets b ON b.symbol = 'N00' AND b.pos = a.pos
WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY a.symbol"""))
def ols_beta(spark, sf):
    df = X.ols_beta(X.pct_change(P.weekly_panel(spark, sf)), "N00")
    return shown(df, "symbol", "n", beta="beta")


@register("d18_ffill", Q.query(Q.WEEKLY, """cells AS (
  SELECT c.ts, c.pos, s.symbol, p.close FROM (SELECT DISTINCT ts, pos FROM panel) c
  CROSS JOIN (SELECT DISTINCT symbol FROM panel) s LEFT JOIN panel p ON p.pos = c.pos AND p.symbol = s.symbol)""", select="""
SELECT ts, symbol, last_value(close IGNORE NULLS) OVER (
  PARTITION BY symbol ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM cells"""))
def ffill(spark, sf):
    df = X.ffill(P.grid(P.weekly_panel(spark, sf), "close"), "close", "filled")
    return df.select("ts", "symbol", "filled")
