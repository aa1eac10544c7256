"""Queries for performance measures: every nation of the weekly panel is one strategy."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.operators import metrics as M
from sextant.operators import signals as X
from sextant.plans import panels as P
from sextant.plans import sqltext as Q
from sextant.plans.registry import r6, register, shown
from sextant.session import cut_lineage

PERF = """perf AS (
  SELECT r.ts, r.symbol AS strategy, r.pos, round(r.ret / 20, 9) AS net, p.volume / 10000 AS turnover,
    round(r.ret / 1000, 9) AS funding, p.volume / 100000 AS fee, p.volume / 200000 AS slippage
  FROM rets r JOIN panel p USING (symbol, pos)),
bench AS (SELECT ts, net AS bench FROM perf WHERE strategy = 'N00' AND net IS NOT NULL)"""
BASE = (Q.WEEKLY, Q.RETURNS, PERF)
EQ = """eq AS (SELECT *, product(1 + net) OVER (PARTITION BY strategy ORDER BY pos) AS equity FROM perf WHERE net IS NOT NULL),
dd AS (SELECT *, equity / max(equity) OVER (PARTITION BY strategy ORDER BY pos) - 1 AS drawdown FROM eq)"""


def perf(spark, sf):
    df = X.pct_change(P.weekly_panel(spark, sf))
    return cut_lineage(df.select("ts", F.col("symbol").alias("strategy"), "pos", r6(F.col("ret") / 20, 9).alias("net"),
                     (F.col("volume") / 10000).alias("turnover"), r6(F.col("ret") / 1000, 9).alias("funding"),
                     (F.col("volume") / 100000).alias("fee"), (F.col("volume") / 200000).alias("slippage")))


def bench(spark, sf):
    return perf(spark, sf).filter("strategy = 'N00' AND net IS NOT NULL").select("ts", F.col("net").alias("bench"))


CORE = """avg(net) * 365 AS annual_return, stddev_samp(net) * sqrt(365) AS annual_volatility, avg(net) * 365 / nullif(stddev_samp(net) * sqrt(365), 0) AS net_sharpe,
  avg(turnover) * 365 AS annual_turnover, sum(funding) AS funding_return, count(net) AS observations"""
CORE_OUT = ("annual_return", "annual_volatility", "net_sharpe", "annual_turnover", "funding_return", "max_drawdown", "cumulative_return")


def rounded(names, digits=6):
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


@register("h01_perf_metrics", Q.query(*BASE, EQ, f"""m AS (SELECT strategy, {CORE} FROM perf GROUP BY strategy),
d AS (SELECT strategy, min(drawdown) AS max_drawdown, arg_max(equity, pos) - 1 AS cumulative_return FROM dd GROUP BY strategy)""",
    select=f"SELECT strategy, observations, {rounded(CORE_OUT)} FROM m JOIN d USING (strategy)"))
def perf_metrics(spark, sf):
    return shown(M.perf_metrics(perf(spark, sf), ["strategy"]), "strategy", "observations", **{c: c for c in CORE_OUT})


@register("h02_drawdown", Q.query(*BASE, """src AS (
  SELECT strategy || ':returns' AS symbol, ts, pos, net AS v FROM perf WHERE net IS NOT NULL
  UNION ALL SELECT strategy || ':equity', ts, pos, 1 + round(turnover, 6) FROM perf),
k AS (SELECT symbol, arg_min(v, pos) > 0.5 AS eq FROM src GROUP BY symbol),
e AS (SELECT src.*, CASE WHEN eq THEN v ELSE product(1 + v) OVER (PARTITION BY symbol ORDER BY pos) END AS equity FROM src JOIN k USING (symbol))""",
    select="SELECT ts, symbol, round(equity, 6) AS equity, round(equity / max(equity) OVER (PARTITION BY symbol ORDER BY pos) - 1, 9) AS drawdown FROM e"))
def drawdown(spark, sf):
    p = perf(spark, sf)
    src = p.select(F.concat("strategy", F.lit(":returns")).alias("symbol"), "ts", "pos", F.col("net").alias("v")).unionByName(
        p.select(F.concat("strategy", F.lit(":equity")).alias("symbol"), "ts", "pos", (1 + r6("turnover")).alias("v")))
    return M.drawdown(src, "v").select("ts", "symbol", r6("equity").alias("equity"), r6("drawdown", 9).alias("drawdown"))


SPLITS = """splits AS (SELECT 'early' AS split, min(ts) AS start, TIMESTAMP '1998-01-01' AS stop FROM panel
  UNION ALL SELECT 'validation', TIMESTAMP '1997-06-01', TIMESTAMP '1999-12-31' UNION ALL SELECT 'holdout', TIMESTAMP '2000-01-01', max(ts) FROM panel)"""


def splits(spark, sf):
    from sextant.functions.timeaxis import ntz
    ends = P.weekly_panel(spark, sf).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    rows = F.array(
        F.struct(F.lit("early").alias("split"), F.col("a").alias("start"), ntz("1998-01-01 00:00:00").alias("end")),
        F.struct(F.lit("validation").alias("split"), ntz("1997-06-01 00:00:00").alias("start"), ntz("1999-12-31 00:00:00").alias("end")),
        F.struct(F.lit("holdout").alias("split"), ntz("2000-01-01 00:00:00").alias("start"), F.col("b").alias("end")))
    return ends.select(F.inline(rows))


@register("h03_metrics_by_split", Q.query(*BASE, SPLITS, f"""cut AS (SELECT perf.*, split FROM perf JOIN splits ON ts >= start AND ts <= stop),
eq AS (SELECT *, product(1 + net) OVER (PARTITION BY strategy, split ORDER BY pos) AS equity FROM cut WHERE net IS NOT NULL),
dd AS (SELECT *, equity / max(equity) OVER (PARTITION BY strategy, split ORDER BY pos) - 1 AS drawdown FROM eq),
m AS (SELECT strategy, split, {CORE} FROM cut GROUP BY strategy, split),
d AS (SELECT strategy, split, min(drawdown) AS max_drawdown, arg_max(equity, pos) - 1 AS cumulative_return FROM dd GROUP BY strategy, split)""",
    select=f"SELECT strategy, split, observations, {rounded(CORE_OUT)} FROM m JOIN d USING (strategy, split)"))
def metrics_by_split(spark, sf):
    df = M.metrics_by_split(perf(spark, sf), splits(spark, sf), ["strategy"])
    return shown(df, "strategy", "split", "observations", **{c: c for c in CORE_OUT})


RICH = ("sortino", "calmar", "worst_week", "worst_month", "cvar_95", "positive_day_rate", "fees", "slippage", "bench_beta",
        "bench_correlation", "max_drawdown", "net_sharpe")


@register("h04_rich_metrics", Q.query(*BASE, EQ, f"""x AS (SELECT perf.*, coalesce(bench, 0) AS b FROM perf LEFT JOIN bench USING (ts) WHERE net IS NOT NULL),
m AS (SELECT strategy, {CORE} FROM x GROUP BY strategy),
d AS (SELECT strategy, min(drawdown) AS max_drawdown FROM dd GROUP BY strategy),
mo AS (SELECT strategy, stddev_samp(CASE WHEN net < 0 THEN net END) * sqrt(365) AS down, avg((net > 0)::INT::DOUBLE) AS positive_day_rate, sum(fee) AS fees,
  sum(slippage) AS slippage, covar_samp(net, b) / nullif(var_samp(b), 0) AS bench_beta, corr(net, b) AS bench_correlation, quantile_cont(net, 0.05) AS q FROM x GROUP BY strategy),
wk AS (SELECT strategy, min(r) AS worst_week FROM (SELECT strategy, product(1 + net) - 1 AS r FROM x GROUP BY strategy, date_trunc('week', ts)) GROUP BY strategy),
mn AS (SELECT strategy, min(r) AS worst_month FROM (SELECT strategy, product(1 + net) - 1 AS r FROM x GROUP BY strategy, date_trunc('month', ts)) GROUP BY strategy),
cv AS (SELECT strategy, avg(net) AS cvar_95 FROM x JOIN mo USING (strategy) WHERE net <= q GROUP BY strategy),
al AS (SELECT *, annual_return / nullif(down, 0) AS sortino, CASE WHEN max_drawdown < 0 THEN annual_return / abs(max_drawdown) END AS calmar
  FROM m JOIN d USING (strategy) JOIN mo USING (strategy) JOIN wk USING (strategy) JOIN mn USING (strategy) JOIN cv USING (strategy))""",
    select=f"SELECT strategy, observations, {rounded(RICH)} FROM al"))
def rich_metrics(spark, sf):
    df = M.rich_metrics(perf(spark, sf), bench(spark, sf), ["strategy"])
    return shown(df, "strategy", "observations", **{c: c for c in RICH})


def roll_sql(n: int, need: int) -> str:
    def e(c, v):
        return f"CASE WHEN count({c}) OVER w >= {need} THEN {v} END"
    return f"""SELECT ts, strategy, {n} AS "window", {e('net', 'avg(net) OVER w * 365')} AS annual_return, {e('net', 'stddev_samp(net) OVER w * sqrt(365)')} AS annual_volatility,
  {e('net', 'avg(net) OVER w * 365')} / nullif({e('net', 'stddev_samp(net) OVER w * sqrt(365)')}, 0) AS sharpe,
  {e('both_', 'covar_samp(net, b) OVER w')} / nullif({e('b', 'var_samp(b) OVER w')}, 0) AS bench_beta, {e('both_', 'corr(net, b) OVER w')} AS bench_correlation,
  {e('turnover', 'avg(turnover) OVER w * 365')} AS annual_turnover, {e('funding', 'sum(funding) OVER w')} AS funding_return
FROM x WINDOW w AS (PARTITION BY strategy ORDER BY pos RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"""


ROLL = ("annual_return", "annual_volatility", "sharpe", "bench_beta", "bench_correlation", "annual_turnover", "funding_return")


@register("h05_rolling_metrics", Q.query(*BASE, """x AS (SELECT perf.*, bench AS b, CASE WHEN net IS NOT NULL AND bench IS NOT NULL THEN 1 END AS both_
  FROM perf LEFT JOIN bench USING (ts))""", select=f"SELECT ts, strategy, \"window\", {rounded(ROLL, 5)} FROM ({roll_sql(12, 6)} UNION ALL {roll_sql(26, 13)})"))
def rolling_metrics(spark, sf):
    df = M.rolling_metrics(perf(spark, sf), bench(spark, sf), (12, 26), ["strategy"], least=5)
    return shown(df, "ts", "strategy", "window", digits=5, **{c: c for c in ROLL})


@register("h06_search_score", Q.query(*BASE, select="""
SELECT strategy, count(net) AS observations, round(CASE WHEN count(net) >= 100 THEN avg(net) * 365 / nullif(stddev_samp(net) * sqrt(365), 0) END, 6) AS sharpe,
  round(CASE WHEN count(net) >= 100 THEN avg(turnover) * 365 END, 6) AS annual_turnover
FROM perf WHERE ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-01-01' GROUP BY strategy"""))
def search_score(spark, sf):
    from sextant.functions.timeaxis import ntz
    window = perf(spark, sf).filter(F.col("ts").between(ntz("1996-01-01 00:00:00"), ntz("1999-01-01 00:00:00")))
    return shown(M.search_score(window, ["strategy"], least=100), "strategy", "observations", sharpe="sharpe", annual_turnover="annual_turnover")


SER = ("sharpe", "cagr", "max_drawdown", "total_return", "skew", "lower_tail", "upper_tail", "t_stat", "volatility", "deflated_sharpe")
# normal quantile of 1 - 1/250
LUCKY = 2.6520698079021954
SERIES = f"""sm AS (SELECT strategy, count(net) AS observations, avg(net) / stddev_samp(net) * sqrt(365) AS sharpe, skewness(net) AS skew,
  quantile_cont(net, 0.05) AS lower_tail, quantile_cont(net, 0.95) AS upper_tail, avg(net) / (stddev_samp(net) / sqrt(count(net))) AS t_stat,
  stddev_samp(net) * sqrt(365) AS volatility FROM perf WHERE net IS NOT NULL GROUP BY strategy),
sd AS (SELECT strategy, min(drawdown) AS max_drawdown, arg_max(equity, pos) - 1 AS total_return FROM dd GROUP BY strategy),
ser AS (SELECT *, pow(1 + total_return, 365::DOUBLE / observations) - 1 AS cagr, sharpe - {LUCKY} * sqrt((1 + 0.5 * sharpe * sharpe) / (observations - 1)) AS deflated_sharpe
  FROM sm JOIN sd USING (strategy))"""


@register("h07_series_metrics", Q.query(*BASE, EQ, SERIES, select=f"SELECT strategy, observations, {rounded(SER[:-1])} FROM ser"))
def series_metrics(spark, sf):
    return shown(M.series_metrics(perf(spark, sf), by=["strategy"]), "strategy", "observations", **{c: c for c in SER[:-1]})


@register("h08_deflated_sharpe", Q.query(*BASE, EQ, SERIES, select="SELECT strategy, round(sharpe, 6) AS sharpe, round(deflated_sharpe, 6) AS deflated_sharpe FROM ser"))
def deflated_sharpe(spark, sf):
    df = M.series_metrics(perf(spark, sf), by=["strategy"], n_trials=250)
    return shown(df, "strategy", sharpe="sharpe", deflated_sharpe="deflated_sharpe")


@register("h09_compound", Q.query(*BASE, select="\nUNION ALL ".join(f"""
SELECT strategy, '{g}' AS grain, date_trunc('{g}', ts)::TIMESTAMP AS period, round(product(1 + net) - 1, 6) AS ret
FROM perf WHERE net IS NOT NULL GROUP BY strategy, date_trunc('{g}', ts)""" for g in ("week", "month", "year"))))
def compound(spark, sf):
    p = perf(spark, sf).filter("net IS NOT NULL")
    out = None
    for grain in ("week", "month", "year"):
        part = shown(M.compound(p, grain, ["strategy"]).withColumn("grain", F.lit(grain)), "strategy", "grain", "period", ret="ret")
        out = part if out is None else out.unionByName(part)
    return out


@register("h10_rolling_perf", Q.query(*BASE, select="""
SELECT ts, strategy, round(CASE WHEN count(net) OVER w >= 10 THEN avg(net) OVER w / nullif(stddev_samp(net) OVER w, 0) * sqrt(365) END, 5) AS rolling_sharpe,
  round(CASE WHEN count(net) OVER w >= 10 THEN stddev_samp(net) OVER w * sqrt(365) END, 6) AS rolling_vol,
  round(CASE WHEN count(net) OVER w >= 10 THEN product(1 + net) OVER w - 1 END, 6) AS rolling_return
FROM perf WINDOW w AS (PARTITION BY strategy ORDER BY pos RANGE BETWEEN 9 PRECEDING AND CURRENT ROW)"""))
def rolling_perf(spark, sf):
    df = M.rolling_perf(perf(spark, sf), 10, keys=["strategy"])
    return df.select("ts", "strategy", r6("rolling_sharpe", 5).alias("rolling_sharpe"), r6("rolling_vol").alias("rolling_vol"), r6("rolling_return").alias("rolling_return"))


CMP = ("correlation", "beta", "excess", "portfolio_net_sharpe", "portfolio_max_drawdown", "benchmark_net_sharpe", "benchmark_cumulative_return")


@register("h11_compare", Q.query(*BASE, """al AS (SELECT perf.ts, strategy, pos, net, bench FROM perf JOIN bench USING (ts) WHERE net IS NOT NULL),
e AS (SELECT *, product(1 + net) OVER (PARTITION BY strategy ORDER BY pos) AS ea, product(1 + bench) OVER (PARTITION BY strategy ORDER BY pos) AS eb FROM al),
dd2 AS (SELECT *, ea / max(ea) OVER (PARTITION BY strategy ORDER BY pos) - 1 AS da FROM e)""", select="""
SELECT strategy, min(ts) AS start, max(ts) AS "end", count(*) AS observations, round(corr(net, bench), 6) AS correlation,
  round(covar_samp(net, bench) / nullif(var_samp(bench), 0), 6) AS beta, round(arg_max(ea, pos) - arg_max(eb, pos), 6) AS excess,
  round(avg(net) * 365 / nullif(stddev_samp(net) * sqrt(365), 0), 6) AS portfolio_net_sharpe, round(min(da), 6) AS portfolio_max_drawdown,
  round(avg(bench) * 365 / nullif(stddev_samp(bench) * sqrt(365), 0), 6) AS benchmark_net_sharpe, round(arg_max(eb, pos) - 1, 6) AS benchmark_cumulative_return
FROM dd2 GROUP BY strategy"""))
def compare(spark, sf):
    df = M.compare(perf(spark, sf), bench(spark, sf), ["strategy"])
    return shown(df, "strategy", "start", "end", "observations", **{c: c for c in CMP})


@register("h12_benchmark_returns", Q.query(Q.WEEKLY, """span AS (
  SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY pos) AS prev FROM panel WHERE ts BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '2000-01-01')""", select="""
SELECT ts, symbol, round(close / prev - 1 - CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY pos) = 1 THEN 0.0009::DOUBLE ELSE 0 END, 6) AS ret
FROM span WHERE prev IS NOT NULL"""))
def benchmark_returns(spark, sf):
    return shown(M.benchmark_returns(P.weekly_panel(spark, sf), "1997-01-01 00:00:00", "2000-01-01 00:00:00"), "ts", "symbol", ret="ret")


SUM = ("mean", "std", "min", "max", "median", "ann_mean", "ann_std", "sharpe", "t_stat", "skew", "total")


@register("h13_summary_stats", Q.query(*BASE, select="""
SELECT strategy, count(net) - 1 AS degrees, round(avg(net), 6) AS mean, round(stddev_samp(net), 6) AS std, round(min(net), 6) AS min, round(max(net), 6) AS max,
  round(quantile_cont(net, 0.5), 6) AS median, round(avg(net) * 365, 6) AS ann_mean, round(stddev_samp(net) * sqrt(365), 6) AS ann_std,
  round(avg(net) / stddev_samp(net) * sqrt(365), 6) AS sharpe, round(avg(net) / (stddev_samp(net) / sqrt(count(net))), 6) AS t_stat,
  round(skewness(net) * (count(net) - 2) / sqrt(count(net) * (count(net) - 1)), 6) AS skew, round(sum(net), 6) AS total
FROM perf WHERE net IS NOT NULL GROUP BY strategy"""))
def summary_stats(spark, sf):
    return shown(M.summary_stats(perf(spark, sf), ["strategy"]), "strategy", "degrees", **{c: c for c in SUM})


@register("h13_cumulative_curve", Q.query(*BASE, "c AS (SELECT *, sum(net) OVER (PARTITION BY strategy ORDER BY pos) AS curve FROM perf WHERE net IS NOT NULL)",
    select="SELECT ts, strategy, round(curve, 9) AS curve, round(curve - max(curve) OVER (PARTITION BY strategy ORDER BY pos), 9) AS below_peak FROM c"))
def cumulative_curve(spark, sf):
    df = M.cumulative_curve(perf(spark, sf).filter("net IS NOT NULL"), ["strategy"])
    return shown(df, "ts", "strategy", digits=9, curve="curve", below_peak="below_peak")


@register("h14_standalone_sharpe", Q.query(*BASE, """c AS (SELECT strategy AS symbol, pos, net - fee AS contribution FROM perf),
tail AS (SELECT * FROM c WHERE pos > (SELECT max(pos) FROM c) - 40)""", select="""
SELECT a.symbol, a.sharpe, b.sharpe AS sharpe_recent, b.n AS n_recent FROM
(SELECT symbol, round(CASE WHEN count(contribution) >= 280 AND stddev_samp(contribution) > 0 THEN avg(contribution) / stddev_samp(contribution) * sqrt(365) END, 6) AS sharpe FROM c GROUP BY symbol) a
LEFT JOIN (SELECT symbol, count(contribution) AS n, round(CASE WHEN count(contribution) >= 20 AND stddev_samp(contribution) > 0 THEN avg(contribution) / stddev_samp(contribution) * sqrt(365) END, 6) AS sharpe
  FROM tail GROUP BY symbol) b USING (symbol)"""))
def standalone_sharpe(spark, sf):
    c = perf(spark, sf).select(F.col("strategy").alias("symbol"), "pos", (F.col("net") - F.col("fee")).alias("contribution"))
    a = M.standalone_sharpe(c, least=280).select("symbol", r6("sharpe").alias("sharpe"))
    b = M.standalone_sharpe(c, days=40).select("symbol", r6("sharpe").alias("sharpe_recent"), F.col("n").alias("n_recent"))
    return a.join(b, "symbol", "left")


ROWS = """rows_ AS (SELECT ts, strategy AS symbol, pos, net AS returns, fee AS total_cost, turnover * 10000 - 300 AS position, turnover FROM perf)"""


def basket_rows(spark, sf):
    return perf(spark, sf).select("ts", F.col("strategy").alias("symbol"), "pos", F.col("net").alias("returns"), F.col("fee").alias("total_cost"),
                                  (F.col("turnover") * 10000 - 300).alias("position"), "turnover")


@register("h15_equal_weight_basket", Q.query(*BASE, ROWS, """b AS (SELECT ts, pos, avg(returns) AS net, coalesce(avg(total_cost / 10), 0) AS c FROM rows_ GROUP BY ts, pos),
g AS (SELECT *, sum(c) OVER (ORDER BY pos) AS cost_drag FROM b),
e AS (SELECT *, product(1 + net) OVER (ORDER BY pos) AS equity FROM g WHERE net IS NOT NULL)""", select="""
SELECT ts, round(net, 6) AS net, round(equity, 6) AS equity, round(cost_drag, 6) AS cost_drag, round(equity / max(equity) OVER (ORDER BY pos) - 1, 6) AS drawdown FROM e"""))
def equal_weight_basket(spark, sf):
    return shown(M.equal_weight_basket(basket_rows(spark, sf), 10.0), "ts", net="net", equity="equity", cost_drag="cost_drag", drawdown="drawdown")


@register("h15_basket_contributions", Q.query(*BASE, ROWS, select="SELECT symbol, round(product(1 + coalesce(returns, 0)) - 1, 6) AS contribution FROM rows_ GROUP BY symbol"))
def basket_contributions(spark, sf):
    return shown(M.basket_contributions(basket_rows(spark, sf)), "symbol", contribution="contribution")


@register("h15_pairwise_correlation", Q.query(*BASE, ROWS, """p AS (SELECT a.symbol AS a, b.symbol AS b, corr(a.returns, b.returns) AS c FROM rows_ a JOIN rows_ b ON a.pos = b.pos AND a.symbol < b.symbol
  WHERE a.returns IS NOT NULL AND b.returns IS NOT NULL GROUP BY ALL)""", select="SELECT round(avg(c), 6) AS avg_pairwise_corr, count(c) AS pairs FROM p"))
def pairwise_correlation(spark, sf):
    return shown(M.mean_pairwise_correlation(basket_rows(spark, sf)), "pairs", avg_pairwise_corr="avg_pairwise_corr")


@register("h16_exposure_stats", Q.query(*BASE, ROWS, select="""
SELECT symbol, round(avg(abs(position)), 5) AS avg_exposure, round(max(abs(position)), 5) AS max_exposure, round(sum(turnover), 6) AS turnover, round(sum(total_cost) / 10, 7) AS cost_drag
FROM rows_ GROUP BY symbol"""))
def exposure_stats(spark, sf):
    df = M.exposure_stats(basket_rows(spark, sf), 10.0)
    return df.select("symbol", r6("avg_exposure", 5).alias("avg_exposure"), r6("max_exposure", 5).alias("max_exposure"), r6("turnover").alias("turnover"), r6("cost_drag", 7).alias("cost_drag"))
