"""Queries for the event study: hourly event bars, signal = distance of the close from its trailing mean."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.functions import series as S
from sextant.functions import timeaxis as T
from sextant.operators import events as J
from sextant.plans import panels as P
from sextant.plans import sqltext as Q
from sextant.plans.q_signals import FEATURES, features, frame
from sextant.plans.registry import r6, register, shown
from sextant.session import cut_lineage

HS = (1, 3, 7)
WARM = 30
FREEZE = "2024-01-20 00:00:00"
SIGS = f"""sig AS (SELECT ts, symbol, pos, CASE WHEN count(close) {frame(12)} >= 6 THEN (avg(close) {frame(3)} - avg(close) {frame(12)}) / 5 END AS s FROM bars)"""
BASE = (Q.HOURLY, SIGS)


def signal(spark, sf):
    x = S.over_bars(P.hourly_bars(spark, sf), lambda w: {"s": F.when(
        F.count("close").over(S.trailing(w, 12)) >= 6,
        (F.avg("close").over(S.trailing(w, 3)) - F.avg("close").over(S.trailing(w, 12))) / 5)}, before=11)
    return x.select("ts", "symbol", "pos", "s")


def turns(source: str, col: str, out: str) -> str:
    return f"""{out} AS (SELECT ts, symbol, pos, c AS direction, s FROM (SELECT *, last_value(c IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b
  FROM (SELECT *, {col} AS c FROM {source})) WHERE c IS NOT NULL AND c <> b)"""


SLOPE = ",\n".join([Q.ewma_cte("sm", "sig", "s", 3), """sd AS (SELECT n.ts, n.symbol, n.pos, n.x AS s, row_number() OVER (PARTITION BY n.symbol ORDER BY n.pos) - 1 AS rn, nullif(sign(y - last_value(y IGNORE NULLS) OVER (
    PARTITION BY n.symbol ORDER BY n.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 0) AS d0 FROM sm JOIN sm_n n USING (symbol, pos)),
sf AS (SELECT *, last_value(d0 IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY pos) AS d FROM sd)""",
    turns("sf", f"CASE WHEN rn >= {WARM + 2} AND count(d) {frame(2)} >= 2 AND min(d) {frame(2)} = max(d) {frame(2)} THEN d::INT END", "ev")])


@register("j01_slope_events", Q.query(*BASE, SLOPE, recursive=True, select="SELECT ts, symbol, direction FROM ev"))
def slope_events(spark, sf):
    return J.slope_events(signal(spark, sf), 2, WARM).select("ts", "symbol", "direction")


ZERO = "sr AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY pos) - 1 AS rn FROM sig),\n" + turns(
    "sr", f"CASE WHEN rn >= {WARM} THEN CASE WHEN s > 2 THEN 1 WHEN s < -2 THEN -1 END END", "ev")


@register("j02_zero_events", Q.query(*BASE, ZERO, select="SELECT ts, symbol, direction FROM ev"))
def zero_events(spark, sf):
    return events(spark, sf).select("ts", "symbol", "direction")


def events(spark, sf):
    return J.zero_events(signal(spark, sf), 2.0, WARM)


@register("j03_fast_slow_events", Q.query(Q.HOURLY, f"""cmp AS (SELECT ts, symbol, pos, row_number() OVER (PARTITION BY symbol ORDER BY pos) - 1 AS rn, close - avg(close) {frame(2)} AS a, close - avg(close) {frame(4)} AS b,
    close - avg(close) {frame(20)} AS c, close - avg(close) {frame(40)} AS d FROM bars),
st AS (SELECT *, CASE WHEN sign((a + b) / 2) IS DISTINCT FROM sign((c + d) / 2) THEN sign((a + b) / 2) ELSE 0 END AS st FROM cmp)""", select="""
SELECT ts, symbol, st::INT AS direction FROM (SELECT *, lag(st) OVER (PARTITION BY symbol ORDER BY pos) AS p FROM st) WHERE rn >= 30 AND st <> 0 AND st <> p"""))
def fast_slow_events(spark, sf):
    x = S.over_bars(P.hourly_bars(spark, sf), lambda w: {n: F.col("close") - F.avg("close").over(S.trailing(w, k)) for n, k in (
        ("a", 2), ("b", 4), ("c", 20), ("d", 40))}, before=39)
    return J.fast_slow_events(x, ("a", "b"), ("c", "d"), 30).select("ts", "symbol", "direction")


OUT = "outc AS (" + "\n  UNION ALL ".join(f"""SELECT e.ts, e.symbol, e.pos, e.direction, {h} AS horizon, n.open AS entry, e.direction * (x.close / n.open - 1) AS gross,
    (SELECT max(high) FROM bars p WHERE p.symbol = e.symbol AND p.pos BETWEEN e.pos + 1 AND e.pos + {h}) AS hi, (SELECT min(low) FROM bars p WHERE p.symbol = e.symbol AND p.pos BETWEEN e.pos + 1 AND e.pos + {h}) AS lo
  FROM ev e JOIN bars n ON n.symbol = e.symbol AND n.pos = e.pos + 1 JOIN bars x ON x.symbol = e.symbol AND x.pos = e.pos + {h}""" for h in HS) + """),
outs AS (SELECT *, gross - 0.0012::DOUBLE AS net, gross > 0.0012::DOUBLE AS hit, CASE WHEN direction = 1 THEN hi / entry - 1 ELSE -(lo / entry - 1) END AS mfe,
  CASE WHEN direction = 1 THEN lo / entry - 1 ELSE -(hi / entry - 1) END AS mae FROM outc)"""


def outcomes(spark, sf):
    return J.event_outcomes(events(spark, sf), P.hourly_bars(spark, sf), HS)


@register("j04_event_outcomes", Q.query(*BASE, ZERO, OUT, select="""
SELECT ts, symbol, horizon, round(gross, 6) AS gross, round(net, 6) AS net, hit, round(mfe, 6) AS mfe, round(mae, 6) AS mae FROM outs"""))
def event_outcomes(spark, sf):
    return shown(outcomes(spark, sf), "ts", "symbol", "horizon", "hit", gross="gross", net="net", mfe="mfe", mae="mae")


TOUCH = """path AS (SELECT e.symbol, e.pos, p.pos - e.pos AS j, CASE WHEN e.direction = 1 THEN p.high >= n.open + f.atr ELSE p.low <= n.open - f.atr END AS h,
    CASE WHEN e.direction = 1 THEN p.low <= n.open - f.atr ELSE p.high >= n.open + f.atr END AS l
  FROM ev e JOIN features f ON f.symbol = e.symbol AND f.pos = e.pos JOIN bars n ON n.symbol = e.symbol AND n.pos = e.pos + 1 JOIN bars p ON p.symbol = e.symbol AND p.pos BETWEEN e.pos + 1 AND e.pos + 7),
touch AS (SELECT symbol, pos, min(j) AS j, arg_min(CASE WHEN h AND l THEN 'ambiguous' WHEN h THEN 'target' ELSE 'stop' END, j) AS kind FROM path WHERE h OR l GROUP BY ALL),
barred AS (SELECT o.*, CASE WHEN j <= horizon THEN kind ELSE 'timeout' END AS barrier FROM outs o LEFT JOIN touch USING (symbol, pos))"""


def barred(spark, sf):
    ev = events(spark, sf)
    return J.barrier_outcome(outcomes(spark, sf), J.first_touch(ev, features(spark, sf), 7))


@register("j05_barrier_outcome", Q.query(*BASE, FEATURES, ZERO, OUT, TOUCH, recursive=True, select="SELECT ts, symbol, horizon, barrier FROM barred"))
def barrier_outcome(spark, sf):
    return barred(spark, sf).select("ts", "symbol", "horizon", "barrier")


BASELINE = f"""ordn AS (SELECT f.symbol, year(f.ts) AS year, f.bench_bull, f.ts >= TIMESTAMP '{FREEZE}' AS after, h.horizon, x.close / n.open - 1 AS r
  FROM features f JOIN sig USING (symbol, pos) CROSS JOIN (SELECT unnest([1, 3, 7]) AS horizon) h JOIN bars n ON n.symbol = f.symbol AND n.pos = f.pos + 1 JOIN bars x ON x.symbol = f.symbol AND x.pos = f.pos + h.horizon
  WHERE sig.s IS NOT NULL AND f.bench_bull IS NOT NULL),
basel AS (SELECT symbol, year, bench_bull, after, direction, horizon, avg((direction * r - 0.0012::DOUBLE > 0)::INT::DOUBLE) AS base_hit FROM ordn CROSS JOIN (SELECT unnest([1, -1]) AS direction) GROUP BY ALL)"""


def baseline(spark, sf):
    return J.baseline_hit(features(spark, sf), signal(spark, sf), HS, T.ntz(FREEZE))


@register("j06_baseline_hit", Q.query(*BASE, FEATURES, BASELINE, recursive=True, select="SELECT symbol, bench_bull, after, direction, horizon, round(base_hit, 6) AS base_hit FROM basel"))
def baseline_hit(spark, sf):
    return shown(baseline(spark, sf), "symbol", "bench_bull", "after", "direction", "horizon", base_hit="base_hit")


PIVOT = """pv AS (SELECT e.symbol, e.pos, arg_min(p.pos - e.pos, (abs(p.pos - e.pos), p.pos)) AS off FROM ev e JOIN features p ON p.symbol = e.symbol AND p.pos BETWEEN e.pos - 3 AND e.pos + 3
  WHERE CASE WHEN e.direction > 0 THEN p.trough ELSE p.peak END GROUP BY ALL)"""


@register("j07_nearest_pivot", Q.query(*BASE, FEATURES, ZERO, PIVOT, recursive=True, select="""
SELECT e.ts, e.symbol, CASE WHEN (SELECT count(*) FROM bars l WHERE l.symbol = e.symbol AND l.pos > e.pos) >= 3 THEN off IS NOT NULL END AS pivot_match, (-off)::BIGINT AS pivot_lag FROM ev e LEFT JOIN pv USING (symbol, pos)"""))
def nearest_pivot(spark, sf):
    df = J.nearest_pivot(events(spark, sf), features(spark, sf))
    return df.select("ts", "symbol", "pivot_match", F.col("pivot_lag").cast("bigint").alias("pivot_lag"))


def study(spark, sf):
    """Outcomes with barrier, pivot, features and baseline of every event and horizon."""
    bars = cut_lineage(features(spark, sf))
    ev = cut_lineage(events(spark, sf))
    out = J.barrier_outcome(J.event_outcomes(ev, bars, HS), J.first_touch(ev, bars, 7))
    pivots = J.nearest_pivot(ev, bars).select("symbol", "pos", "pivot_match", "pivot_lag")
    base = J.baseline_hit(bars, signal(spark, sf), HS, T.ntz(FREEZE))
    return cut_lineage(J.with_context(out.join(pivots, ["symbol", "pos"]), bars, base, T.ntz(FREEZE)))


STUDY = f"""study AS (SELECT b.*, f.rvol, f.bench_bull, f.vol_high, CASE WHEN (SELECT count(*) FROM bars l WHERE l.symbol = b.symbol AND l.pos > b.pos) >= 3 THEN off IS NOT NULL END AS pivot_match, -off AS pivot_lag, base_hit, CASE WHEN f.rvol >= 1.5 THEN 'High volume' ELSE 'Normal/low volume' END AS volume_group,
    coalesce(b.direction * f.imbalance > 0, false) AS flow_aligned
  FROM barred b JOIN features f ON f.symbol = b.symbol AND f.pos = b.pos LEFT JOIN pv ON pv.symbol = b.symbol AND pv.pos = b.pos
  LEFT JOIN basel ON basel.symbol = b.symbol AND basel.bench_bull = f.bench_bull AND basel.after = (b.ts >= TIMESTAMP '{FREEZE}') AND basel.direction = b.direction AND basel.horizon = b.horizon)"""


def stats_sql(keys: str, src: str = "study") -> str:
    p, n = "avg(hit::INT::DOUBLE)", "count(*)"
    return f"""SELECT {keys}, count(*) AS n, round({p}, 6) AS hit_rate, round(avg(base_hit), 6) AS base_hit, round({p} - avg(base_hit), 6) AS uplift, round(avg(net), 6) AS mean_net, round(quantile_cont(net, 0.5), 6) AS median_net,
  round(sum(net) FILTER (net > 0) / nullif(abs(sum(net) FILTER (net < 0)), 0), 6) AS profit_factor, round(avg(mfe), 6) AS mean_mfe, round(avg(pivot_match::INT::DOUBLE), 6) AS pivot_precision, round(quantile_cont(pivot_lag, 0.5)::DOUBLE, 6) AS median_pivot_lag,
  round(avg((barrier = 'target')::INT::DOUBLE), 6) AS target_first, round(avg((gross > 0.003::DOUBLE)::INT::DOUBLE), 6) AS hit_30bps,
  round(({p} + 3.8416::DOUBLE / (2 * {n})) / (1 + 3.8416::DOUBLE / {n}) - 1.96::DOUBLE * sqrt({p} * (1 - {p}) / {n} + 3.8416::DOUBLE / (4 * {n} * {n})) / (1 + 3.8416::DOUBLE / {n}), 6) AS wilson_low
FROM {src} GROUP BY ALL"""


STAT = ("hit_rate", "base_hit", "uplift", "mean_net", "median_net", "profit_factor", "mean_mfe", "pivot_precision", "median_pivot_lag", "target_first", "hit_30bps", "wilson_low")
FULL = (*BASE, FEATURES, ZERO, OUT, TOUCH, BASELINE, PIVOT, STUDY)


@register("j08_event_stats", Q.query(*FULL, recursive=True, select=stats_sql("symbol, horizon")))
def event_stats(spark, sf):
    return shown(J.event_stats(study(spark, sf), ["symbol", "horizon"]), "symbol", "horizon", "n", **{c: c for c in STAT})


# months of a clock stretched thirtyfold, since the event table spans one month
BOOT = """mo AS (SELECT symbol, horizon, date_trunc('month', TIMESTAMP '1970-01-01' + to_seconds(epoch(ts)::BIGINT * 30)) AS m, count(*) AS n,
  sum(hit::INT::DOUBLE) AS w, sum(hit::INT::DOUBLE - base_hit) AS u FROM study GROUP BY ALL),
bl AS (SELECT *, row_number() OVER (PARTITION BY symbol, horizon ORDER BY m) - 1 AS i, count(*) OVER (PARTITION BY symbol, horizon) AS months FROM mo),
sp AS (SELECT symbol, horizon, months, draw, ('0x' || substr(md5('1729|' || draw || '|' || i || '|' || symbol || '|' || horizon), 1, 8))::BIGINT % months AS i
  FROM bl, (SELECT unnest(range(1, 1001)) AS draw) WHERE months >= 6),
su AS (SELECT s.symbol, s.horizon, s.months, draw, sum(w) / sum(n) AS hit, sum(u) / sum(n) AS up FROM sp s JOIN bl b ON b.symbol = s.symbol AND b.horizon = s.horizon AND b.i = s.i GROUP BY ALL)"""


@register("j09_cluster_bootstrap", Q.query(*FULL, BOOT, recursive=True, select="""
SELECT symbol, horizon, months, round(quantile_cont(hit, 0.025), 6) AS cluster_low, round(quantile_cont(hit, 0.975), 6) AS cluster_high,
  round(quantile_cont(up, 0.025), 6) AS uplift_low, round(quantile_cont(up, 0.975), 6) AS uplift_high FROM su GROUP BY ALL"""))
def cluster_bootstrap(spark, sf):
    """Resampled by day-like blocks: the event tables span one month, so the month is taken of a stretched clock."""
    rows = study(spark, sf).withColumn("ts", T.from_epoch(T.epoch_second(F.col("ts")) * 30))
    df = J.cluster_bootstrap(rows, ["symbol", "horizon"], 1000)
    return shown(df, "symbol", "horizon", "months", **{c: c for c in ("cluster_low", "cluster_high", "uplift_low", "uplift_high")})


def spans(spark, sf):
    return events(spark, sf).select("symbol", "pos", (F.col("pos") + 1).alias("entry_pos"), (F.col("pos") + 8 + F.col("pos") % 5).alias("exit_pos"))


@register("j10_non_overlap", Q.query(*BASE, ZERO, """sp AS (SELECT symbol, pos, pos + 1 AS a, pos + 8 + pos % 5 AS b, row_number() OVER (PARTITION BY symbol ORDER BY pos) AS rn FROM ev),
gr AS (SELECT symbol, pos, rn, true AS keep, b AS fin FROM sp WHERE rn = 1
  UNION ALL SELECT s.symbol, s.pos, s.rn, s.a >= g.fin, CASE WHEN s.a >= g.fin THEN s.b ELSE g.fin END FROM gr g JOIN sp s ON s.symbol = g.symbol AND s.rn = g.rn + 1)""", recursive=True, select="SELECT symbol, pos FROM gr WHERE keep"))
def non_overlap(spark, sf):
    return J.non_overlap(spans(spark, sf)).select("symbol", "pos")


@register("j11_extremum_recall", Q.query(*BASE, FEATURES, ZERO, """mk AS (SELECT f.symbol, f.pos, f.trough, f.peak FROM features f JOIN sig USING (symbol, pos) WHERE s IS NOT NULL AND (trough OR peak) AND f.pos <= (SELECT max(pos) FROM bars b WHERE b.symbol = f.symbol) - 10)""", recursive=True, select="""
SELECT symbol, count(*) AS extrema, round(avg((EXISTS (SELECT 1 FROM ev e WHERE e.symbol = mk.symbol AND abs(e.pos - mk.pos) <= 3 AND CASE WHEN e.direction > 0 THEN mk.trough ELSE mk.peak END))::INT::DOUBLE), 6) AS recall FROM mk GROUP BY symbol"""))
def extremum_recall(spark, sf):
    df = J.extremum_recall(events(spark, sf), features(spark, sf), signal(spark, sf))
    return shown(df, "symbol", "extrema", recall="recall")


@register("j12_event_breakdown", Q.query(*FULL, """lv AS (SELECT s.*, unnest(['volume_group', 'flow_aligned', 'bench_bull', 'vol_high']) AS dim, unnest([volume_group, flow_aligned::VARCHAR, coalesce(bench_bull::VARCHAR, 'missing'), vol_high::VARCHAR]) AS level FROM study s)""",
    recursive=True, select=stats_sql("symbol, dim, level", "lv")))
def event_breakdown(spark, sf):
    df = J.event_breakdown(study(spark, sf), ("volume_group", "flow_aligned", "bench_bull", "vol_high"))
    return shown(df, "symbol", "dim", "level", "n", **{c: c for c in STAT})
