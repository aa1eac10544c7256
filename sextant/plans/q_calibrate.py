"""Queries for pooled calibration and forecast combination: channel rules on the weekly panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.functions import timeaxis as T
from sextant.operators import calibrate as K
from sextant.operators import signals as X
from sextant.plans import panels as P
from sextant.plans import sqltext as Q
from sextant.plans.q_signals import HORIZONS, channel_sql, frame
from sextant.plans.registry import r6, register, shown
from sextant.session import cut_lineage

RULES = tuple(f"breakout_{h}" for h in HORIZONS)
LEAST = 52


def cap(v: str) -> str:
    return f"CASE WHEN {v} IS NOT NULL THEN greatest(least({v}, 20), -20) END"


FC = "fc AS (\n  " + "\n  UNION ALL ".join(
    f"SELECT ts, symbol, pos, 'breakout_{h}' AS rule, {cap(f'c{h}')} AS value FROM channel" for h in HORIZONS) + ")"
BASE = (Q.WEEKLY, Q.RETURNS, channel_sql(flat="0"), FC)
CAL = """cal AS (SELECT pos, TIMESTAMP '1970-01-05' + to_weeks(pos::INTEGER) AS ts
  FROM (SELECT unnest(range((SELECT min(pos) FROM panel), (SELECT max(pos) FROM panel) + 1)) AS pos))"""


def refits_sql(schedule: str, name: str = "refits", days: int | None = None) -> str:
    unit = "quarter" if schedule in ("quarterly", "semiannual") else "year"
    pick = {"semiannual": "WHERE i % 2 = 0"}.get(schedule, "")
    last = "ORDER BY d LIMIT 1" if schedule == "frozen" else ""
    start = "(SELECT min(pos) FROM cal)" if days is None else f"(SELECT min(pos) FROM cal WHERE cal.ts >= f.refit_ts - INTERVAL {days} DAY)"
    return f"""{name}_d AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM (
    SELECT unnest(generate_series(date_trunc('{unit}', (SELECT min(ts) FROM cal))::TIMESTAMP, (SELECT max(ts) FROM cal), INTERVAL 1 {unit})) AS d)
  WHERE d >= (SELECT min(ts) FROM cal)),
{name}_f AS (SELECT d, min(pos) AS refit, min(ts) AS refit_ts FROM (SELECT * FROM {name}_d {pick}) x JOIN cal ON ts >= d GROUP BY d
  HAVING min(pos) - (SELECT min(pos) FROM cal) >= {LEAST} {last}),
{name} AS (SELECT refit, refit_ts, least(refit + 1, (SELECT max(pos) FROM cal)) AS activation, {start} AS start FROM {name}_f f)"""


def panel(spark, sf):
    return P.weekly_panel(spark, sf)


def calendar(spark, sf):
    return P.calendar(panel(spark, sf), T.WEEK)


def forecasts(spark, sf):
    return X.breakout_raw(panel(spark, sf), HORIZONS)


def returns(spark, sf):
    return X.pct_change(panel(spark, sf)).select("symbol", "pos", "ret")


def refits(spark, sf, schedule="semiannual", days=None):
    return K.refit_dates(calendar(spark, sf), schedule, LEAST, days)


@register("e01_pooled_scalars", Q.query(*BASE, select="SELECT rule, round(coalesce(10 / nullif(quantile_cont(abs(value), 0.5), 0), 1), 6) AS scalar FROM fc GROUP BY rule"))
def pooled_scalars(spark, sf):
    return shown(K.pooled_scalars(forecasts(spark, sf)), "rule", scalar="scalar")


@register("e02_calibrated_scalars", Q.query(*BASE, """m AS (SELECT symbol, rule, avg(abs(value)) AS a FROM fc WHERE rule <> 'breakout_32' GROUP BY ALL HAVING avg(abs(value)) > 0)""",
    select="SELECT rule, round(10 / quantile_cont(a, 0.5), 6) AS scalar FROM m GROUP BY rule UNION ALL SELECT 'breakout_32', 0.7::DOUBLE WHERE EXISTS (SELECT 1 FROM fc)"))
def calibrated_scalars(spark, sf):
    fc = forecasts(spark, sf)
    fc = fc.withColumn("value", F.when(F.col("rule") != "breakout_32", F.col("value")))
    fallback = fc.select("rule").distinct().withColumn("scalar", F.lit(0.7))
    return shown(K.calibrated_scalars(fc, fallback), "rule", scalar="scalar")


def scores_sql(lag: int) -> str:
    return f"""pnl AS (SELECT f.symbol, f.rule, f.value / 10 * r.ret AS pnl FROM fc f LEFT JOIN rets r ON r.symbol = f.symbol AND r.pos = f.pos + {lag}),
each AS (SELECT symbol, rule, CASE WHEN stddev_samp(pnl) > 0 THEN greatest(avg(pnl) / stddev_samp(pnl), 0) ELSE 0 END AS score FROM pnl GROUP BY ALL),
scores AS (SELECT rule, quantile_cont(score, 0.5) AS score FROM each GROUP BY rule)"""


@register("e03_pooled_rule_scores", Q.query(*BASE, scores_sql(1), select="SELECT rule, round(score, 6) AS score FROM scores"))
def pooled_rule_scores(spark, sf):
    return shown(K.pooled_rule_scores(forecasts(spark, sf), returns(spark, sf), 1), "rule", score="score")


def rank(v: str, by: str) -> str:
    return f"rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2::DOUBLE"


IC = "ics AS (" + "\n  UNION ALL ".join(f"""SELECT rule, pos, {h} AS horizon, CASE WHEN isfinite(corr(rf, rr)) THEN corr(rf, rr) END AS ic FROM (
    SELECT rule, pos, {rank('value', 'rule, pos')} AS rf, {rank('future', 'rule, pos')} AS rr FROM (
      SELECT f.rule, f.pos, f.value, q.close / p.close - 1 AS future FROM fc f JOIN panel p USING (symbol, pos)
      JOIN panel q ON q.symbol = f.symbol AND q.pos = f.pos + {h}) WHERE value IS NOT NULL AND future IS NOT NULL) GROUP BY rule, pos""" for h in (2, 5)) + ")"


@register("e04_rank_ic", Q.query(*BASE, IC, select="SELECT rule, pos, round(avg(ic), 6) AS ic FROM ics GROUP BY rule, pos"))
def rank_ic(spark, sf):
    return shown(K.mean_rank_ic(forecasts(spark, sf), panel(spark, sf), (2, 5), ["rule"]), "rule", "pos", ic="ic")


@register("e05_pooled_ic_scores", Q.query(*BASE, IC, select="""
SELECT rule, round(coalesce(greatest(avg(m), 0), 0), 6) AS score FROM (SELECT rule, horizon, avg(ic) AS m FROM ics GROUP BY ALL) GROUP BY rule"""))
def pooled_ic_scores(spark, sf):
    return shown(K.pooled_ic_scores(forecasts(spark, sf), panel(spark, sf), (2, 5)), "rule", score="score")


ROWCORR = f"""fr AS (SELECT rule, symbol, pos, ({rank('value', 'rule, pos')}) / count(*) OVER (PARTITION BY rule, pos) AS rf FROM fc WHERE value IS NOT NULL),
fut AS (SELECT p.symbol, p.pos, q.close / p.close - 1 AS future FROM panel p JOIN panel q ON q.symbol = p.symbol AND q.pos = p.pos + 3),
gr AS (SELECT symbol, pos, ({rank('future', 'pos')}) / count(*) OVER (PARTITION BY pos) AS rg FROM fut),
rc AS (SELECT rule, pos, CASE WHEN count(*) >= 5 AND stddev_pop(rf) > 0 AND stddev_pop(rg) > 0 THEN corr(rf, rg) END AS ic FROM fr JOIN gr USING (symbol, pos) GROUP BY rule, pos)"""


@register("e06_row_corr", Q.query(*BASE, ROWCORR, select="SELECT rule, pos, round(ic, 6) AS ic FROM rc"))
def row_corr(spark, sf):
    df = K.row_corr(forecasts(spark, sf), K.future_returns(panel(spark, sf), 3), 5, ["rule"])
    return shown(df, "rule", "pos", ic="ic")


def project_sql(src: str, by: str, shrink: float, limit: float, out: str, raw: str = "weight") -> str:
    """Weights of ``src`` (by, rule, raw) shrunk and capped, in CTE ``out``."""
    p = f"PARTITION BY {by}" if by else ""
    return f"""{out}a AS (SELECT *, greatest(coalesce({raw}, 0), 0) AS w0 FROM {src}),
{out}b AS (SELECT *, {1 - shrink!r}::DOUBLE * CASE WHEN sum(w0) OVER ({p}) > 0 THEN w0 / sum(w0) OVER ({p}) ELSE 1::DOUBLE / count(*) OVER ({p}) END
    + {shrink!r}::DOUBLE * (1::DOUBLE / count(*) OVER ({p})) AS v FROM {out}a),
{out}c AS (SELECT *, row_number() OVER ({p} ORDER BY v DESC, rule) AS k, sum(v) OVER ({p}) AS total,
    coalesce(sum(v) OVER ({p} ORDER BY v DESC, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS larger FROM {out}b),
{out}d AS (SELECT *, (1 - (k - 1) * {limit}::DOUBLE) / (total - larger) AS r FROM {out}c),
{out} AS (SELECT * EXCLUDE (w0, v, k, total, larger, r), CASE WHEN v > 0 THEN least({limit}::DOUBLE, v * arg_min(r, k) FILTER (v * r <= {limit}::DOUBLE + 1e-12) OVER ({p})) ELSE 0 END AS pw FROM {out}d)"""


RAWW = """rw AS (SELECT c_mktsegment AS rule, 'N' || lpad(c_nationkey::VARCHAR, 2, '0') AS symbol, sum(CASE WHEN c_acctbal > 5000 THEN c_acctbal - 5000 ELSE 0 END) - 3000 AS weight
  FROM customer GROUP BY ALL)"""


def raw_weights(spark, sf):
    big = F.when(F.col("c_acctbal") > 5000, F.col("c_acctbal") - 5000).otherwise(F.lit(0.0))
    return P.table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("rule"), F.format_string("N%02d", "c_nationkey").alias("symbol")).agg(
        (F.sum(big) - 3000).alias("weight"))


@register("e07_shrink_cap", Q.query(RAWW, project_sql("rw", "symbol", 0.2, 0.3, "pr"), select="SELECT symbol, rule, round(pw, 6) AS weight FROM pr"))
def shrink_cap(spark, sf):
    return shown(K.shrink_cap(raw_weights(spark, sf), 0.2, 0.3, ["symbol"]), "symbol", "rule", weight="weight")


CORR = """corrs AS (SELECT a.rule AS a, b.rule AS b, CASE WHEN a.rule = b.rule THEN 1 ELSE coalesce(CASE WHEN isfinite(corr(a.value, b.value)) THEN corr(a.value, b.value) END, 0) END AS corr
  FROM fc a JOIN fc b ON a.symbol = b.symbol AND a.pos = b.pos WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY a.rule, b.rule)"""


@register("e08_rule_corr", Q.query(*BASE, CORR, select="SELECT a, b, round(corr, 6) AS corr FROM corrs"))
def rule_corr(spark, sf):
    return shown(K.rule_corr(forecasts(spark, sf), RULES), "a", "b", corr="corr")


@register("e09_avg_ticker_corr", Q.query(*BASE, f"""cw AS (SELECT symbol, pos FROM fc GROUP BY symbol, pos HAVING count(value) = {len(RULES)}),
ok AS (SELECT symbol FROM cw GROUP BY symbol HAVING count(*) >= 5),
tc AS (SELECT symbol, a.rule AS a, b.rule AS b, corr(a.value, b.value) AS c FROM cw JOIN ok USING (symbol) JOIN fc a USING (symbol, pos) JOIN fc b USING (symbol, pos) GROUP BY ALL)""", select="""
SELECT a, b, round(CASE WHEN a = b THEN 1 WHEN count(*) FILTER (NOT isfinite(c) OR c IS NULL) > 0 THEN 0 ELSE greatest(avg(c), 0) END, 6) AS corr FROM tc GROUP BY a, b"""))
def avg_ticker_corr(spark, sf):
    return shown(K.avg_ticker_corr(forecasts(spark, sf), RULES, 5), "a", "b", corr="corr")


@register("e10_fdm", Q.query(*BASE, CORR, scores_sql(1), project_sql("scores", "", 0.5, 0.4, "pr", raw="score"), select="""
SELECT round(CASE WHEN sum(x.pw * y.pw * corr) > 0 THEN least(1 / sqrt(sum(x.pw * y.pw * corr)), 2.5) ELSE 1 END, 6) AS fdm
FROM corrs JOIN pr x ON x.rule = a JOIN pr y ON y.rule = b"""))
def fdm(spark, sf):
    fc = forecasts(spark, sf)
    scores = K.pooled_rule_scores(fc, returns(spark, sf), 1).withColumnRenamed("score", "weight")
    return K.fdm(K.shrink_cap(scores, 0.5, 0.4), K.rule_corr(fc, RULES)).select(r6("fdm").alias("fdm"))


@register("e11_refit_dates", Q.query(Q.WEEKLY, CAL, *[refits_sql(s, f"rf_{s}") for s in ("quarterly", "semiannual", "annual", "frozen")], refits_sql("quarterly", "rf_trailing", 730),
    select="\nUNION ALL ".join(f"SELECT '{s}' AS schedule, refit, refit_ts, activation, start FROM rf_{s}" for s in ("quarterly", "semiannual", "annual", "frozen", "trailing"))))
def refit_dates(spark, sf):
    out = None
    for s in ("quarterly", "semiannual", "annual", "frozen", "trailing"):
        r = refits(spark, sf, "quarterly", 730) if s == "trailing" else refits(spark, sf, s)
        part = r.select(F.lit(s).alias("schedule"), "refit", "refit_ts", "activation", "start")
        out = part if out is None else out.unionByName(part)
    return out


PATH = f"""hist AS (SELECT f.*, refit FROM fc f JOIN refits ON f.pos >= start AND f.pos < refit),
sc AS (SELECT refit, rule, coalesce(10 / nullif(quantile_cont(abs(value), 0.5), 0), 1) AS scalar FROM hist GROUP BY ALL),
hs AS (SELECT h.*, scalar, {cap('h.value * scalar')} AS scaled FROM hist h JOIN sc USING (refit, rule)),
hp AS (SELECT hs.*, scaled / 10 * r.ret AS pnl FROM hs LEFT JOIN rets r ON r.symbol = hs.symbol AND r.pos = hs.pos + 2 AND hs.pos + 2 < refit),
he AS (SELECT refit, symbol, rule, CASE WHEN stddev_samp(pnl) > 0 THEN greatest(avg(pnl) / stddev_samp(pnl), 0) ELSE 0 END AS score FROM hp GROUP BY ALL),
hw AS (SELECT refit, rule, quantile_cont(score, 0.5) AS weight FROM he GROUP BY ALL),
{project_sql("hw", "refit", 0.8, 0.4, "pr")},
hc0 AS (SELECT a.refit, a.rule AS a, b.rule AS b, corr(a.scaled, b.scaled) AS c
  FROM hs a JOIN hs b ON a.refit = b.refit AND a.symbol = b.symbol AND a.pos = b.pos WHERE a.scaled IS NOT NULL AND b.scaled IS NOT NULL GROUP BY a.refit, a.rule, b.rule),
hc AS (SELECT x.refit, x.rule AS a, y.rule AS b, CASE WHEN x.rule = y.rule THEN 1 ELSE coalesce(CASE WHEN isfinite(c) THEN c END, 0) END AS corr
  FROM sc x JOIN sc y USING (refit) LEFT JOIN hc0 ON hc0.refit = x.refit AND hc0.a = x.rule AND hc0.b = y.rule),
hf AS (SELECT hc.refit, CASE WHEN sum(x.pw * y.pw * corr) > 0 THEN least(1 / sqrt(sum(x.pw * y.pw * corr)), 2.5) ELSE 1 END AS fdm
  FROM hc JOIN pr x ON x.refit = hc.refit AND x.rule = a JOIN pr y ON y.refit = hc.refit AND y.rule = b GROUP BY hc.refit),
path AS (SELECT pr.refit, pr.rule, scalar, pw AS weight, fdm FROM pr JOIN sc USING (refit, rule) JOIN hf USING (refit))"""


def path(spark, sf, days=None):
    """The refit parameters, written once because several later steps read them."""
    return K.calibration_path(forecasts(spark, sf), returns(spark, sf), refits(spark, sf, days=days), RULES, shrink=0.8, cap=0.4)


for _tag, _days in (("expanding", None), ("rolling", 730)):
    def _calibration(spark, sf, days=_days):
        return shown(path(spark, sf, days), "refit", "rule", scalar="scalar", weight="weight", fdm="fdm")

    register(f"e12_calibration_{_tag}", Q.query(*BASE, CAL, refits_sql("semiannual", days=_days), PATH, select="""
SELECT refit, rule, round(scalar, 6) AS scalar, round(weight, 6) AS weight, round(fdm, 6) AS fdm FROM path"""))(_calibration)

STEP = f"""steps AS (SELECT activation AS pos, rule, scalar, weight, fdm FROM path JOIN refits USING (refit)),
grid AS (SELECT cal.pos, cal.ts, r.rule FROM cal CROSS JOIN (SELECT DISTINCT rule FROM path) r),
stepped AS (SELECT g.ts, g.pos, g.rule, coalesce(s.scalar, 1) AS scalar, coalesce(s.weight, {1 / 3!r}) AS weight, coalesce(s.fdm, 1) AS fdm
  FROM grid g ASOF LEFT JOIN steps s ON s.rule = g.rule AND s.pos <= g.pos)"""


def params(spark, sf, smooth=1):
    return K.step_path(cut_lineage(path(spark, sf)), calendar(spark, sf), refits(spark, sf), {"scalar": 1.0, "weight": 1 / 3, "fdm": 1.0},
                       smooth=smooth, normalise="weight" if smooth > 1 else None)


@register("e13_step_path", Q.query(*BASE, CAL, refits_sql("semiannual"), PATH, STEP, select="""
SELECT ts, rule, round(scalar, 6) AS scalar, round(weight, 6) AS weight, round(fdm, 6) AS fdm FROM stepped"""))
def step_path(spark, sf):
    return shown(params(spark, sf), "ts", "rule", scalar="scalar", weight="weight", fdm="fdm")


SMOOTH = ",\n".join([Q.ewma_cte("sw", "stepped", "weight", 20, keys="rule"), Q.ewma_cte("ss", "stepped", "scalar", 20, keys="rule")])


@register("e13_step_path_smoothed", Q.query(*BASE, CAL, refits_sql("semiannual"), PATH, STEP, SMOOTH, recursive=True, select="""
SELECT sw.ts, sw.rule, round(ss.y, 6) AS scalar, round(sw.y / sum(sw.y) OVER (PARTITION BY sw.pos), 6) AS weight FROM sw JOIN ss USING (rule, pos)"""))
def step_path_smoothed(spark, sf):
    return shown(params(spark, sf, 20), "ts", "rule", scalar="scalar", weight="weight")


ICW = "icd AS (" + "\n  UNION ALL ".join(f"""SELECT rule, pos, {h} AS h, CASE WHEN count(*) >= 5 AND stddev_pop(rf) > 0 AND stddev_pop(rg) > 0 THEN corr(rf, rg) END AS ic
  FROM (SELECT rule, symbol, pos, ({rank('value', 'rule, pos')}) / count(*) OVER (PARTITION BY rule, pos) AS rf FROM fc WHERE value IS NOT NULL)
  JOIN (SELECT symbol, pos, ({rank('future', 'pos')}) / count(*) OVER (PARTITION BY pos) AS rg FROM (
    SELECT p.symbol, p.pos - 1 AS pos, q.close / p.close - 1 AS future FROM panel p JOIN panel q ON q.symbol = p.symbol AND q.pos = p.pos + {h})) USING (symbol, pos) GROUP BY rule, pos""" for h in (2, 5)) + f"""),
icr AS (SELECT refit, rule, h, avg(ic) AS ic FROM icd JOIN refits ON pos >= start AND pos + h + 1 < refit GROUP BY ALL),
icm AS (SELECT r.refit, u.rule, greatest(coalesce(m, 0), 0) AS weight FROM refits r CROSS JOIN (SELECT DISTINCT rule FROM fc) u
  LEFT JOIN (SELECT refit, rule, avg(ic) AS m FROM icr GROUP BY ALL) x ON x.refit = r.refit AND x.rule = u.rule),
{project_sql("icm", "refit", 0.8, 0.4, "icp")},
icsteps AS (SELECT activation AS pos, rule, pw FROM icp JOIN refits USING (refit)),
icpath AS (SELECT g.ts, g.pos, g.rule, coalesce(s.pw, {1 / 3!r}) AS weight FROM (SELECT cal.*, u.rule FROM cal CROSS JOIN (SELECT DISTINCT rule FROM fc) u) g
  ASOF LEFT JOIN icsteps s ON s.rule = g.rule AND s.pos <= g.pos),
{Q.ewma_cte("icsm", "icpath", "weight", 25, keys="rule")},
icw AS (SELECT ts, pos, rule, y / sum(y) OVER (PARTITION BY pos) AS weight FROM icsm)"""


def ic_weight_path(px):
    """Weights from a panel that is written once; every step reads the small panel instead of the orders."""
    cal = P.calendar(px, T.WEEK)
    return K.ic_weights(X.breakout_raw(px, HORIZONS), px.withColumn("open", F.col("close")), K.refit_dates(cal, "semiannual", LEAST, None),
                        cal, RULES, (2, 5), cap=0.4, smooth=25)


@register("e14_ic_weights", Q.query(*BASE, CAL, refits_sql("semiannual"), ICW, recursive=True, select="SELECT ts, rule, round(weight, 6) AS weight FROM icw"))
def ic_weights(spark, sf):
    return shown(ic_weight_path(cut_lineage(panel(spark, sf))), "ts", "rule", weight="weight")


@register("e14_ic_weighted_forecast", Q.query(*BASE, CAL, refits_sql("semiannual"), ICW, recursive=True, select=f"""
SELECT ts, symbol, round({cap('v')}, 6) AS f FROM (SELECT f.ts, f.symbol, sum(value * weight) / nullif(sum(weight) FILTER (value IS NOT NULL), 0) AS v
  FROM fc f JOIN icw w ON w.rule = f.rule AND w.pos = f.pos GROUP BY f.ts, f.symbol)"""))
def ic_weighted_forecast(spark, sf):
    px = cut_lineage(panel(spark, sf))
    df = K.combine(X.breakout_raw(px, HORIZONS), ic_weight_path(px).select("rule", "pos", "weight"), ("rule", "pos"))
    return shown(df, "ts", "symbol", f="f")


TURN = {"breakout_8": 90.0, "breakout_16": 45.0, "breakout_32": 20.0}
ELIG = f"""vols AS (SELECT symbol, pos, CASE WHEN count(ret) {frame(10)} >= 10 THEN stddev_samp(ret) {frame(10)} END * sqrt(365) AS vol FROM rets),
costs AS (SELECT 'N' || lpad(n_nationkey::VARCHAR, 2, '0') AS symbol, n_nationkey / 1000.0::DOUBLE AS maker, n_nationkey / 500.0::DOUBLE AS taker FROM nation),
turn AS (SELECT unnest(['breakout_8', 'breakout_16', 'breakout_32']) AS rule, unnest([90.0::DOUBLE, 45.0::DOUBLE, 20.0::DOUBLE]) AS expected_turnover),
el0 AS (SELECT r.*, c.symbol, t.*, maker * 0.5::DOUBLE + taker * 0.5::DOUBLE AS rate, v.vol FROM refits r CROSS JOIN costs c CROSS JOIN turn t LEFT JOIN vols v ON v.symbol = c.symbol AND v.pos = r.refit - 1),
el1 AS (SELECT *, CASE WHEN vol > 0 THEN rate / vol END AS cost_sr FROM el0),
elig AS (SELECT *, CASE WHEN rate <= 0 THEN NULL WHEN cost_sr > 0 THEN 0.15::DOUBLE / cost_sr ELSE 0 END AS maximum_turnover,
  rate <= 0 OR expected_turnover <= CASE WHEN cost_sr > 0 THEN 0.15::DOUBLE / cost_sr ELSE 0 END AS eligible FROM el1)"""


def eligible_records(spark, sf):
    costs = P.table(spark, sf, "nation").select(F.format_string("N%02d", "n_nationkey").alias("symbol"),
                                                (F.col("n_nationkey") / 1000.0).alias("maker"), (F.col("n_nationkey") / 500.0).alias("taker"))
    vol = X.causal_vol(panel(spark, sf), 10)
    return K.eligibility(vol, costs, refits(spark, sf), TURN, taker_share=0.5, slippage_bps=0.0)


@register("e15_eligibility", Q.query(Q.WEEKLY, Q.RETURNS, CAL, refits_sql("semiannual"), ELIG, select="""
SELECT refit, symbol, rule, expected_turnover, round(cost_sr, 8) AS cost_sr, round(maximum_turnover, 5) AS maximum_turnover, eligible,
  CASE WHEN eligible THEN 'within_cost_budget' ELSE 'exceeds_cost_budget' END AS reason FROM elig"""))
def eligibility(spark, sf):
    return eligible_records(spark, sf).select("refit", "symbol", "rule", "expected_turnover", r6("cost_sr", 8).alias("cost_sr"),
                                              r6("maximum_turnover", 5).alias("maximum_turnover"), "eligible", "reason")


COMB = f"""comb AS (SELECT f.ts, f.symbol, f.pos, sum({cap('f.value * scalar')} * weight) / nullif(sum(weight) FILTER (f.value IS NOT NULL), 0) * max(fdm) AS v
  FROM fc f JOIN stepped s ON s.rule = f.rule AND s.pos = f.pos GROUP BY f.ts, f.symbol, f.pos)"""


@register("e16_combine", Q.query(*BASE, CAL, refits_sql("semiannual"), PATH, STEP, COMB, select=f"SELECT ts, symbol, round({cap('v')}, 6) AS f FROM comb"))
def combine(spark, sf):
    df = K.combine(forecasts(spark, sf), params(spark, sf).select("rule", "pos", "scalar", "weight", "fdm"), ("rule", "pos"))
    return shown(df, "ts", "symbol", f="f")


CELIG = f"""eact AS (SELECT symbol, rule, activation AS pos, arg_max(eligible, refit) AS eligible FROM elig GROUP BY ALL),
hstep AS (SELECT activation AS pos, a, b, corr FROM hc JOIN refits USING (refit)),
cells AS (SELECT f.ts, f.symbol, f.pos, f.rule, {cap('f.value * scalar')} AS v, weight, coalesce(e.eligible, false) AS el
  FROM fc f JOIN stepped s ON s.rule = f.rule AND s.pos = f.pos ASOF LEFT JOIN eact e ON e.symbol = f.symbol AND e.rule = f.rule AND e.pos <= f.pos),
act AS (SELECT *, weight / sum(weight) OVER (PARTITION BY symbol, pos) AS share FROM cells WHERE el AND v IS NOT NULL),
pairs AS (SELECT x.symbol, x.pos, sum(x.share * y.share * CASE WHEN x.rule = y.rule THEN 1 ELSE coalesce(h.corr, 0) END) AS var
  FROM act x JOIN act y ON x.symbol = y.symbol AND x.pos = y.pos ASOF LEFT JOIN hstep h ON h.a = x.rule AND h.b = y.rule AND h.pos <= x.pos GROUP BY x.symbol, x.pos),
mean AS (SELECT symbol, pos, sum(v * share) AS m FROM act GROUP BY ALL)"""


@register("e17_combine_eligible", Q.query(*BASE, CAL, refits_sql("semiannual"), PATH, STEP, ELIG, CELIG, select=f"""
SELECT c.ts, c.symbol, round(coalesce({cap('m * greatest(least(1 / sqrt(var), 2.5), 1)')} / 20, 0), 6) AS f, round(CASE WHEN var > 0 THEN greatest(least(1 / sqrt(var), 2.5), 1) ELSE 1 END, 6) AS fdm
FROM (SELECT DISTINCT ts, symbol, pos FROM cells) c LEFT JOIN pairs USING (symbol, pos) LEFT JOIN mean USING (symbol, pos)"""))
def combine_eligible(spark, sf):
    p = cut_lineage(path(spark, sf))
    r, cal, fc = refits(spark, sf), calendar(spark, sf), forecasts(spark, sf)
    par = K.step_path(p, cal, r, {"scalar": 1.0, "weight": 1 / 3})
    steps = K.history_corr(fc, r, RULES, p.select("refit", "rule", "scalar"))
    corr = K.step_path(steps, cal, r, {"corr": 0.0}, keys=("a", "b"))
    daily = K.eligibility_daily(eligible_records(spark, sf), cal)
    df = K.combine_eligible(fc, par, corr, daily, RULES)
    return shown(df, "ts", "symbol", f="f", fdm="fdm")


FIXW = "fw AS (SELECT unnest(['breakout_8', 'breakout_16', 'breakout_32']) AS rule, unnest([0.2::DOUBLE, 0.3::DOUBLE, 0.5::DOUBLE]) AS weight)"


def fixed_weights(fc):
    w = F.when(F.col("rule") == "breakout_8", 0.2).when(F.col("rule") == "breakout_16", 0.3).otherwise(0.5)
    return fc.select("rule").distinct().withColumn("weight", w)


@register("e18_combine_fixed", Q.query(*BASE, FIXW, select=f"""
SELECT ts, symbol, round({cap('v')}, 6) AS f FROM (SELECT ts, symbol, sum(coalesce(value, 0) * weight) * 1.2::DOUBLE AS v FROM fc JOIN fw USING (rule) GROUP BY ts, symbol)"""))
def combine_fixed(spark, sf):
    fc = forecasts(spark, sf)
    return shown(K.combine_fixed(fc, fixed_weights(fc), 1.2), "ts", "symbol", f="f")


PERW = "perw AS (SELECT 'N' || lpad(n_nationkey::VARCHAR, 2, '0') AS symbol, r.rule, CASE r.rule WHEN 'breakout_8' THEN 1 + n_nationkey % 3 WHEN 'breakout_16' THEN 2 ELSE 1 END / 10::DOUBLE AS weight FROM nation CROSS JOIN (SELECT DISTINCT rule FROM fc) r)"


@register("e19_reference_forecasts", Q.query(*BASE, CAL, refits_sql("semiannual"), PATH, STEP, PERW, select=f"""
SELECT 'equal' AS mode, ts, symbol, round({cap('avg(value)')}, 6) AS f FROM fc GROUP BY ts, symbol
UNION ALL SELECT 'pooled', ts, symbol, round({cap('v')}, 6) FROM (SELECT f.ts, f.symbol, sum(value * weight) / nullif(sum(weight) FILTER (value IS NOT NULL), 0) AS v
  FROM fc f JOIN stepped s ON s.rule = f.rule AND s.pos = f.pos GROUP BY f.ts, f.symbol)
UNION ALL SELECT 'per_symbol', ts, symbol, round({cap('v')}, 6) FROM (SELECT ts, symbol, sum(value * weight) / nullif(sum(weight) FILTER (value IS NOT NULL), 0) AS v
  FROM fc JOIN perw USING (symbol, rule) GROUP BY ts, symbol)"""))
def reference_forecasts(spark, sf):
    fc = forecasts(spark, sf)
    n = P.table(spark, sf, "nation").select(F.format_string("N%02d", "n_nationkey").alias("symbol"), "n_nationkey")
    w = F.when(F.col("rule") == "breakout_8", 1 + F.col("n_nationkey") % 3).when(F.col("rule") == "breakout_16", 2).otherwise(1) / 10.0
    per = n.crossJoin(fc.select("rule").distinct()).select("symbol", "rule", w.alias("weight"))
    out = None
    for mode, weights in (("equal", None), ("pooled", params(spark, sf)), ("per_symbol", per)):
        part = shown(K.reference_forecasts(fc, mode, weights).withColumn("mode", F.lit(mode)), "mode", "ts", "symbol", f="f")
        out = part if out is None else out.unionByName(part)
    return out


@register("e20_forecast_blend", Q.query(*BASE, CAL, refits_sql("quarterly"), f"""x AS (SELECT a.ts, a.symbol, a.pos, a.value AS fa, b.value AS fb FROM fc a JOIN fc b ON b.symbol = a.symbol AND b.pos = a.pos AND b.rule = 'breakout_32' WHERE a.rule = 'breakout_8'),
bc AS (SELECT r.refit, r.activation AS pos, coalesce(CASE WHEN isfinite(corr(fa, fb)) THEN corr(fa, fb) END, 0) AS c FROM refits r LEFT JOIN x ON x.pos >= start AND x.pos < refit AND fa IS NOT NULL AND fb IS NOT NULL GROUP BY r.refit, r.activation),
bx AS (SELECT x.*, 0.5 + 0.5 * coalesce(c, 0) AS var FROM x ASOF LEFT JOIN bc ON bc.pos <= x.pos)""", select=f"""
SELECT ts, symbol, round({cap('(fa + fb) / 2 * greatest(least(CASE WHEN var > 0 THEN 1 / sqrt(var) ELSE 1 END, 2.5), 1)')} / 20, 6) AS f FROM bx"""))
def forecast_blend(spark, sf):
    fc = forecasts(spark, sf).withColumnRenamed("value", "f")
    df = K.forecast_blend(fc.filter("rule = 'breakout_8'"), fc.filter("rule = 'breakout_32'"), refits(spark, sf, "quarterly"), calendar(spark, sf))
    return shown(df, "ts", "symbol", f="f")


TRIALS = """trials AS (SELECT o_custkey AS trial, -avg(o_totalprice) / 100000 AS objective, [count(*) FILTER (o_orderstatus = 'F')::DOUBLE, count(*) FILTER (o_orderstatus = 'O')::DOUBLE, count(*) FILTER (o_orderpriority = '5-LOW')::DOUBLE] AS w
  FROM orders GROUP BY o_custkey),
best AS (SELECT *, w[1] + w[2] + w[3] AS total FROM trials QUALIFY row_number() OVER (ORDER BY objective, trial) <= greatest(1, floor(count(*) OVER () * 0.1::DOUBLE))),
flat AS (SELECT objective, unnest([0, 1, 2])::BIGINT AS rule, unnest(CASE WHEN total > 0 THEN [w[1] / total, w[2] / total, w[3] / total] ELSE [1 / 3::DOUBLE, 1 / 3::DOUBLE, 1 / 3::DOUBLE] END) AS x FROM best)"""


def trials(spark, sf):
    def n(cond):
        return F.count_if(cond).cast("double")
    return P.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("trial")).agg(
        (-F.avg("o_totalprice") / 100000).alias("objective"),
        F.array(n(F.col("o_orderstatus") == "F"), n(F.col("o_orderstatus") == "O"), n(F.col("o_orderpriority") == "5-LOW")).alias("weights"))


@register("e21_ensemble_trials", Q.query(TRIALS, select="""
SELECT rule, round(avg(x) / sum(avg(x)) OVER (), 6) AS weight, round(-avg(objective), 6) AS score, count(*) AS trials FROM flat GROUP BY rule"""))
def ensemble_trials(spark, sf):
    df = K.ensemble_trials(trials(spark, sf), 0.1)
    return df.select(F.col("rule").cast("bigint").alias("rule"), r6("weight").alias("weight"), r6("score").alias("score"), "trials")


@register("e22_mean_rule_signal", Q.query(*BASE, FIXW, """sx AS (SELECT ts, symbol, value * (0.5 + weight) AS x FROM fc JOIN fw USING (rule))""", select="""
SELECT ts, symbol, round(avg(CASE WHEN x < 20 AND x > -20 THEN x WHEN x < -20 THEN -20 ELSE 20 END) * 1.12::DOUBLE, 6) AS f FROM sx GROUP BY ts, symbol"""))
def mean_rule_signal(spark, sf):
    fc = forecasts(spark, sf)
    scalars = fixed_weights(fc).select("rule", (0.5 + F.col("weight")).alias("scalar"))
    return shown(K.mean_rule_signal(fc, scalars), "ts", "symbol", f="f")


@register("c10_weights_or_equal", Q.query(TRIALS, select="""
SELECT trial, w[1] + w[2] + w[3] <= 0 OR trial % 7 = 0 OR trial % 11 = 0 AS fallback,
  round(CASE WHEN w[1] + w[2] + w[3] <= 0 OR trial % 7 = 0 OR trial % 11 = 0 THEN 1 / 3::DOUBLE ELSE w[1] / (w[1] + w[2] + w[3]) END, 6) AS first,
  round(CASE WHEN w[1] + w[2] + w[3] <= 0 OR trial % 7 = 0 OR trial % 11 = 0 THEN 1 / 3::DOUBLE ELSE w[3] / (w[1] + w[2] + w[3]) END, 6) AS third FROM trials"""))
def weights_or_equal(spark, sf):
    t = trials(spark, sf)
    w = F.when(F.col("trial") % 7 == 0, F.slice("weights", 1, 2)).when(
        F.col("trial") % 11 == 0, F.transform("weights", lambda v: F.lit(float("nan")))).otherwise(F.col("weights"))
    df = K.weights_or_equal(t.withColumn("weights", w), 3)
    return df.select("trial", "fallback", r6(F.col("weights")[0]).alias("first"), r6(F.col("weights")[2]).alias("third"))
