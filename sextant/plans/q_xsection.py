"""Queries for cross-sectional ranks, weights and risk scaling on the weekly panel.

The forecast is the four-week return, volatility and beta use short windows so
that the smallest tables fill them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.operators import signals as X
from sextant.operators import xsection as C
from sextant.plans import panels as P
from sextant.plans import sqltext as Q
from sextant.plans.q_signals import BETA, frame
from sextant.plans.registry import register, shown
from sextant.session import cut_lineage

N = 8

SIG = f"""sig AS (
  SELECT r.ts, r.symbol, r.pos, r.close, r.ret, (r.close / q.close - 1) * 10 AS f,
    CASE WHEN count(ret) {frame(N).replace('symbol', 'r.symbol').replace('pos', 'r.pos')} >= {N}
      THEN stddev_samp(ret) {frame(N).replace('symbol', 'r.symbol').replace('pos', 'r.pos')} END * sqrt(365) AS vol
  FROM rets r LEFT JOIN panel q ON q.symbol = r.symbol AND q.pos = r.pos - 4)"""
RANKS = """ranks AS (
  SELECT *, (rank() OVER (PARTITION BY pos ORDER BY f) + (count(*) OVER (PARTITION BY pos, f) - 1) / 2::DOUBLE)
            / count(*) OVER (PARTITION BY pos) AS p
  FROM sig WHERE f IS NOT NULL
  UNION ALL SELECT *, NULL FROM sig WHERE f IS NULL)"""
BASE = (Q.WEEKLY, Q.RETURNS, SIG, RANKS)
NEUTRAL = """centred AS (SELECT *, p - avg(p) OVER (PARTITION BY pos) AS x FROM ranks),
neutral AS (SELECT ts, symbol, pos, f, coalesce(x / nullif(sum(abs(x)) OVER (PARTITION BY pos), 0), 0) AS w FROM centred)"""


def signals(spark, sf):
    """(ts, symbol, pos, close, ret, f, vol), written once: ranks and totals read it several times."""
    df = X.pct_change(P.weekly_panel(spark, sf))
    df = X.pct_change(df, k=4, out="f").withColumn("f", F.col("f") * 10)
    return cut_lineage(X.causal_vol(df, N))


def with_beta(df):
    return X.rolling_beta(df, "N00", 12)


def weights(df):
    return shown(df, "ts", "symbol", w="w")


@register("f01_percentile_rank", Q.query(*BASE, select="SELECT ts, symbol, round(p, 6) AS p FROM ranks"))
def percentile_rank(spark, sf):
    return shown(C.xs_percentile(signals(spark, sf)), "ts", "symbol", p="p")


@register("f02_signed_norm", Q.query(*BASE, select="""
SELECT ts, symbol, round(coalesce(f / nullif(sum(abs(f)) OVER (PARTITION BY pos), 0), 0), 6) AS w FROM ranks"""))
def signed_norm(spark, sf):
    return weights(C.signed_norm(signals(spark, sf)))


@register("f03_rank_weights", Q.query(*BASE, select="""
SELECT ts, symbol, round(coalesce((p - 0.5) / nullif(sum(abs(p - 0.5)) OVER (PARTITION BY pos), 0), 0), 6) AS w FROM ranks"""))
def rank_weights(spark, sf):
    return weights(C.rank_weights(C.xs_percentile(signals(spark, sf))))


@register("f04_dollar_neutral", Q.query(*BASE, NEUTRAL, select="SELECT ts, symbol, round(w, 6) AS w FROM neutral"))
def dollar_neutral(spark, sf):
    return weights(C.dollar_neutral(C.xs_percentile(signals(spark, sf))))


BASKET = """SELECT ts, symbol, pos,
  CASE WHEN p >= {hi} THEN 0.5::DOUBLE / sum((p >= {hi})::INT) OVER (PARTITION BY pos) ELSE 0 END
  - CASE WHEN p <= {lo} THEN 0.5::DOUBLE / sum((p <= {lo})::INT) OVER (PARTITION BY pos) ELSE 0 END AS w FROM ranks"""


@register("f05_basket", Q.query(*BASE, select=f"""
SELECT ts, symbol, round(w, 6) AS w FROM ({BASKET.format(hi='0.8::DOUBLE', lo='0.2::DOUBLE')})"""))
def basket(spark, sf):
    return weights(C.basket(C.xs_percentile(signals(spark, sf)), 0.2))


LONG_ONLY = """SELECT ts, symbol, pos, CASE WHEN p >= 0.8::DOUBLE AND f > 0
  THEN 1::DOUBLE / sum((p >= 0.8::DOUBLE AND f > 0)::INT) OVER (PARTITION BY pos) ELSE 0 END AS w FROM ranks"""


@register("f06_long_only", Q.query(*BASE, select=f"SELECT ts, symbol, round(w, 6) AS w FROM ({LONG_ONLY})"))
def long_only(spark, sf):
    return weights(C.long_only(C.xs_percentile(signals(spark, sf)), 0.2))


# membership by recursion over the bars of each series, one step at a time
BUFFERED = """steps AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY pos) AS rn FROM ranks),
walk{tag} AS (
  SELECT ts, symbol, pos, rn, coalesce(p >= 0.8::DOUBLE, false) AS l, coalesce(p <= 0.2::DOUBLE, false) AS s FROM steps WHERE rn = 1
  UNION ALL
  SELECT n.ts, n.symbol, n.pos, n.rn,
    coalesce(n.p >= 0.8::DOUBLE, false) OR (k.l AND n.pos = k.pos + 1 AND coalesce(n.p >= 0.8::DOUBLE - {b}::DOUBLE, false)),
    coalesce(n.p <= 0.2::DOUBLE, false) OR (k.s AND n.pos = k.pos + 1 AND coalesce(n.p <= 0.2::DOUBLE + {b}::DOUBLE, false))
  FROM walk{tag} k JOIN steps n ON n.symbol = k.symbol AND n.rn = k.rn + 1),
buffered{tag} AS (SELECT ts, symbol, pos, CASE WHEN l THEN 0.5::DOUBLE / sum(l::INT) OVER (PARTITION BY pos) ELSE 0 END
  - CASE WHEN s THEN 0.5::DOUBLE / sum(s::INT) OVER (PARTITION BY pos) ELSE 0 END AS w FROM walk{tag})"""


@register("f07_buffered_basket", Q.query(*BASE, BUFFERED.format(tag="", b="0.1"), recursive=True,
                                         select="SELECT ts, symbol, round(w, 6) AS w FROM buffered"))
def buffered_basket(spark, sf):
    return weights(C.buffered_basket(C.xs_percentile(signals(spark, sf)), 0.2, 0.1))


@register("f08_rank_buffer", Q.query(*BASE, f"desired AS ({BASKET.format(hi='0.8::DOUBLE', lo='0.2::DOUBLE')})", select="""
SELECT d.ts, d.symbol, round(CASE WHEN (q.w > 0 AND r.p >= 0.6::DOUBLE) OR (q.w < 0 AND r.p <= 0.4::DOUBLE) THEN q.w ELSE d.w END, 6) AS w
FROM desired d JOIN ranks r USING (symbol, pos) LEFT JOIN desired q ON q.symbol = d.symbol AND q.pos = d.pos - 1"""))
def rank_buffer(spark, sf):
    ranked = C.xs_percentile(signals(spark, sf))
    desired = C.basket(ranked, 0.2)
    previous = desired.withColumn("pos", F.col("pos") + 1)
    return weights(C.rank_buffer(desired, previous, 0.6))


RESIDUAL = """residual AS (
  SELECT s.ts, s.symbol, s.pos, s.f - b.beta * q.f AS f
  FROM sig s JOIN betas b USING (symbol, pos) LEFT JOIN sig q ON q.symbol = 'N00' AND q.pos = s.pos)"""


@register("f09_residualize", Q.query(*BASE, BETA, RESIDUAL, select="SELECT ts, symbol, round(f, 6) AS f FROM residual"))
def residualize(spark, sf):
    return shown(C.residualize(with_beta(signals(spark, sf)), "N00"), "ts", "symbol", f="f")


BETA_NEUTRAL = """bn AS (
  SELECT n.ts, n.symbol, n.pos, n.w, coalesce(b.beta, 0) AS z FROM neutral n JOIN betas b USING (symbol, pos)),
bn2 AS (SELECT *, sum(w * z) OVER (PARTITION BY pos) AS wz, sum(z * z) OVER (PARTITION BY pos) AS zz FROM bn),
bn3 AS (SELECT *, CASE WHEN zz > 0 THEN w - z * wz / zz ELSE w END AS v FROM bn2),
bn4 AS (SELECT *, sum(abs(v)) OVER (PARTITION BY pos) AS g FROM bn3),
constrained AS (SELECT ts, symbol, pos, v * CASE WHEN g > 0 THEN least(1, g) / g ELSE 1 END AS w FROM bn4)"""


@register("f10_beta_neutral", Q.query(*BASE, BETA, NEUTRAL, BETA_NEUTRAL,
                                      select="SELECT ts, symbol, round(w, 6) AS w FROM constrained"))
def beta_neutral(spark, sf):
    df = C.dollar_neutral(C.xs_percentile(with_beta(signals(spark, sf))))
    return weights(C.beta_neutral(df))


HEDGED = """hb AS (SELECT n.ts, n.pos, coalesce(sum(n.w * b.beta), 0) AS pb,
    coalesce(nullif(max(CASE WHEN n.symbol = 'N00' THEN b.beta END), 0), 1) AS bb
  FROM neutral n JOIN betas b USING (symbol, pos) GROUP BY n.ts, n.pos),
hu AS (SELECT ts, symbol, pos, sum(w) AS w FROM (
    SELECT ts, symbol, pos, w FROM neutral UNION ALL SELECT ts, 'N00', pos, -pb / bb FROM hb) GROUP BY ts, symbol, pos),
hedged AS (SELECT ts, symbol, pos, coalesce(w / nullif(sum(abs(w)) OVER (PARTITION BY pos), 0), 0) AS w FROM hu)"""


@register("f11_beta_hedge", Q.query(*BASE, BETA, NEUTRAL, HEDGED,
                                    select="SELECT ts, symbol, round(w, 6) AS w FROM hedged"))
def beta_hedge(spark, sf):
    df = C.dollar_neutral(C.xs_percentile(with_beta(signals(spark, sf))))
    return weights(C.beta_hedge(df, "N00"))


# the first k (largest first) whose share of what is left fits under the cap
CAPPED = """c0 AS (SELECT *, abs(coalesce(raw, 0)) AS a FROM {src}),
c1 AS (SELECT *, CASE WHEN a > 0 THEN row_number() OVER (PARTITION BY pos ORDER BY a DESC, symbol) END AS k,
    sum(a) OVER (PARTITION BY pos) AS total, sum((a > 0)::INT) OVER (PARTITION BY pos) AS n,
    coalesce(sum(a) OVER (PARTITION BY pos ORDER BY a DESC, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS larger FROM c0),
c2 AS (SELECT *, greatest({cap}::DOUBLE, 1::DOUBLE / nullif(n, 0)) AS ecap FROM c1),
c3 AS (SELECT *, (1 - (k - 1) * ecap) / (total - larger) AS r FROM c2),
c4 AS (SELECT *, arg_min(r, k) FILTER (a * r <= ecap + 1e-12) OVER (PARTITION BY pos) AS rr FROM c3),
budgets AS (SELECT * EXCLUDE (a, k, total, n, larger, r, rr, ecap), CASE WHEN a > 0 THEN least(ecap, a * rr) ELSE 0 END AS budget FROM c4)"""
RAWSIG = "rawsig AS (SELECT *, f AS raw FROM sig)"


@register("f12_cap_budget", Q.query(*BASE, RAWSIG, CAPPED.format(src="rawsig", cap=0.1),
                                    select="SELECT ts, symbol, round(budget, 6) AS budget FROM budgets"))
def cap_budget(spark, sf):
    return shown(C.cap_budget(signals(spark, sf), 0.1, raw="f"), "ts", "symbol", budget="budget")


UNITS = f"""inv AS (SELECT *, CASE WHEN vol > 0 THEN sign(coalesce(raw, 0)) * budget / vol ELSE 0 END AS u FROM budgets),
earned AS (SELECT i.pos + 1 AS pos, sum(i.u * coalesce(r.ret, 0)) AS e
  FROM inv i JOIN rets r ON r.symbol = i.symbol AND r.pos = i.pos + 1 GROUP BY i.pos + 1),
daily AS (SELECT b.pos, coalesce(e, 0) AS e FROM (SELECT DISTINCT pos FROM inv) b LEFT JOIN earned USING (pos)),
pred AS (SELECT pos, CASE WHEN count(e) OVER h >= {N} THEN stddev_samp(e) OVER h END * sqrt(365) AS predicted
  FROM daily WINDOW h AS (ORDER BY pos RANGE BETWEEN {N - 1} PRECEDING AND CURRENT ROW)),
units AS (SELECT i.ts, i.symbol, i.pos, CASE WHEN predicted > 0 THEN u / predicted ELSE 0 END AS unit
  FROM inv i JOIN pred USING (pos))"""


@register("f13_risk_unit", Q.query(*BASE, RAWSIG, CAPPED.format(src="rawsig", cap=0.1), UNITS,
                                   select="SELECT ts, symbol, round(unit, 6) AS unit FROM units"))
def risk_unit(spark, sf):
    return shown(units(spark, sf), "ts", "symbol", unit="unit")


def units(spark, sf):
    df = signals(spark, sf)
    return C.risk_unit(df.withColumn("raw", F.col("f")), 0.1, N, returns=df)


TARGET = """targets AS (SELECT ts, symbol, pos, unit * least({t}::DOUBLE, coalesce({g}::DOUBLE / nullif(sum(abs(unit)) OVER (PARTITION BY pos), 0), {t}::DOUBLE)) AS w FROM units)"""


@register("f14_scale_to_target", Q.query(*BASE, RAWSIG, CAPPED.format(src="rawsig", cap=0.1), UNITS,
                                         TARGET.format(t=0.2, g=1.5),
                                         select="SELECT ts, symbol, round(w, 6) AS w FROM targets"))
def scale_to_target(spark, sf):
    return weights(C.scale_to_target(units(spark, sf), 0.2, 1.5))


@register("f15_sleeve", Q.query(
    *BASE, f"rawbasket AS (SELECT s.*, b.w AS raw FROM sig s JOIN ({BASKET.format(hi='0.8::DOUBLE', lo='0.2::DOUBLE')}) b USING (symbol, pos))",
    CAPPED.format(src="rawbasket", cap=0.1), UNITS, TARGET.format(t=0.2, g=1.5),
    select="SELECT ts, symbol, round(w, 6) AS w FROM targets"))
def sleeve(spark, sf):
    return weights(C.construct_sleeve(signals(spark, sf), "basket", cap=0.1, lookback=N, target=0.2, gross_cap=1.5))


RES_RANKS = """rr AS (SELECT *, (rank() OVER (PARTITION BY pos ORDER BY f) + (count(*) OVER (PARTITION BY pos, f) - 1) / 2::DOUBLE)
    / count(*) OVER (PARTITION BY pos) AS p FROM residual WHERE f IS NOT NULL
  UNION ALL SELECT *, NULL FROM residual WHERE f IS NULL),
rr2 AS (SELECT *, p - avg(p) OVER (PARTITION BY pos) AS x FROM rr),
resneutral AS (SELECT ts, symbol, coalesce(x / nullif(sum(abs(x)) OVER (PARTITION BY pos), 0), 0) AS w FROM rr2)"""
B5 = BUFFERED.format(tag="5", b="0.05")
B10 = BUFFERED.format(tag="10", b="0.1").split("\n", 1)[1]


@register("f16_constructions", Q.query(*BASE, BETA, NEUTRAL, BETA_NEUTRAL, HEDGED, RESIDUAL, RES_RANKS, B5, B10, recursive=True,
    select="SELECT ts, symbol, construction, round(w, 6) AS w FROM (\n" + "\nUNION ALL ".join([
        "SELECT ts, symbol, 'signed_unhedged' AS construction, coalesce(f / nullif(sum(abs(f)) OVER (PARTITION BY pos), 0), 0) AS w FROM ranks",
        "SELECT ts, symbol, 'dollar_neutral', w FROM neutral",
        *[f"SELECT ts, symbol, 'basket_{n}', w FROM ({BASKET.format(hi=f'{1 - n / 100}::DOUBLE', lo=f'{n / 100}::DOUBLE')})" for n in (10, 20, 30)],
        f"SELECT ts, symbol, 'long_only_20', w FROM ({LONG_ONLY})",
        "SELECT ts, symbol, 'bench_hedged', w FROM hedged",
        "SELECT ts, symbol, 'beta_constrained', w FROM constrained",
        "SELECT ts, symbol, 'bench_residualized', w FROM resneutral",
        "SELECT ts, symbol, 'basket20_buffer5', w FROM buffered5",
        "SELECT ts, symbol, 'basket20_buffer10', w FROM buffered10"]) + ")"))
def constructions(spark, sf):
    df = C.constructions(with_beta(signals(spark, sf)), "N00")
    return shown(df, "ts", "symbol", "construction", w="w")


@register("f17_benchmark_weights", Q.query(Q.WEEKLY, """fdv AS (
  SELECT 'N' || lpad(c_nationkey::VARCHAR, 2, '0') AS symbol, sum(round(c_acctbal * 100)::BIGINT)::BIGINT / 100.0::DOUBLE AS fdv
  FROM customer GROUP BY c_nationkey),
ord AS (SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS i FROM (SELECT DISTINCT symbol FROM panel))""", select="""
SELECT ts, symbol, 'buy_hold' AS kind, CASE WHEN symbol = 'N00' THEN 1::DOUBLE ELSE 0 END AS w FROM panel
UNION ALL SELECT ts, symbol, 'equal', round(1::DOUBLE / count(*) OVER (PARTITION BY pos), 6) FROM panel
UNION ALL SELECT ts, symbol, 'fdv', round(fdv / sum(fdv) OVER (PARTITION BY pos), 6) FROM panel JOIN fdv USING (symbol)
UNION ALL SELECT ts, symbol, 'no_skill', round((CASE WHEN i % 2 = 0 THEN 1::DOUBLE ELSE -1 END) / count(*) OVER (PARTITION BY pos), 6)
FROM panel JOIN ord USING (symbol)"""))
def benchmark_weights(spark, sf):
    panel = P.weekly_panel(spark, sf)
    fdv = P.table(spark, sf, "customer").groupBy(F.format_string("N%02d", "c_nationkey").alias("symbol")).agg(
        (F.sum(F.round(F.col("c_acctbal") * 100).cast("bigint")) / 100.0).alias("fdv"))
    out = None
    for kind in ("buy_hold", "equal", "fdv", "no_skill"):
        part = shown(C.benchmark_weights(panel, kind, benchmark="N00", fdv=fdv).withColumn("kind", F.lit(kind)),
                     "ts", "symbol", "kind", w="w")
        out = part if out is None else out.unionByName(part)
    return out


@register("f17_random_signs", Q.query(Q.WEEKLY, select="""
SELECT ts, symbol, round((CASE WHEN ('0x' || substr(md5('20260921|' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '|' || symbol), 1, 8))::BIGINT % 2 = 0
  THEN 1::DOUBLE ELSE -1 END) / count(*) OVER (PARTITION BY pos), 6) AS w FROM panel"""))
def random_signs(spark, sf):
    return weights(C.benchmark_weights(P.weekly_panel(spark, sf), "random_sign", seed=20260921))


HELD3 = """held AS (
  SELECT ts, symbol, pos, 'basket' AS strategy, w * 2 AS held, 0.1::DOUBLE AS target_vol FROM basket20
  UNION ALL SELECT ts, symbol, pos, 'neutral', w, 0.2::DOUBLE FROM neutral
  UNION ALL SELECT ts, symbol, pos, 'signed', coalesce(f / nullif(sum(abs(f)) OVER (PARTITION BY pos), 0), 0), 0.05::DOUBLE FROM ranks)"""


@register("f18_equal_risk_ensemble", Q.query(
    *BASE, NEUTRAL, f"basket20 AS ({BASKET.format(hi='0.8::DOUBLE', lo='0.2::DOUBLE')})", HELD3, """
e1 AS (SELECT ts, symbol, pos, sum(held / target_vol) / (SELECT count(DISTINCT strategy) FROM held) * 0.2::DOUBLE AS u
  FROM held GROUP BY ts, symbol, pos)""", select="""
SELECT ts, symbol, round(greatest(least(u * least(1, coalesce(3::DOUBLE / nullif(sum(abs(u)) OVER (PARTITION BY pos), 0), 0)), 0.4::DOUBLE), -0.4::DOUBLE), 6) AS w FROM e1"""))
def equal_risk_ensemble(spark, sf):
    return weights(C.equal_risk_ensemble(strategies(spark, sf)))


def strategies(spark, sf):
    ranked = C.xs_percentile(signals(spark, sf))
    cols = ("ts", "symbol", "pos", "strategy", "held", "target_vol")
    a = C.basket(ranked, 0.2).withColumn("held", F.col("w") * 2).withColumn("strategy", F.lit("basket")).withColumn("target_vol", F.lit(0.1))
    b = C.dollar_neutral(ranked).withColumn("held", F.col("w")).withColumn("strategy", F.lit("neutral")).withColumn("target_vol", F.lit(0.2))
    c = C.signed_norm(ranked).withColumn("held", F.col("w")).withColumn("strategy", F.lit("signed")).withColumn("target_vol", F.lit(0.05))
    return a.select(*cols).unionByName(b.select(*cols)).unionByName(c.select(*cols))


@register("f19_sleeve_blend", Q.query(
    *BASE, RAWSIG, CAPPED.format(src="rawsig", cap=0.1), UNITS, f"""
second AS (SELECT u.ts, u.symbol, u.pos, (u.unit + b.w) / 2 AS u FROM units u
  JOIN ({BASKET.format(hi='0.8::DOUBLE', lo='0.2::DOUBLE')}) b USING (symbol, pos)),
earned2 AS (SELECT i.pos + 1 AS pos, sum(i.u * coalesce(r.ret, 0)) AS e
  FROM second i JOIN rets r ON r.symbol = i.symbol AND r.pos = i.pos + 1 GROUP BY i.pos + 1),
daily2 AS (SELECT b.pos, coalesce(e, 0) AS e FROM (SELECT DISTINCT pos FROM second) b LEFT JOIN earned2 USING (pos)),
pred2 AS (SELECT pos, CASE WHEN count(e) OVER h >= {N} THEN stddev_samp(e) OVER h END * sqrt(365) AS predicted
  FROM daily2 WINDOW h AS (ORDER BY pos RANGE BETWEEN {N - 1} PRECEDING AND CURRENT ROW)),
norms AS (SELECT a.ts, a.symbol, (a.w + b.w) / 2 AS w FROM
  (SELECT ts, symbol, pos, coalesce(unit / nullif(sum(abs(unit)) OVER (PARTITION BY pos), 0), 0) AS w FROM units) a
  JOIN (SELECT symbol, pos, coalesce(w / nullif(sum(abs(w)) OVER (PARTITION BY pos), 0), 0) AS w
        FROM ({BASKET.format(hi='0.8::DOUBLE', lo='0.2::DOUBLE')})) b USING (symbol, pos))""", select="""
SELECT s.ts, s.symbol, round(CASE WHEN predicted > 0 THEN u / predicted ELSE 0 END, 6) AS unit, round(n.w, 6) AS w
FROM second s JOIN pred2 USING (pos) JOIN norms n ON n.ts = s.ts AND n.symbol = s.symbol"""))
def sleeve_blend(spark, sf):
    df = signals(spark, sf)
    first = C.risk_unit(df.withColumn("raw", F.col("f")), 0.1, N, returns=df)
    second = C.basket(C.xs_percentile(df), 0.2, out="unit")
    blend = C.sleeve_blend(first, second, df, N)
    norms = C.average_of_norms(first, second, "unit").select("ts", "symbol", "w")
    return shown(blend.join(norms, ["ts", "symbol"]), "ts", "symbol", unit="unit", w="w")


TOPN = """picked AS (
  SELECT *, 1::DOUBLE AS side FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY f DESC, symbol) AS k FROM sig WHERE f > 0) WHERE k <= 5
  UNION ALL
  SELECT *, -1::DOUBLE FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY -f DESC, symbol) AS k FROM sig WHERE f < 0) WHERE k <= 5)"""


@register("f20_topn_long_short", Q.query(*BASE, TOPN, select="""
SELECT ts, symbol, round(0.5::DOUBLE * side * (1 / coalesce(nullif(vol, 0), 0.0001::DOUBLE))
  / sum(1 / coalesce(nullif(vol, 0), 0.0001::DOUBLE)) OVER (PARTITION BY pos, side), 6) AS w FROM picked"""))
def topn_long_short(spark, sf):
    return weights(C.topn_long_short(signals(spark, sf), 5, 5))
