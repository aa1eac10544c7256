"""Queries for universe membership, walk-forward folds, grid scoring and study tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.functions import timeaxis as T
from sextant.operators import accounting as G
from sextant.operators import metrics as M
from sextant.operators import selection as I
from sextant.operators import universe as U
from sextant.operators import xsection as C
from sextant.plans import panels as P
from sextant.plans import q_accounting as A
from sextant.plans import q_metrics as QM
from sextant.plans import q_sources as QS
from sextant.plans import q_xsection as QX
from sextant.plans import sqltext as Q
from sextant.plans.registry import r6, register, shown
from sextant.session import cut_lineage


# --- universe -------------------------------------------------------------------------------

def contract_payload(spark, sf):
    """One metadata document per nation with its customers as contracts."""
    c = P.table(spark, sf, "customer")
    k = F.col("c_custkey")
    row = F.struct(
        F.concat(F.lit("C"), k.cast("string"), F.when(k % 13 == 0, "BUSD").otherwise("USDT")).alias("symbol"),
        F.when(k % 9 != 0, F.concat(F.lit("C"), k.cast("string"))).alias("baseAsset"),
        F.when(k % 13 == 0, "BUSD").otherwise("USDT").alias("quoteAsset"),
        F.when(k % 5 == 0, "CURRENT_QUARTER").otherwise("PERPETUAL").alias("contractType"),
        F.when(k % 4 == 0, "SETTLING").otherwise("TRADING").alias("status"),
        F.when(k % 6 == 0, F.lit(0)).otherwise(1_500_000_000_000 + k * 86_400_000).cast("bigint").alias("onboardDate"),
        (1_700_000_000_000 + k * 1000).alias("deliveryDate"))
    return c.groupBy("c_nationkey").agg(F.to_json(F.struct(F.collect_list(row).alias("symbols"))).alias("payload"))


CONTRACTS = """contracts AS (SELECT 'C' || c_custkey || 'USDT' AS symbol, 'C' || c_custkey AS base_asset,
  CASE WHEN c_custkey % 6 <> 0 THEN TIMESTAMP '1970-01-01' + to_milliseconds(1500000000000 + c_custkey * 86400000) END AS listing_time,
  CASE WHEN c_custkey % 4 = 0 THEN TIMESTAMP '1970-01-01' + to_milliseconds(1700000000000 + c_custkey * 1000) END AS delisting_time
  FROM customer WHERE c_custkey % 13 <> 0 AND c_custkey % 5 <> 0)"""


def contracts(spark, sf):
    return U.eligible_contracts(contract_payload(spark, sf))


@register("c01_eligible_contracts", Q.query(CONTRACTS, select="SELECT * FROM contracts"))
def eligible_contracts(spark, sf):
    return contracts(spark, sf)


PROVIDER = """prov AS (SELECT c_custkey AS provider_id, upper('c' || (c_custkey % 700)) AS symbol, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS fdv FROM customer),
win AS (SELECT symbol AS base_asset, provider_id, fdv, count(*) OVER (PARTITION BY symbol) AS candidate_count FROM prov
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY fdv IS NULL, fdv DESC, provider_id) = 1),
resolved AS (SELECT c.*, provider_id, fdv, candidate_count, CASE WHEN provider_id IS NOT NULL THEN 'gecko:symbol=' || c.base_asset || ';candidates=' || candidate_count END AS provenance FROM contracts c LEFT JOIN win USING (base_asset))"""


def provider_rows(spark, sf):
    c = P.table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("provider_id"), F.concat(F.lit("c"), (F.col("c_custkey") % 700).cast("string")).alias("symbol"),
                    F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("fdv"))


def resolved(spark, sf):
    return U.resolve_assets(contracts(spark, sf), provider_rows(spark, sf), "gecko")


@register("c02_resolve_assets", Q.query(CONTRACTS, PROVIDER, select="SELECT symbol, base_asset, provider_id, fdv, candidate_count, provenance FROM resolved"))
def resolve_assets(spark, sf):
    return resolved(spark, sf).select("symbol", "base_asset", "provider_id", "fdv", "candidate_count", "provenance")


@register("c03_provider_cascade", Q.query(CONTRACTS, PROVIDER, select="SELECT provider_id, lower(symbol) AS symbol, fdv, 'second' AS provider FROM prov"))
def provider_cascade(spark, sf):
    rows = provider_rows(spark, sf)
    empty = rows.withColumn("fdv", F.lit(None).cast("double"))
    return U.provider_cascade([("first", empty), ("second", rows), ("third", rows)])


VOLUME = """vol AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS ts, 'C' || o_custkey || 'USDT' AS symbol, sum(round(o_totalprice * 100)::BIGINT)::BIGINT / 100000.0::DOUBLE AS quote FROM orders GROUP BY ALL),
med AS (SELECT symbol, quantile_cont(quote, 0.5) AS median_volume FROM vol WHERE ts IN (SELECT DISTINCT ts FROM vol ORDER BY ts DESC LIMIT 30) GROUP BY symbol)"""


def volumes(spark, sf):
    o = P.table(spark, sf, "orders").groupBy(T.month(F.col("o_orderdate")).alias("ts"), F.concat(F.lit("C"), F.col("o_custkey").cast("string"), F.lit("USDT")).alias("symbol")).agg(
        (F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")) / 100_000.0).alias("quote"))
    return U.trailing_median_volume(o, 30)


@register("c04_trailing_median_volume", Q.query(VOLUME, select="SELECT symbol, round(median_volume, 6) AS median_volume FROM med"))
def trailing_median_volume(spark, sf):
    return volumes(spark, sf).select("symbol", r6("median_volume", 6).alias("median_volume"))


def month_sql(name: str, fdv: str, prev: str | None) -> str:
    limit = "100" if prev is None else f"CASE WHEN symbol IN (SELECT symbol FROM {prev} WHERE member) THEN 110 ELSE 90 END"
    return f"""{name}a AS (SELECT symbol, {fdv} AS fdv, median_volume AS volume, base_asset IN ('C11', 'C22') AS stable FROM resolved LEFT JOIN med USING (symbol)),
{name}b AS (SELECT *, fdv IS NOT NULL AND coalesce(volume >= 150, false) AND NOT stable AS eligible FROM {name}a),
{name}c AS (SELECT *, CASE WHEN eligible THEN row_number() OVER (PARTITION BY eligible ORDER BY fdv DESC, symbol) END AS rank FROM {name}b),
{name} AS (SELECT *, coalesce(rank <= {limit} AND sum((rank <= {limit})::INT) OVER (ORDER BY rank NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= 100, false) AS member,
  concat_ws(',', CASE WHEN fdv IS NULL THEN 'missing_fdv' END, CASE WHEN NOT coalesce(volume >= 150, false) THEN 'low_volume' END, CASE WHEN stable THEN 'stablecoin' END) AS reasons FROM {name}c)"""


@register("c05_monthly_snapshots", Q.query(CONTRACTS, PROVIDER, VOLUME, month_sql("m1", "fdv", None), month_sql("m2", "fdv * (1 + (length(symbol) * provider_id) % 7 / 10)", "m1"), select="\nUNION ALL ".join(
    f"SELECT TIMESTAMP '{t}' AS as_of, symbol, round(fdv, 4) AS fdv, rank, eligible, member, reasons FROM {m}" for m, t in (("m1", "2001-05-31 23:59:59.999999"), ("m2", "2001-06-30 23:59:59.999999")))))
def monthly_snapshots(spark, sf):
    assets, vol = resolved(spark, sf), volumes(spark, sf)
    args = dict(min_volume=150.0, stable=("C11", "C22"))
    first = U.monthly_snapshot(assets, vol, None, "2001-06-15 00:00:00", **args)
    moved = assets.withColumn("fdv", F.col("fdv") * (1 + (F.length("symbol") * F.col("provider_id")) % 7 / 10))
    second = U.monthly_snapshot(moved, vol, first.filter("member"), "2001-07-15 00:00:00", **args)
    return first.unionByName(second).select("as_of", "symbol", r6("fdv", 4).alias("fdv"), F.col("rank").cast("bigint").alias("rank"), "eligible", "member", F.concat_ws(",", "reasons").alias("reasons"))


def meta(spark, sf):
    c = P.table(spark, sf, "customer")
    cats = F.array_compact(F.array(F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")), F.when(F.col("c_custkey") % 4 == 0, F.lit("Meme Coins"))))
    return c.select(F.col("c_custkey").alias("provider_id"), cats.alias("categories"))


META = """meta AS (SELECT c_custkey AS provider_id, list_filter([CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END, CASE WHEN c_custkey % 4 = 0 THEN 'Meme Coins' END], lambda x: x IS NOT NULL) AS categories FROM customer)"""


@register("c06_enrich_universe", Q.query(CONTRACTS, PROVIDER, VOLUME, META, select="""
SELECT r.symbol, r.listing_time, coalesce(categories[1], 'Unclassified') AS sector, CASE WHEN len(coalesce(categories, [])) = 0 THEN '[]' ELSE '["' || array_to_string(categories, '","') || '"]' END AS categories,
  round(median_volume, 6) AS median_volume FROM resolved r LEFT JOIN meta USING (provider_id) LEFT JOIN med ON med.symbol = r.symbol"""))
def enrich_universe(spark, sf):
    r = resolved(spark, sf)
    df = U.enrich_universe(r.select("symbol"), r, meta(spark, sf), volumes(spark, sf))
    return df.select("symbol", "listing_time", "sector", "categories", r6("median_volume", 6).alias("median_volume"))


@register("c07_sector_symbols", Q.query(CONTRACTS, PROVIDER, META, select="""
SELECT DISTINCT r.symbol FROM resolved r JOIN meta USING (provider_id) WHERE len(list_filter(categories, lambda x: x ILIKE '%meme%' OR x ILIKE '%machin%')) > 0"""))
def sector_symbols(spark, sf):
    return U.sector_symbols(resolved(spark, sf), meta(spark, sf), ["MEME", "machin"])


@register("c08_tradability_mask", Q.query(Q.FUNDING, """fst AS (SELECT symbol, date_trunc('day', min(funding_time))::TIMESTAMP + INTERVAL 1 DAY AS d FROM funding WHERE mark_price IS NOT NULL GROUP BY symbol)""", select="""
SELECT c.ts, s.symbol, c.ts >= s.d AS tradable FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', (SELECT max(date_trunc('day', ts)) FROM events)::TIMESTAMP, INTERVAL 1 DAY)) AS ts) c CROSS JOIN fst s"""))
def tradability_mask(spark, sf):
    ev = A.funding(spark, sf)
    days = P.calendar(A.day_close(spark, sf))
    return U.tradability_mask(days, ev, ev).select("ts", "symbol", "tradable")


@register("c09_apply_membership", Q.query(*A.DPANEL, select="""
SELECT ts, symbol, round(CASE WHEN pos % 3 <> 0 AND NOT (symbol = '5-LOW') THEN f END, 6) AS f FROM sig"""))
def apply_membership(spark, sf):
    df = A.daily_signals(spark, sf)
    members = df.filter("symbol <> '5-LOW'").select("pos", "symbol", (F.col("pos") % 3 != 0).alias("member"))
    return shown(C.apply_membership(df, members, "f"), "ts", "symbol", f="f")


# --- folds and windows ----------------------------------------------------------------------

@register("i01_train_oos_split", Q.query(*QM.BASE, """x AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY pos) - 1 AS rn, count(*) OVER (PARTITION BY strategy) AS n FROM perf)""", select="""
SELECT ts, strategy, CASE WHEN rn >= n - least(greatest(1, floor(n * 0.3::DOUBLE)), n - 1) THEN 'oos' ELSE 'train' END AS part FROM x"""))
def train_oos_split(spark, sf):
    return I.train_oos_split(QM.perf(spark, sf), fraction=0.3, keys=["strategy"]).select("ts", "strategy", "part")


def folds(spark, sf, days=None):
    return I.fold_table(A.calendar(spark, sf), 1997, 2001, days)


def folds_sql(days: int | None = None, name: str = "folds") -> str:
    start = "a + INTERVAL 365 DAY" if days is None else f"greatest(a + INTERVAL 365 DAY, make_timestamp(y, 1, 1, 0, 0, 0) - INTERVAL {days} DAY)"
    return f"""{name} AS (SELECT CASE WHEN least(make_timestamp(y, 12, 31, 0, 0, 0), b) < make_timestamp(y, 12, 31, 0, 0, 0) THEN y || '_ytd' ELSE y::VARCHAR END AS fold,
  make_timestamp(y, 1, 1, 0, 0, 0) - INTERVAL 1 DAY AS cutoff, make_timestamp(y, 1, 1, 0, 0, 0) AS test_start, least(make_timestamp(y, 12, 31, 0, 0, 0), b) AS test_end, {start} AS select_start
  FROM (SELECT unnest(range(1997, 2002)) AS y), (SELECT min(ts) AS a, max(ts) AS b FROM cal) WHERE make_timestamp(y, 1, 1, 0, 0, 0) <= b)"""


@register("i02_fold_table", Q.query(*A.DPANEL[:2], A.CAL, folds_sql(), folds_sql(730, "rolling"), select="""
SELECT 'expanding' AS variant, * FROM folds UNION ALL SELECT 'rolling', * FROM rolling"""))
def fold_table(spark, sf):
    return folds(spark, sf).withColumn("variant", F.lit("expanding")).unionByName(folds(spark, sf, 730).withColumn("variant", F.lit("rolling")))


WF = """x AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY pos) - 1 AS rn, count(*) OVER (PARTITION BY strategy) AS n FROM perf),
wf AS (SELECT x.ts, x.strategy, k AS "window", greatest(0, 60 + k * 12 - 60) AS train_from, 60 + k * 12 - 1 AS train_to, round(net, 6) AS net
  FROM x JOIN (SELECT unnest(range(0, (SELECT max(n) // 12 + 1 FROM x))) AS k) w ON rn >= 60 + k * 12 AND rn < 60 + k * 12 + 20 AND 60 + k * 12 + 20 <= n)"""


@register("i03_wf_windows", Q.query(*QM.BASE, WF, select="SELECT * FROM wf"))
def wf_windows(spark, sf):
    df = I.wf_windows(QM.perf(spark, sf), 60, 20, 12, keys=["strategy"])
    return df.select("ts", "strategy", "window", "train_from", "train_to", r6("net").alias("net"))


@register("i03_stitch_windows", Q.query(*QM.BASE, WF, select="""
SELECT ts, strategy, max("window") AS "window" FROM wf GROUP BY ts, strategy"""))
def stitch_windows(spark, sf):
    df = I.wf_windows(QM.perf(spark, sf), 60, 20, 12, keys=["strategy"])
    return I.stitch_windows(df.select("ts", "strategy", "window", "net"), ("strategy", "ts")).select("ts", "strategy", "window")


# --- grid -----------------------------------------------------------------------------------

# The parameter grid.
TARGETS = (0.15, 0.2, 0.25, 0.3, 0.35, 0.4)
GROSS_CAPS = (1.0, 1.5, 2.0, 2.5, 3.0)
TICKER_CAPS = (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4)
FREQS = ("daily", "weekly", "monthly")

GRID = tuple((t, g) for t in TARGETS for g in GROSS_CAPS)
MODEL = ("model", "ticker_cap")


def _unnest(values) -> str:
    return f"unnest([{', '.join(f'{v}::DOUBLE' for v in values)}])"


UNITS = (
    f"""w0 AS (SELECT 'neutral' AS model, symbol, pos, w AS raw FROM nt UNION ALL SELECT 'signed', symbol, pos, w FROM sn),
capsrc AS (SELECT model, ticker_cap, symbol, pos, raw FROM w0, (SELECT {_unnest(TICKER_CAPS)} AS ticker_cap))""",
    QX.CAPPED.format(src="capsrc", cap="ticker_cap").replace("PARTITION BY pos", "PARTITION BY model, ticker_cap, pos"),
    f"""units AS (SELECT model, ticker_cap, symbol, pos, sign(raw) * budget * CASE WHEN model = 'neutral' THEN 3 ELSE 1 END AS unit FROM budgets WHERE budget > 0),
mods AS (SELECT DISTINCT model, ticker_cap FROM units),
gross AS (SELECT model, ticker_cap, pos, sum(abs(unit)) AS gross FROM units GROUP BY ALL),
points AS (SELECT * FROM (SELECT {_unnest(TARGETS)} AS target_vol), (SELECT {_unnest(GROSS_CAPS)} AS gross_cap)),
srcs AS (SELECT *, lag(source) OVER (PARTITION BY rebalance ORDER BY pos) AS before
  FROM ({' UNION ALL '.join(f"SELECT '{f}' AS rebalance, ts, pos, source FROM src_{f}" for f in FREQS)}) WHERE source IS NOT NULL),
g0 AS (SELECT m.model, m.ticker_cap, s.rebalance, s.pos, s.source, s.before, y.symbol, coalesce(x.unit, 0) AS u, coalesce(z.unit, 0) AS v
  FROM srcs s CROSS JOIN mods m CROSS JOIN (SELECT DISTINCT symbol FROM panel) y
  LEFT JOIN units x ON x.model = m.model AND x.ticker_cap = m.ticker_cap AND x.symbol = y.symbol AND x.pos = s.source
  LEFT JOIN units z ON z.model = m.model AND z.ticker_cap = m.ticker_cap AND z.symbol = y.symbol AND z.pos = s.before),
lin AS (SELECT model, ticker_cap, rebalance, g0.pos, sum(u * (coalesce(n.open / b.open - 1, 0) + coalesce(e.same, 0))) AS a, sum(v * coalesce(e.midnight, 0)) AS b
  FROM g0 LEFT JOIN bars b ON b.symbol = g0.symbol AND b.pos = g0.pos LEFT JOIN bars n ON n.symbol = g0.symbol AND n.pos = g0.pos + 1
  LEFT JOIN evfund e ON e.symbol = g0.symbol AND e.pos = g0.pos GROUP BY ALL),
mult AS (SELECT model, ticker_cap, pos, target_vol, gross_cap, least(target_vol, gross_cap / gross) AS m FROM gross, points),
trd AS (SELECT g0.model, g0.ticker_cap, g0.rebalance, g0.pos, p.target_vol, p.gross_cap,
    sum(abs(coalesce(least(p.target_vol, p.gross_cap / ga.gross), p.target_vol) * u - coalesce(least(p.target_vol, p.gross_cap / gb.gross), p.target_vol) * v)) AS turnover
  FROM g0 LEFT JOIN gross ga ON ga.model = g0.model AND ga.ticker_cap = g0.ticker_cap AND ga.pos = g0.source
  LEFT JOIN gross gb ON gb.model = g0.model AND gb.ticker_cap = g0.ticker_cap AND gb.pos = g0.before CROSS JOIN points p
  WHERE source IS DISTINCT FROM before AND (u <> 0 OR v <> 0) GROUP BY ALL),
gd AS (SELECT m.model, m.ticker_cap, s.rebalance, p.target_vol, p.gross_cap, s.ts, s.pos, coalesce(ma.m, p.target_vol) * coalesce(lin.a, 0)
    + coalesce(mb.m, p.target_vol) * coalesce(lin.b, 0) - coalesce(t.turnover, 0) * 0.0009::DOUBLE AS net, coalesce(t.turnover, 0) AS turnover
  FROM srcs s CROSS JOIN mods m CROSS JOIN points p
  LEFT JOIN mult ma ON ma.model = m.model AND ma.ticker_cap = m.ticker_cap AND ma.pos = s.source AND ma.target_vol = p.target_vol AND ma.gross_cap = p.gross_cap
  LEFT JOIN mult mb ON mb.model = m.model AND mb.ticker_cap = m.ticker_cap AND mb.pos = s.before AND mb.target_vol = p.target_vol AND mb.gross_cap = p.gross_cap
  LEFT JOIN lin ON lin.model = m.model AND lin.ticker_cap = m.ticker_cap AND lin.rebalance = s.rebalance AND lin.pos = s.pos
  LEFT JOIN trd t ON t.model = m.model AND t.ticker_cap = m.ticker_cap AND t.rebalance = s.rebalance AND t.pos = s.pos AND t.target_vol = p.target_vol AND t.gross_cap = p.gross_cap)""")
SIGNED = "sn AS (SELECT ts, symbol, pos, round(coalesce(f / nullif(sum(abs(f)) OVER (PARTITION BY pos), 0), 0), 12) AS w FROM ranks)"
GBASE = (*A.DPANEL, A.CAL, *[A.held_sql(f, name=f"h_{f}") for f in FREQS], Q.FUNDING, A.DAYCLOSE, A.COEF, A.EVFUND, SIGNED, *UNITS)


def units(spark, sf):
    """Unit portfolios of two models under every ticker cap."""
    signed = C.signed_norm(A.daily_signals(spark, sf)).select(
        F.lit("signed").alias("model"), "symbol", "pos", r6("w", 12).alias("raw"))
    neutral = A.neutral(spark, sf).select(F.lit("neutral").alias("model"), "symbol", "pos", F.col("w").alias("raw"))
    both = signed.unionByName(neutral).withColumn("ticker_cap", F.explode(F.array(*[F.lit(c) for c in TICKER_CAPS])))
    shares = C.cap_budget(both, "ticker_cap", by=(*MODEL, "pos"), smallest=min(TICKER_CAPS))
    unit = F.signum("raw") * F.col("budget") * F.when(F.col("model") == "neutral", 3).otherwise(1)
    return cut_lineage(shares.select(*MODEL, "symbol", "pos", unit.alias("unit")).filter("unit <> 0"))


def grid_daily(spark, sf, unit=None):
    return I.grid_daily(units(spark, sf) if unit is None else unit, A.calendar(spark, sf), A.open_returns(spark, sf), GRID, FREQS,
                        funding=A.order_funding(spark, sf), keys=MODEL)


CONFIG = (*MODEL, "rebalance", "target_vol", "gross_cap")


# the daily rows of the whole grid, summed per month
@register("i04_grid_daily", Q.query(*GBASE, select=f"""
SELECT {', '.join(CONFIG)}, year(ts) * 100 + month(ts) AS month, count(*) AS bars, round(sum(net), 6) AS net, round(sum(turnover), 6) AS turnover FROM gd GROUP BY ALL"""))
def grid_returns(spark, sf):
    month = (F.year("ts") * 100 + F.month("ts")).cast("bigint").alias("month")
    sums = grid_daily(spark, sf).groupBy(*CONFIG, month).agg(
        F.count(F.lit(1)).alias("bars"), F.sum("net").alias("net"), F.sum("turnover").alias("turnover"))
    return shown(sums, *CONFIG, "month", "bars", net="net", turnover="turnover")


SCORES = f"""scores AS (SELECT {', '.join(CONFIG)}, fold, count(net) AS observations,
    CASE WHEN count(net) >= 180 THEN avg(net) * 365 / nullif(stddev_samp(net) * sqrt(365), 0) END AS sharpe, CASE WHEN count(net) >= 180 THEN avg(turnover) * 365 END AS annual_turnover
  FROM gd JOIN folds ON gd.ts >= select_start AND gd.ts <= cutoff GROUP BY ALL)"""
CID = """substr(sha256('{"gross_cap":' || gross_cap || ',"model":"' || model || '","rebalance":"' || rebalance || '","target_vol":' || target_vol || ',"ticker_cap":' || ticker_cap || '}'), 1, 20)"""


def scored(spark, sf, unit=None):
    return I.score_grid(grid_daily(spark, sf, unit), folds(spark, sf), CONFIG)


@register("i04_score_grid", Q.query(*GBASE, folds_sql(), SCORES, select=f"""
SELECT {', '.join(CONFIG)}, fold, {CID} AS config_id, observations, round(sharpe, 6) AS sharpe, round(annual_turnover, 6) AS annual_turnover FROM scores"""))
def score_grid(spark, sf):
    return shown(scored(spark, sf), *CONFIG, "fold", "config_id", "observations", sharpe="sharpe", annual_turnover="annual_turnover")


@register("i05_cost_grid", Q.query(*A.CBASE, """cd AS (SELECT ts, pos, sum(gross + funding) AS g, sum(trade) AS turnover FROM net WHERE abs(held) > 1e-13 OR abs(prev) > 1e-13 GROUP BY ALL),
pts AS (SELECT t AS taker_share, s AS slippage_bps FROM (SELECT unnest([0::DOUBLE, 0.5::DOUBLE, 1::DOUBLE]) AS t), (SELECT unnest([0::DOUBLE, 2::DOUBLE, 5::DOUBLE, 10::DOUBLE]) AS s))""", select="""
SELECT taker_share, slippage_bps, ts, round(g - turnover * (taker_share * 0.0004::DOUBLE + (1 - taker_share) * 0.0002::DOUBLE + slippage_bps / 10000), 6) AS net FROM cd, pts"""))
def cost_grid(spark, sf):
    contrib = A.contribution(spark, sf).filter("held <> 0 OR prev <> 0").withColumn("model", F.lit("w"))
    df = I.cost_grid(contrib, (0.0, 0.5, 1.0), (0.0, 2.0, 5.0, 10.0))
    return shown(df, "taker_share", "slippage_bps", "ts", net="net")


@register("i05_delayed_funding", Q.query(*A.CBASE, """late AS (SELECT h.ts, h.pos, coalesce(lag(held) OVER w, 0) * e.same + coalesce(lag(held, 2) OVER w, 0) * e.midnight AS f, coalesce(lag(held) OVER w, 0) AS a, coalesce(lag(held, 2) OVER w, 0) AS b, e.same
  FROM held h LEFT JOIN evfund e USING (symbol, pos) WINDOW w AS (PARTITION BY h.symbol ORDER BY h.pos))""", select="""
SELECT ts, round(sum(f), 8) AS funding FROM late WHERE same IS NOT NULL AND (a <> 0 OR b <> 0) GROUP BY ts"""))
def delayed_funding(spark, sf):
    held = A.held(spark, sf).withColumn("model", F.lit("w"))
    return shown(I.delay_funding(held, A.calendar(spark, sf), A.order_funding(spark, sf)), "ts", digits=8, funding="funding")


# --- selection ------------------------------------------------------------------------------

def score_rows(spark, sf):
    """Score records derived from the customers: 5 families x 25 models, some without a score."""
    flat = QS.flat_configs(spark, sf)
    n = F.col("config_id").cast("bigint")
    return flat.select(
        "config_id", "family", F.concat(F.lit("m"), F.col("horizons")).alias("model"), F.when(n % 2 == 0, "a").otherwise("b").alias("variant"),
        F.concat(F.lit("f"), (n % 3).cast("string")).alias("fold"), (1 + n % 4 * 0.5).alias("gross_cap"), "target_vol",
        F.when(n % 10 != 0, F.col("validation_net_sharpe")).alias("selection_net_sharpe"), F.col("validation_annual_turnover").alias("selection_annual_turnover"),
        "validation_net_sharpe", "validation_annual_turnover", "holdout_net_sharpe", n.alias("seq"))


ROWS = """srows AS (SELECT config_id, family, 'm' || horizons AS model, CASE WHEN config_id::BIGINT % 2 = 0 THEN 'a' ELSE 'b' END AS variant, 'f' || (config_id::BIGINT % 3) AS fold,
  (1 + config_id::BIGINT % 4 * 0.5)::DOUBLE AS gross_cap, target_vol, CASE WHEN config_id::BIGINT % 10 <> 0 THEN validation_net_sharpe END AS selection_net_sharpe, validation_annual_turnover AS selection_annual_turnover,
  validation_net_sharpe, validation_annual_turnover, holdout_net_sharpe, config_id::BIGINT AS seq FROM cfg),
best AS (SELECT * FROM srows WHERE selection_net_sharpe IS NOT NULL QUALIFY row_number() OVER (PARTITION BY variant, fold, family, model ORDER BY selection_net_sharpe DESC, selection_annual_turnover, gross_cap, target_vol, config_id) = 1),
rosters AS (SELECT *, row_number() OVER (PARTITION BY variant, fold, family ORDER BY selection_net_sharpe DESC, selection_annual_turnover, gross_cap, target_vol, config_id) AS rank FROM best)"""


def rosters(spark, sf):
    return I.select_rosters(score_rows(spark, sf))


@register("i06_select_rosters", Q.query(QS.CONFIGS, ROWS, select="""
SELECT variant, fold, family, model, config_id, rank, rank <= 3 AS selected, CASE WHEN rank <= 3 THEN 'top_3_distinct_models' ELSE 'below_top_3' END AS selection_reason FROM rosters"""))
def select_rosters(spark, sf):
    return rosters(spark, sf).select("variant", "fold", "family", "model", "config_id", F.col("rank").cast("bigint").alias("rank"), "selected", "selection_reason")


@register("i07_select_best", Q.query(QS.CONFIGS, ROWS, select="""
SELECT family, config_id, validation_net_sharpe FROM srows WHERE seq % 3 <> 0 AND seq % 5 <> 0 AND seq % 7 <> 0
QUALIFY row_number() OVER (PARTITION BY family ORDER BY validation_net_sharpe DESC, validation_annual_turnover, gross_cap, target_vol, config_id) = 1"""))
def select_best(spark, sf):
    n = F.col("seq")
    rows = score_rows(spark, sf).withColumn("taker_share", F.when(n % 3 == 0, 0.5)).withColumn("slippage_bps", F.when(n % 5 == 0, 2.0).otherwise(5.0)) \
        .withColumn("activation", F.lit("next_open")).withColumn("optimization_scope", F.when(n % 7 == 0, "legacy_static_full"))
    return I.select_best(rows).select("family", "config_id", "validation_net_sharpe")


STITCH = """pick AS (SELECT *, model AS family, row_number() OVER (PARTITION BY fold, model
    ORDER BY round(sharpe, 7) DESC NULLS LAST, round(annual_turnover, 6) NULLS FIRST, gross_cap, target_vol, ticker_cap, rebalance) AS rank FROM scores),
stitched AS (SELECT p.fold, p.family, p.rank, p.target_vol, s.ts, u.symbol, u.unit * least(p.target_vol, p.gross_cap / g.gross) AS held
  FROM pick p JOIN folds f ON f.fold = p.fold JOIN srcs s ON s.rebalance = p.rebalance AND s.ts BETWEEN test_start AND test_end
  JOIN units u ON u.model = p.model AND u.ticker_cap = p.ticker_cap AND u.pos = s.source
  JOIN gross g ON g.model = u.model AND g.ticker_cap = u.ticker_cap AND g.pos = u.pos WHERE rank <= 2)"""


def stitch_parts(spark, sf):
    """Held positions of the selected configurations, the rosters out of the whole grid, and the folds."""
    from pyspark.sql import Window
    unit = units(spark, sf)
    order = Window.partitionBy("fold", "model").orderBy(
        r6("sharpe", 7).desc_nulls_last(), r6("annual_turnover"), "gross_cap", "target_vol", "ticker_cap", "rebalance")
    rank = F.row_number().over(order)
    pick = cut_lineage(scored(spark, sf, unit).select(
        "config_id", *CONFIG, F.col("model").alias("family"), "fold", rank.alias("rank"), (rank <= 2).alias("selected")))
    held = I.held_of_configs(unit, A.calendar(spark, sf), pick.filter("selected"), FREQS, MODEL)
    return held, pick, folds(spark, sf)


@register("i08_stitch_oos", Q.query(*GBASE, folds_sql(), SCORES, STITCH, select="SELECT fold, family, rank, ts, symbol, round(held, 6) AS held FROM stitched"))
def stitch_oos(spark, sf):
    df = I.stitch_oos(*stitch_parts(spark, sf)).withColumn("rank", F.col("rank").cast("bigint"))
    return shown(df, "fold", "family", "rank", "ts", "symbol", held="held")


ENSEMBLES = """cnt AS (SELECT fold, family, count(*) AS n FROM pick WHERE rank <= 2 GROUP BY ALL),
en0 AS (SELECT s.fold, s.family, s.ts, s.symbol, sum(held / target_vol) / any_value(n) * 0.2::DOUBLE AS u FROM stitched s JOIN cnt c ON c.fold = s.fold AND c.family = s.family GROUP BY s.fold, s.family, s.ts, s.symbol),
en AS (SELECT fold, family, ts, symbol, greatest(least(u * least(1, coalesce(3::DOUBLE / nullif(sum(abs(u)) OVER (PARTITION BY fold, family, ts), 0), 0)), 0.4::DOUBLE), -0.4::DOUBLE) AS w FROM en0)"""


@register("i08_stitch_ensembles", Q.query(*GBASE, folds_sql(), SCORES, STITCH, ENSEMBLES, select="""
SELECT fold, family || '_slot_' || rank AS strategy, ts, symbol, round(held, 6) AS held FROM stitched
UNION ALL SELECT fold, family || '_ensemble', ts, symbol, round(w, 6) FROM en
UNION ALL SELECT fold, 'combined', ts, symbol, round(sum(w) / (SELECT count(*) FROM cnt c WHERE c.fold = en.fold), 6) FROM en GROUP BY fold, ts, symbol"""))
def stitch_ensembles(spark, sf):
    held, pick, spans = stitch_parts(spark, sf)
    df = I.stitch_ensembles(cut_lineage(I.stitch_oos(held, pick, spans)), pick)
    return shown(df, "fold", "strategy", "ts", "symbol", held="held")


REPORT = """wts AS (SELECT 'N' || lpad(c_nationkey::VARCHAR, 2, '0') AS symbol, o_orderpriority AS rule, date_trunc('year', o_orderdate)::TIMESTAMP AS refit_ts, count(*)::DOUBLE AS weight
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
refs AS (SELECT symbol, refit_ts, arg_max(rule, (weight, rule)) AS dominant, lead(refit_ts) OVER (PARTITION BY symbol ORDER BY refit_ts) AS nxt FROM wts GROUP BY symbol, refit_ts),
wr AS (SELECT p.*, refit_ts, dominant FROM perf p JOIN refs r ON r.symbol = p.strategy AND p.ts >= refit_ts AND (nxt IS NULL OR p.ts < nxt)),
we AS (SELECT *, product(1 + net) OVER (PARTITION BY strategy, refit_ts ORDER BY pos) AS equity FROM wr WHERE net IS NOT NULL),
wd AS (SELECT *, equity / max(equity) OVER (PARTITION BY strategy, refit_ts ORDER BY pos) - 1 AS dd FROM we),
ws AS (SELECT strategy, refit_ts, arg_max(equity, pos) - 1 AS total_return, min(dd) AS max_drawdown, avg(net) / nullif(stddev_samp(net), 0) * sqrt(365) AS sharpe FROM wd GROUP BY ALL)"""


@register("i09_window_report", Q.query(*QM.BASE, REPORT, select="""
SELECT wr.strategy AS symbol, wr.refit_ts, dominant, min(ts) AS test_start, max(ts) AS test_end, round(sum(turnover), 6) AS turnover, round(any_value(total_return), 6) AS total_return,
  round(any_value(sharpe), 6) AS sharpe, round(any_value(max_drawdown), 6) AS max_drawdown FROM wr LEFT JOIN ws USING (strategy, refit_ts) GROUP BY ALL"""))
def window_report(spark, sf):
    o = P.table(spark, sf, "orders").join(P.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    w = o.groupBy(F.format_string("N%02d", "c_nationkey").alias("symbol"), F.col("o_orderpriority").alias("rule"),
                  F.trunc(F.to_date("o_orderdate"), "year").cast("timestamp_ntz").alias("refit_ts")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    series = QM.perf(spark, sf).withColumnRenamed("strategy", "symbol")
    return shown(I.window_report(series, w), "symbol", "refit_ts", "dominant", "test_start", "test_end", turnover="turnover", total_return="total_return",
                 sharpe="sharpe", max_drawdown="max_drawdown")


def summary(spark, sf):
    perf = QM.perf(spark, sf)
    half = perf.withColumn("source", F.when(F.col("ts") < T.ntz("1998-06-01 00:00:00"), "oos").otherwise("wfo"))
    m = M.series_metrics(half, by=["strategy", "source"]).withColumnRenamed("strategy", "symbol")
    rows = QM.basket_rows(spark, sf)
    n = P.table(spark, sf, "nation").select(F.format_string("N%02d", "n_nationkey").alias("symbol"), F.when(F.col("n_nationkey") % 6 == 0, "skipped_insufficient_data").otherwise("success").alias("wfo_status"),
                                            F.col("n_nationkey").alias("wfo_windows"))
    return I.universe_summary(m, rows, n, P.weekly_panel(spark, sf), 10.0)


SUMMARY = """hs AS (SELECT *, CASE WHEN ts < TIMESTAMP '1998-06-01' THEN 'oos' ELSE 'wfo' END AS source FROM perf WHERE net IS NOT NULL),
he AS (SELECT *, product(1 + net) OVER (PARTITION BY strategy, source ORDER BY pos) AS equity FROM hs),
hd AS (SELECT *, equity / max(equity) OVER (PARTITION BY strategy, source ORDER BY pos) - 1 AS dd FROM he),
hm AS (SELECT strategy AS symbol, source, arg_max(equity, pos) - 1 AS tr, min(dd) AS mdd, avg(net) / stddev_samp(net) * sqrt(365) AS sr FROM hd GROUP BY ALL),
ex AS (SELECT symbol, sum(total_cost) / 10 AS cost_drag FROM rows_ GROUP BY symbol),
cg AS (SELECT symbol, max(gap) * 7.0::DOUBLE AS max_gap_days, ((SELECT max(pos) FROM panel) - max(pos)) * 7.0::DOUBLE AS days_stale FROM (SELECT symbol, pos, pos - lag(pos) OVER (PARTITION BY symbol ORDER BY pos) AS gap FROM panel) GROUP BY symbol),
summ AS (SELECT 'N' || lpad(n_nationkey::VARCHAR, 2, '0') AS symbol, CASE WHEN n_nationkey % 6 = 0 THEN 'skipped_insufficient_data' ELSE 'success' END AS wfo_status, n_nationkey AS wfo_windows FROM nation),
full_ AS (SELECT s.*, w.sr AS wfo_sharpe, w.tr AS wfo_return, w.mdd AS wfo_mdd, w.sr - o.sr AS sharpe_delta, w.tr / nullif(abs(w.mdd), 0) AS return_over_mdd, max_gap_days, days_stale,
  CASE WHEN wfo_status = 'success' THEN w.sr + 0.5 * w.tr - abs(w.mdd) - 0.1 * cost_drag END AS robust_score,
  coalesce(nullif(concat_ws(', ', CASE WHEN wfo_status <> 'success' THEN wfo_status END, CASE WHEN wfo_status = 'success' AND wfo_windows < 3 THEN 'low sample' END, CASE WHEN max_gap_days > 7 THEN 'data gap ' || max_gap_days::INT || 'd' END,
    CASE WHEN days_stale > 30 THEN 'stale ' || days_stale::INT || 'd' END, CASE WHEN w.mdd <= -0.75 THEN 'extreme DD' END), ''), 'ok') AS quality_flag
  FROM summ s LEFT JOIN hm w ON w.symbol = s.symbol AND w.source = 'wfo' LEFT JOIN hm o ON o.symbol = s.symbol AND o.source = 'oos' LEFT JOIN ex ON ex.symbol = s.symbol LEFT JOIN cg ON cg.symbol = s.symbol)"""
SUMMARY_SELECT = "symbol, wfo_status, round(wfo_sharpe, 6) AS wfo_sharpe, round(sharpe_delta, 6) AS sharpe_delta, round(return_over_mdd, 5) AS return_over_mdd, max_gap_days, days_stale, round(robust_score, 5) AS robust_score, quality_flag"


def summary_out(df):
    return df.select("symbol", "wfo_status", r6("wfo_sharpe").alias("wfo_sharpe"), r6("sharpe_delta").alias("sharpe_delta"), r6("return_over_mdd", 5).alias("return_over_mdd"),
                     "max_gap_days", "days_stale", r6("robust_score", 5).alias("robust_score"), "quality_flag")


@register("i10_universe_summary", Q.query(*QM.BASE, QM.ROWS, SUMMARY, select=f"SELECT {SUMMARY_SELECT} FROM full_"))
def universe_summary(spark, sf):
    return summary_out(summary(spark, sf))


@register("i11_filter_summary", Q.query(*QM.BASE, QM.ROWS, SUMMARY, select=f"SELECT {SUMMARY_SELECT} FROM full_ WHERE wfo_status = 'success' AND wfo_windows >= 4 AND symbol LIKE '%N1%'"))
def filter_summary(spark, sf):
    return summary_out(I.filter_summary(summary(spark, sf), "success", 4, "n1", "robust_score"))


CHURN = """chosen AS (SELECT DISTINCT family || variant AS family, fold, model FROM rosters WHERE rank <= 3)"""


@register("i12_roster_churn", Q.query(QS.CONFIGS, ROWS, CHURN, """pf AS (SELECT family, fold, lag(fold) OVER (PARTITION BY family ORDER BY fold) AS prior FROM (SELECT DISTINCT family, fold FROM chosen))""", select="""
SELECT c.family, c.fold, CASE WHEN max(prior) IS NOT NULL THEN count(p.model) END AS retained, count(*) - count(p.model) AS new, count(*) AS roster_size
FROM chosen c JOIN pf ON pf.family = c.family AND pf.fold = c.fold LEFT JOIN chosen p ON p.family = c.family AND p.fold = pf.prior AND p.model = c.model GROUP BY c.family, c.fold"""))
def roster_churn(spark, sf):
    return I.roster_churn(rosters(spark, sf).withColumns({"cutoff": F.col("fold"), "family": F.concat("family", "variant")}))


@register("i13_family_robustness", Q.query(QS.CONFIGS, ROWS, """rk AS (SELECT family, rank() OVER (PARTITION BY family ORDER BY validation_net_sharpe) + (count(*) OVER (PARTITION BY family, validation_net_sharpe) - 1) / 2::DOUBLE AS rv,
  rank() OVER (PARTITION BY family ORDER BY holdout_net_sharpe) + (count(*) OVER (PARTITION BY family, holdout_net_sharpe) - 1) / 2::DOUBLE AS rh FROM srows)""", select="""
SELECT family, count(*) AS models, round(quantile_cont(validation_net_sharpe, 0.5), 6) AS median_validation, round(quantile_cont(holdout_net_sharpe, 0.5), 6) AS median_holdout,
  round(avg((holdout_net_sharpe > 0)::INT::DOUBLE), 6) AS positive_holdout_share, round((SELECT corr(rv, rh) FROM rk WHERE rk.family = srows.family), 6) AS rank_correlation,
  round(arg_max(holdout_net_sharpe, (validation_net_sharpe, seq)), 6) AS selected_holdout FROM srows GROUP BY family"""))
def family_robustness(spark, sf):
    rows = score_rows(spark, sf)
    top = rows.groupBy("family").agg(F.max_by("config_id", F.struct("validation_net_sharpe", "seq")).alias("_c"))
    sel = rows.join(top, "family").withColumn("selected", F.col("config_id") == F.col("_c"))
    return shown(I.family_robustness(sel), "family", "models", **{c: c for c in ("median_validation", "median_holdout", "positive_holdout_share", "rank_correlation", "selected_holdout")})


@register("i14_dedupe_configs", Q.query(QS.CONFIGS, ROWS, select="""
SELECT (seq // 4)::VARCHAR AS config_id, arg_max(family, seq) AS family, max(seq) AS seq FROM srows GROUP BY seq // 4"""))
def dedupe_configs(spark, sf):
    rows = score_rows(spark, sf).withColumn("config_id", F.floor(F.col("seq") / 4).cast("string")).select("config_id", "family", "seq")
    return I.dedupe_configs(rows)


@register("i14_best_per_model", Q.query(QS.CONFIGS, ROWS, select="""
SELECT model, config_id, validation_net_sharpe FROM srows QUALIFY row_number() OVER (PARTITION BY model ORDER BY validation_net_sharpe DESC, config_id) = 1"""))
def best_per_model(spark, sf):
    return I.best_per_model(score_rows(spark, sf)).select("model", "config_id", "validation_net_sharpe")


CELL = (*MODEL, "fold", "target_vol", "gross_cap")


@register("i15_pivot_metric", Q.query(*GBASE, folds_sql(), SCORES, select=f"""
SELECT {', '.join(CELL)}, {', '.join(f"round(max(sharpe) FILTER (rebalance = '{f}'), 6) AS {f}" for f in FREQS)} FROM scores GROUP BY ALL"""))
def pivot_metric(spark, sf):
    return shown(I.pivot_metric(scored(spark, sf), CELL, "rebalance", "sharpe", FREQS), *CELL, **{f: f for f in FREQS})


@register("i16_melt_metrics", Q.query(QS.CONFIGS, select="""
SELECT config_id, 'Validation' AS split, validation_net_sharpe AS value FROM cfg UNION ALL SELECT config_id, 'Holdout', holdout_net_sharpe FROM cfg"""))
def melt_metrics(spark, sf):
    return I.melt_metrics(QS.flat_configs(spark, sf), ["config_id"], {"Validation": "validation_net_sharpe", "Holdout": "holdout_net_sharpe"})


@register("i17_best_run", Q.query(*QM.BASE, QM.EQ, """rs AS (SELECT strategy AS run_id, round(avg(net) * 365 / nullif(stddev_samp(net) * sqrt(365), 0), 6) AS net_sharpe FROM perf GROUP BY strategy)""", select="""
SELECT run_id, net_sharpe FROM rs ORDER BY net_sharpe DESC NULLS LAST, run_id LIMIT 1"""))
def best_run(spark, sf):
    m = M.perf_metrics(QM.perf(spark, sf), ["strategy"])
    runs = m.select(F.col("strategy").alias("run_id"), F.to_json(F.struct(r6("net_sharpe").alias("net_sharpe"), "max_drawdown")).alias("metrics_json"))
    return I.best_run(runs).select("run_id", "net_sharpe")


NAMES = """nm AS (SELECT c_custkey AS k, ['60', '90', '180', '360', '45'][c_custkey % 5 + 1] AS vol, ['quarterly', 'semiannual', 'annual', 'frozen'][c_custkey % 4 + 1] AS refit,
  ['shrink_75', 'shrink_80_primary', 'shrink_90'][c_custkey % 3 + 1] AS shrink, ['causal', 'fixed'][c_custkey % 2 + 1] AS mode, c_custkey % 7 AS form FROM customer),
ok AS (SELECT *, form < 5 AND vol <> '45' AS good FROM nm)"""


@register("i18_model_config", Q.query(NAMES, select="""
SELECT k, good AS supported, CASE WHEN good THEN CASE form WHEN 0 THEN 'equal' WHEN 1 THEN shrink END END AS rule_weights,
  CASE WHEN good THEN CASE form WHEN 2 THEN 'carver_fixed_scalars_equal' WHEN 3 THEN 'crypto_expanding_scalars_equal' WHEN 4 THEN 'crypto_expanding_scalars_shrunk_weights' END END AS method,
  CASE WHEN good AND form = 4 THEN shrink END AS weight_spec,
  CASE WHEN good AND form >= 2 THEN CASE WHEN form = 2 AND mode = 'fixed' THEN 'fixed_1.20' ELSE 'causal_expanding' END END AS fdm_mode,
  CASE WHEN good THEN CASE form WHEN 0 THEN 'quarterly_scalars' WHEN 2 THEN 'quarterly' ELSE refit END END AS refit,
  CASE WHEN good THEN vol::BIGINT END AS volatility_window FROM ok"""))
def model_config(spark, sf):
    k = F.col("c_custkey")

    def pick(*names):
        return F.element_at(F.array(*[F.lit(n) for n in names]), (k % len(names) + 1).cast("int"))

    vol = F.concat(F.lit("_vol"), pick("60", "90", "180", "360", "45"))
    refit, shrink = pick("quarterly", "semiannual", "annual", "frozen"), pick("shrink_75", "shrink_80_primary", "shrink_90")
    forms = (F.concat(F.lit("ts_equal"), vol), F.concat(F.lit("ts_"), shrink, F.lit("_"), refit, vol),
             F.concat(F.lit("breakout_carver5_equal_"), pick("causal", "fixed"), F.lit("_fdm"), vol),
             F.concat(F.lit("breakout_crypto_equal_"), refit, vol),
             F.concat(F.lit("breakout_crypto_"), shrink, F.lit("_"), refit, vol),
             F.concat(F.lit("momentum"), vol), F.concat(F.lit("ts_equal"), vol, F.lit("x")))
    names = P.table(spark, sf, "customer").select(k.alias("k"), F.element_at(F.array(*forms), (k % 7 + 1).cast("int")).alias("model"))
    df = I.model_config(names, strict=False)
    return df.select("k", "supported", *I.CONFIG_FIELDS, F.col("volatility_window").cast("bigint").alias("volatility_window"))
