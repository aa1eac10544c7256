"""Queries for sources, sinks and panel quality on the daily order panel and the event tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from sextant.functions import timeaxis as T
from sextant.operators import quality as B
from sextant.plans import panels as P
from sextant.plans import q_accounting as A
from sextant.plans import sqltext as Q
from sextant.plans.registry import r6, register, shown
from sextant.sources import ledger as L
from sextant.sources import readers as R

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
DUE = "2001-07-31 00:00:00"


def bars(spark, sf):
    return P.daily_panel(spark, sf)


def status_panel(spark, sf, finished: bool):
    """Mean order value per priority and day over finished or other orders."""
    o = P.table(spark, sf, "orders").filter((F.col("o_orderstatus") == "F") == finished)
    cells = o.groupBy(T.day(F.col("o_orderdate")).alias("ts"), F.col("o_orderpriority").alias("symbol")).agg(
        F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("c"), F.count(F.lit(1)).alias("n"))
    return cells.select("ts", "symbol", (F.col("c") / (F.col("n") * F.lit(100_000.0))).alias("close"))


STATUS = """fin AS (SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS ts, o_orderpriority AS symbol, sum(round(o_totalprice * 100)::BIGINT)::BIGINT / (count(*) * 100000.0::DOUBLE) AS close
  FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL),
oth AS (SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS ts, o_orderpriority AS symbol, sum(round(o_totalprice * 100)::BIGINT)::BIGINT / (count(*) * 100000.0::DOUBLE) AS close
  FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL)"""


@register("a01_wide_to_long", Q.query(Q.DAILY, select="SELECT ts, symbol, close FROM bars"))
def wide_to_long(spark, sf):
    wide = bars(spark, sf).groupBy("ts").pivot("symbol", list(PRIORITIES)).agg(F.first("close"))
    return R.wide_to_long(wide)


@register("a02_patch_panel", Q.query(STATUS, select="""
SELECT ts, symbol, coalesce(a.close, b.close) AS close FROM fin a FULL JOIN oth b USING (ts, symbol)"""))
def patch_panel(spark, sf):
    return R.patch_panel(status_panel(spark, sf, True), status_panel(spark, sf, False))


def payloads(spark, sf):
    """Kline payloads per symbol and day in two deliveries; the first one has stale closes and later bars."""
    ms = (T.epoch_second(F.col("ts")) * 1000).cast("string")
    x = P.hourly_bars(spark, sf)

    def delivery(df, seq, close):
        s = lambda c: F.col(c).cast("string")
        row = F.array(ms, s("open"), s("high"), s("low"), close.cast("string"), s("volume"),
                      (T.epoch_second(F.col("ts")) * 1000 + 3_599_999).cast("string"), s("quote"),
                      F.col("volume").cast("bigint").cast("string"), s("volume"), s("taker"), F.lit("0"))
        return df.groupBy("symbol", T.day(F.col("ts")).alias("day")).agg(
            F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ts", row.alias("r")))), lambda v: v["r"])).alias("payload")
        ).withColumn("seq", F.lit(seq))

    early = delivery(x, 0, F.col("open"))
    late = delivery(x.filter(F.hour("ts") < 20), 1, F.col("close"))
    return early.unionByName(late).drop("day")


@register("a03_flatten_klines", Q.query(Q.HOURLY, select="""
SELECT symbol, ts, open, high, low, CASE WHEN hour(ts) < 20 THEN close ELSE open END AS close, volume, quote AS quote_volume, taker AS taker_quote FROM bars"""))
def flatten_klines(spark, sf):
    return R.flatten_klines(payloads(spark, sf)).select(
        "symbol", "ts", "open", "high", "low", "close", "volume", "quote_volume", "taker_quote")


@register("a03_flatten_mark_klines", Q.query(Q.HOURLY, select="SELECT symbol, ts, open AS mark FROM bars"))
def flatten_mark_klines(spark, sf):
    return R.flatten_mark_klines(payloads(spark, sf)).select("symbol", "ts", "mark")


@register("a04_kline_quote_volume", Q.query(Q.HOURLY, select="""
SELECT date_trunc('day', ts)::TIMESTAMP AS ts, symbol, round(sum(quote), 4) AS quote_volume FROM bars GROUP BY date_trunc('day', ts), symbol"""))
def kline_quote_volume(spark, sf):
    return R.kline_quote_volume(payloads(spark, sf)).select("ts", "symbol", r6("quote_volume", 4).alias("quote_volume"))


INCOME = """SELECT (event_id // 2)::VARCHAR AS transaction_id, arg_min(event_type, event_id) AS symbol, 'USD' AS asset, min(ts) AS ts, arg_min(value - 50, event_id) AS income_usd
FROM events WHERE event_type <> 'error' GROUP BY event_id // 2"""


def scratch() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def shared_folder(spark) -> str:
    """A new folder below the one the cluster shares, or a local one where none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        return scratch()
    import uuid
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


@register("a05_income_csv", Q.query(select=INCOME))
def income_csv(spark, sf):
    ev = P.table(spark, sf, "events")
    out = ev.select(F.floor(F.col("event_id") / 2).cast("string").alias("tranId"), F.col("event_type").alias("symbol"),
                    F.lit("USD").alias("asset"), F.col("ts").cast("string").alias("time"), (F.col("value") - 50).cast("string").alias("income"),
                    F.when(F.col("event_type") == "error", "COMMISSION").otherwise("funding_fee").alias("incomeType"))
    path = shared_folder(spark) + "/income"
    out.write.option("header", True).csv(path)
    return R.read_income_csv(spark, path, out.columns)


def funding_payload(spark, sf):
    raw = P.funding_events(spark, sf)
    return raw.select("symbol", (T.epoch_second(F.col("funding_time")) * 1000).alias("fundingTime"), F.col("funding_rate").cast("string").alias("fundingRate"),
                      F.coalesce(F.col("mark_price").cast("string"), F.lit("")).alias("markPrice"), "seq")


@register("a06_normalize_funding", Q.query(Q.FUNDING, select="SELECT symbol, funding_time, funding_rate, mark_price FROM funding"))
def normalize_funding(spark, sf):
    return R.normalize_funding(funding_payload(spark, sf))


@register("a07_normalize_income", Q.query(select="""
SELECT (event_id // 3)::VARCHAR AS transaction_id, arg_max(event_type, event_id) AS symbol, 'USD' AS asset, arg_max(date_trunc('second', ts), event_id)::TIMESTAMP AS ts,
  arg_max(value - 50, event_id) AS income_usd FROM events GROUP BY event_id // 3"""))
def normalize_income(spark, sf):
    ev = P.table(spark, sf, "events")
    raw = ev.select(F.floor(F.col("event_id") / 3).alias("tranId"), F.col("event_type").alias("symbol"), F.lit("USD").alias("asset"),
                    (T.epoch_second(F.col("ts")) * 1000).alias("time"), (F.col("value") - 50).cast("string").alias("income"), F.col("event_id").alias("seq"))
    return R.normalize_income(raw)


@register("a08_append_ledger", Q.query(Q.FUNDING_RAW, select="""
SELECT symbol, funding_time, arg_min(funding_rate, seq) AS funding_rate, min(seq) AS seq, 'public' AS source FROM raw_funding GROUP BY symbol, funding_time"""))
def append_ledger(spark, sf):
    rows = P.funding_events(spark, sf).select("symbol", "funding_time", "funding_rate", "seq", F.lit("public").alias("source"))
    path = shared_folder(spark) + "/funding_events"
    keys = L.LEDGER_KEYS["funding_events"]
    cut = rows.agg((F.max("seq") / 2).alias("_h"))
    both = rows.crossJoin(cut)
    L.append_ledger(both.filter(F.col("seq") <= F.col("_h")).drop("_h"), path, keys, "seq")
    return L.append_ledger(both.drop("_h"), path, keys, "seq")


@register("a08_export_ledger", Q.query(Q.FUNDING_RAW, select="""
SELECT form, symbol, funding_time, arg_min(funding_rate, seq) AS funding_rate, min(seq) AS seq FROM raw_funding, (SELECT unnest(['csv', 'parquet']) AS form) GROUP BY form, symbol, funding_time"""))
def export_ledger(spark, sf):
    rows = P.funding_events(spark, sf).select("symbol", "funding_time", "funding_rate", "seq", F.lit("public").alias("source"))
    root = shared_folder(spark)
    ledger = L.append_ledger(rows, f"{root}/funding_events", L.LEDGER_KEYS["funding_events"], "seq")
    L.export_ledger(spark, root, f"{root}/export")
    text = spark.read.schema(ledger.schema).option("header", True).csv(f"{root}/export/funding_events.csv")
    columns = spark.read.parquet(f"{root}/export/funding_events.parquet")
    both = text.withColumn("form", F.lit("csv")).unionByName(columns.withColumn("form", F.lit("parquet")))
    return both.select("form", "symbol", "funding_time", "funding_rate", "seq")


@register("a09_content_run_id", Q.query(select="""
SELECT o_orderkey, substr(sha256('{"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '"}'), 1, 24) AS run_id FROM orders"""))
def content_run_id(spark, sf):
    manifest = F.struct("o_orderkey", "o_orderpriority")
    return P.table(spark, sf, "orders").select("o_orderkey", L.content_run_id(manifest).alias("run_id"))


@register("a09_melt_with_run_id", Q.query(Q.DAILY, select="SELECT ts, symbol AS model, quote AS value, 'run-1' AS run_id FROM bars"))
def melt_with_run_id(spark, sf):
    wide = bars(spark, sf).groupBy("ts").pivot("symbol", list(PRIORITIES)).agg(F.first("quote"))
    return L.melt_with_run_id(wide, "run-1")


def config_rows(spark, sf):
    """One configuration per customer with nested JSON, metrics of two splits from their orders."""
    o = P.table(spark, sf, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")

    def split(cond, name):
        n = F.count_if(cond)
        return F.struct((F.coalesce(F.sum(F.when(cond, cents)), F.lit(0)) / 1e7).alias("net_sharpe"), n.cast("double").alias("annual_turnover")).alias(name)

    m = o.groupBy("o_custkey").agg(split(F.year("o_orderdate") < 1999, "validation"), split(F.year("o_orderdate") >= 1999, "holdout"))
    c = P.table(spark, sf, "customer").join(m, F.col("c_custkey") == F.col("o_custkey"))
    config = F.to_json(F.struct(F.col("c_mktsegment").alias("family"), (F.col("c_nationkey") / 10).alias("target_vol"),
                                F.array(F.col("c_nationkey"), F.col("c_nationkey") + 1).alias("horizons")))
    return c.select(F.col("c_custkey").cast("string").alias("config_id"), config.alias("config"),
                    F.to_json(F.struct("validation", "holdout")).alias("metrics"))


CONFIGS = """cfg AS (SELECT c_custkey::VARCHAR AS config_id, c_mktsegment AS family, c_nationkey / 10 AS target_vol, '[' || c_nationkey || ',' || (c_nationkey + 1) || ']' AS horizons,
    coalesce(sum(round(o_totalprice * 100)::BIGINT) FILTER (year(o_orderdate) < 1999), 0)::BIGINT / 1e7::DOUBLE AS validation_net_sharpe, (count(*) FILTER (year(o_orderdate) < 1999))::DOUBLE AS validation_annual_turnover,
    coalesce(sum(round(o_totalprice * 100)::BIGINT) FILTER (year(o_orderdate) >= 1999), 0)::BIGINT / 1e7::DOUBLE AS holdout_net_sharpe, (count(*) FILTER (year(o_orderdate) >= 1999))::DOUBLE AS holdout_annual_turnover
  FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment, c_nationkey)"""


def flat_configs(spark, sf):
    return L.flatten_config_metrics(config_rows(spark, sf), "family string, target_vol double, horizons array<int>",
                                    "net_sharpe double, annual_turnover double", ("validation", "holdout"))


@register("a10_flatten_config_metrics", Q.query(CONFIGS, select="SELECT * FROM cfg"))
def flatten_config_metrics(spark, sf):
    return flat_configs(spark, sf)


@register("a11_candidate_ledger", Q.query(CONFIGS, select="""
SELECT config_id, family, 'nested_expanding' AS variant, validation_net_sharpe FROM cfg UNION ALL SELECT config_id, family, 'rolling_730', holdout_net_sharpe FROM cfg"""))
def candidate_ledger(spark, sf):
    flat = flat_configs(spark, sf)
    path = shared_folder(spark) + "/candidates"
    L.write_candidates(flat.select("config_id", "family", F.lit("nested_expanding").alias("variant"), "validation_net_sharpe"), path)
    L.write_candidates(flat.select("config_id", "family", F.lit("rolling_730").alias("variant"), F.col("holdout_net_sharpe").alias("validation_net_sharpe")), path)
    return spark.read.parquet(path).select("config_id", "family", "variant", "validation_net_sharpe")


CATALOG = """cat AS (SELECT DISTINCT family, target_vol FROM cfg),
ids AS (SELECT *, substr(sha256('{"family":"' || family || '","target_vol":' || target_vol::VARCHAR || '}'), 1, 20) AS config_id FROM cat)"""


@register("a12_config_catalog", Q.query(CONFIGS, CATALOG, select="SELECT config_id, family, target_vol, true AS matches FROM ids"))
def config_catalog(spark, sf):
    fields = ("family", "target_vol")
    rows = flat_configs(spark, sf).select(*fields).withColumn("config_id", B.config_id(fields))
    return L.config_catalog(rows, fields).select("config_id", "family", "target_vol", "matches")


@register("a12_catalog_check", Q.query(CONFIGS, CATALOG, select="SELECT count(DISTINCT config_id) AS configurations FROM ids"))
def catalog_check(spark, sf):
    fields = ("family", "target_vol")
    return L.catalog_check(L.config_catalog(flat_configs(spark, sf).select(*fields).withColumn("config_id", B.config_id(fields)), fields))


@register("a12_write_catalog", Q.query(CONFIGS, CATALOG, select="""
SELECT DISTINCT part, config_id, '{"family":"' || family || '","target_vol":' || target_vol || '}' AS config
FROM ids, (SELECT unnest(['all_tested', 'selected']) AS part) WHERE part = 'all_tested' OR target_vol > 1"""))
def write_catalog(spark, sf):
    fields = ("family", "target_vol")
    catalog = L.config_catalog(flat_configs(spark, sf).select(*fields).withColumn("config_id", B.config_id(fields)), fields)
    path = shared_folder(spark)
    L.write_catalog(catalog, catalog.select("config_id", (F.col("target_vol") > 1).alias("selected")), path)
    parts = [spark.read.schema("config_id string, config string, selected boolean").json(f"{path}/{part}").select(
        F.lit(part).alias("part"), "config_id", "config") for part in ("all_tested", "selected")]
    return parts[0].unionByName(parts[1])


@register("a13_headline_grid", Q.query(CONFIGS, select="""
SELECT config_id, validation_net_sharpe FROM cfg WHERE validation_annual_turnover > 3 ORDER BY validation_net_sharpe DESC, config_id LIMIT 250"""))
def headline_grid(spark, sf):
    flat = flat_configs(spark, sf).withColumn("taker_share", F.when(F.col("validation_annual_turnover") > 3, F.lit(None)).otherwise(F.lit(0.5)).cast("double")) \
        .withColumn("slippage_bps", F.lit(5.0))
    return L.headline_grid(flat).select("config_id", "validation_net_sharpe")


@register("a13_newest_reconciliations", Q.query(Q.FUNDING, A.QUANT, A.ARCHIVE, select="SELECT transaction_id, symbol, ts, status FROM status ORDER BY ts DESC, transaction_id LIMIT 100"))
def newest_reconciliations(spark, sf):
    return L.newest(A.archive(spark, sf), 100, ["transaction_id"]).select("transaction_id", "symbol", "ts", "status")


@register("b01_utc_normalisation", Q.query(select="""
SELECT event_id, ts - INTERVAL 9 HOUR AS utc FROM events"""))
def utc_normalisation(spark, sf):
    return P.table(spark, sf, "events").select("event_id", R.utc_ntz(F.col("ts"), "Asia/Tokyo").alias("utc"))


@register("b02_freshness", Q.query(Q.HOURLY, select="""
SELECT symbol, max(ts) AS latest, TIMESTAMP '2024-01-30 16:00:00' AS required, max(ts) >= TIMESTAMP '2024-01-30 16:00:00' AS is_fresh FROM bars GROUP BY symbol"""))
def freshness(spark, sf):
    return B.freshness(P.hourly_bars(spark, sf), "4h", "2024-01-30 23:30:00")


@register("b03_infer_frequency", Q.query(Q.HOURLY, Q.DAILY.replace("bars AS", "dbars AS"), select="\nUNION ALL ".join(f"""
SELECT '{n}' AS panel, gap, CASE gap WHEN 86400 THEN '1d' WHEN 14400 THEN '4h' WHEN 3600 THEN '1h' ELSE 'irregular:' || gap || 's' END AS frequency,
  CASE gap WHEN 3600 THEN true ELSE false END AS is_match FROM (SELECT gap FROM (SELECT (epoch(ts) - epoch(lag(ts) OVER (ORDER BY ts)))::BIGINT AS gap FROM (SELECT DISTINCT ts FROM {t}))
  WHERE gap IS NOT NULL GROUP BY gap ORDER BY count(*) DESC, gap LIMIT 1)""" for n, t in (("hourly", "bars"), ("daily", "dbars"), ("raw", "events_s"))).replace("events_s", "(SELECT date_trunc('second', ts) AS ts FROM events)")))
def infer_frequency(spark, sf):
    sources = {"hourly": P.hourly_bars(spark, sf), "daily": bars(spark, sf), "raw": P.table(spark, sf, "events")}
    out = None
    for name, df in sources.items():
        part = B.resolve_frequency(B.infer_frequency(df), "1h").select(F.lit(name).alias("panel"), "gap", "frequency", "is_match")
        out = part if out is None else out.unionByName(part)
    return out


def doubled(spark, sf):
    """The daily bars with the bars of one priority on Mondays delivered twice."""
    x = bars(spark, sf).select("ts", "symbol", "close", "pos")
    return x.unionByName(x.filter((F.col("symbol") == "5-LOW") & (F.weekday("ts") == 0)))


@register("b04_profile_panel", Q.query(Q.DAILY, select="""
SELECT count(DISTINCT ts) AS rows, count(DISTINCT symbol) AS columns, min(ts) AS start, max(ts) AS "end", count(*) FILTER (symbol = '5-LOW' AND isodow(ts) = 1) AS duplicates,
  round((1 - count(*) / (count(DISTINCT ts) * count(DISTINCT symbol))) * 100, 6) AS missing_pct, 1::BIGINT AS n_warnings FROM bars"""))
def profile_panel(spark, sf):
    df = B.profile_panel(doubled(spark, sf))
    return df.select("rows", "columns", "start", "end", "duplicates", r6("missing_pct").alias("missing_pct"), F.size("warnings").cast("bigint").alias("n_warnings"))


def onboard(spark, sf):
    """Onboard date per priority: the first urgent order of 1996 plus its rank in weeks, and one unknown symbol."""
    day = P.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("symbol")).agg(F.min("o_orderdate").alias("d"))
    o = day.select("symbol", T.ntz(F.date_add(F.to_date("d"), 30 * F.substring("symbol", 1, 1).cast("int"))).alias("onboard_ts"))
    return o.unionByName(o.filter("symbol = '5-LOW'").withColumn("symbol", F.lit("9-NEW")))


ONBOARD = """ob0 AS (SELECT o_orderpriority AS symbol, date_trunc('day', min(o_orderdate))::TIMESTAMP + to_days(30 * left(o_orderpriority, 1)::INT) AS onboard_ts FROM orders GROUP BY o_orderpriority),
onboard AS (SELECT * FROM ob0 UNION ALL SELECT '9-NEW', onboard_ts FROM ob0 WHERE symbol = '5-LOW'),
starts AS (SELECT o.symbol, coalesce(min(b.ts), any_value(o.onboard_ts)) AS start FROM onboard o LEFT JOIN bars b ON b.symbol = o.symbol AND b.ts >= o.onboard_ts GROUP BY o.symbol)"""
MISSING = f"""missing AS (SELECT symbol, ts FROM (SELECT symbol, unnest(generate_series(start, TIMESTAMP '{DUE}', INTERVAL 1 DAY)) AS ts FROM starts) e
  WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = e.symbol AND b.ts = e.ts))"""


def starts(spark, sf):
    return B.coverage_starts(bars(spark, sf), onboard(spark, sf))


@register("b05_coverage_starts", Q.query(Q.DAILY, ONBOARD, select="SELECT symbol, start FROM starts"))
def coverage_starts(spark, sf):
    return starts(spark, sf)


@register("b06_missing_cells", Q.query(Q.DAILY, ONBOARD, MISSING, select="SELECT symbol, ts FROM missing"))
def missing_cells(spark, sf):
    return B.missing_cells(bars(spark, sf), starts(spark, sf), "1d", DUE)


ALLOWED = "allowed AS (SELECT symbol, ts FROM missing WHERE isodow(ts) > 5)"


def by_symbol(spark, sf):
    missing = B.missing_cells(bars(spark, sf), starts(spark, sf), "1d", DUE)
    return B.coverage_by_symbol(doubled(spark, sf), onboard(spark, sf), starts(spark, sf), "1d", DUE, missing.filter(F.weekday("ts") >= 5))


COVER = f"""cov AS (SELECT o.symbol, count(b.ts) > 0 AS present, coalesce(max(b.ts) FILTER (b.ts <= TIMESTAMP '{DUE}') >= TIMESTAMP '{DUE}', false) AS fresh,
  CASE WHEN o.symbol = '5-LOW' THEN (SELECT count(*) FROM bars WHERE symbol = '5-LOW' AND isodow(ts) = 1) ELSE 0 END AS duplicates,
  CASE WHEN count(b.ts) > 0 THEN (SELECT count(*) FROM missing m WHERE m.symbol = o.symbol) ELSE 0 END AS missing_cells,
  CASE WHEN count(b.ts) > 0 THEN (SELECT count(*) FROM allowed m WHERE m.symbol = o.symbol) ELSE 0 END AS confirmed
  FROM onboard o LEFT JOIN bars b USING (symbol) GROUP BY o.symbol)"""


@register("b07_coverage_by_symbol", Q.query(Q.DAILY, ONBOARD, MISSING, ALLOWED, COVER, select="SELECT * FROM cov"))
def coverage_by_symbol(spark, sf):
    return by_symbol(spark, sf)


@register("b07_coverage_report", Q.query(Q.DAILY, ONBOARD, MISSING, ALLOWED, COVER, select="""
SELECT count(*) AS required, count(*) FILTER (present) AS present, count(*) FILTER (fresh) AS fresh, sum(missing_cells)::BIGINT AS missing_cells, sum(confirmed)::BIGINT AS confirmed,
  sum(duplicates)::BIGINT AS duplicates, (sum(missing_cells) - sum(confirmed))::BIGINT AS unresolved, false AS is_publishable FROM cov"""))
def coverage_report(spark, sf):
    return B.coverage_report(by_symbol(spark, sf))


@register("b08_first_gap", Q.query(Q.DAILY, ONBOARD, """v AS (SELECT b.symbol, b.ts, lag(b.ts) OVER (PARTITION BY b.symbol ORDER BY b.ts) AS prev, s.start FROM bars b JOIN starts s ON s.symbol = b.symbol AND b.ts >= s.start)""", select="""
SELECT s.symbol, CASE WHEN min(v.ts) IS NULL OR min(v.ts) > any_value(s.start) THEN any_value(s.start) ELSE min(prev + INTERVAL 1 DAY) FILTER (v.ts - prev > INTERVAL 1 DAY) END AS gap_start
FROM starts s LEFT JOIN v ON v.symbol = s.symbol GROUP BY s.symbol HAVING gap_start IS NOT NULL"""))
def first_gap(spark, sf):
    return B.first_gap(bars(spark, sf), starts(spark, sf), "1d")


@register("b09_confirmed_unavailable", Q.query(Q.DAILY, ONBOARD, MISSING, select="""
SELECT m.symbol, m.ts FROM missing m JOIN starts s USING (symbol) WHERE m.ts >= s.start + INTERVAL 365 DAY"""))
def confirmed_unavailable(spark, sf):
    st = starts(spark, sf)
    missing = B.missing_cells(bars(spark, sf), st, "1d", DUE)
    fetched = st.select("symbol", F.date_add(F.to_date("start"), 365).cast("timestamp_ntz").alias("fetch_start"))
    return B.confirmed_unavailable(missing, fetched)


@register("b10_incremental_merge", Q.query(STATUS, """old AS (SELECT * FROM fin WHERE ts < TIMESTAMP '1999-01-01' OR symbol = '5-LOW'),
ends AS (SELECT symbol, max(ts) AS last FROM old GROUP BY symbol),
fresh AS (SELECT o.* FROM oth o LEFT JOIN ends e USING (symbol) WHERE (e.last IS NULL OR o.ts > e.last) AND o.ts <= TIMESTAMP '2001-01-01'),
merged AS (SELECT ts, symbol, coalesce(a.close, b.close) AS close FROM old a FULL JOIN fresh b USING (ts, symbol))""", select="""
SELECT * FROM merged WHERE ts <= TIMESTAMP '2001-01-01' AND symbol <> '4-NOT SPECIFIED'"""))
def incremental_merge(spark, sf):
    old = status_panel(spark, sf, True).filter((F.col("ts") < T.ntz("1999-01-01 00:00:00")) | (F.col("symbol") == "5-LOW"))
    new = status_panel(spark, sf, False)
    return B.incremental_merge(old, new, "2001-01-01 00:00:00", active=new.filter("symbol <> '4-NOT SPECIFIED'"))


@register("b11_filled_cells", Q.query(STATUS, select="SELECT count(*) AS filled FROM oth b WHERE NOT EXISTS (SELECT 1 FROM fin a WHERE a.ts = b.ts AND a.symbol = b.symbol)"))
def filled_cells(spark, sf):
    a, b = status_panel(spark, sf, True), status_panel(spark, sf, False)
    return B.filled_cells(a, R.patch_panel(a, b))


@register("b12_event_coverage", Q.query(Q.FUNDING_RAW, """moved AS (SELECT symbol, CASE WHEN day(funding_time) BETWEEN 10 AND 12 THEN funding_time - INTERVAL 3 DAY ELSE funding_time END AS funding_time FROM raw_funding),
d AS (SELECT DISTINCT symbol, funding_time FROM moved)""", select="""
SELECT DISTINCT symbol, 'duplicate' AS problem FROM (SELECT symbol, funding_time FROM moved GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT DISTINCT symbol, 'gap' FROM (SELECT symbol, funding_time - lag(funding_time) OVER (PARTITION BY symbol ORDER BY funding_time) AS gap FROM d) WHERE gap > INTERVAL 24 HOUR
UNION ALL SELECT DISTINCT o_orderpriority, 'missing' FROM orders"""))
def event_coverage(spark, sf):
    ev = P.funding_events(spark, sf)
    symbols = ev.select("symbol").unionByName(bars(spark, sf).select("symbol"))
    moved = F.when(F.dayofmonth("funding_time").between(10, 12), F.col("funding_time") - F.expr("INTERVAL 3 DAYS"))
    return B.event_coverage(ev.withColumn("funding_time", F.coalesce(moved, "funding_time")), symbols, 24)


@register("b13_ohlc_violations", Q.query(Q.HOURLY, """x AS (SELECT *, ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS gap, CASE WHEN pos % 50 = 0 THEN low - 1 ELSE high END AS h2, quote * CASE WHEN pos % 40 = 0 THEN -1 ELSE 1 END AS q2 FROM bars),
v AS (SELECT symbol, ts, concat_ws(',', CASE WHEN gap <> INTERVAL 1 HOUR THEN 'gap' END, CASE WHEN least(open, h2, low, close) <= 0 THEN 'price' END, CASE WHEN h2 < greatest(open, close, low) THEN 'high' END,
  CASE WHEN low > least(open, close, h2) THEN 'low' END, CASE WHEN taker > q2 * 1.000001::DOUBLE THEN 'taker' END) AS broken FROM x)""", select="SELECT * FROM v WHERE broken <> ''"))
def ohlc_violations(spark, sf):
    x = P.hourly_bars(spark, sf).withColumn("high", F.when(F.col("pos") % 50 == 0, F.col("low") - 1).otherwise(F.col("high"))) \
        .withColumn("quote", F.col("quote") * F.when(F.col("pos") % 40 == 0, -1).otherwise(1))
    return B.ohlc_violations(x, "1h").select("symbol", "ts", F.concat_ws(",", "broken").alias("broken"))


@register("b14_coverage_stats", Q.query(Q.POSITIONS, """g AS (SELECT symbol, ts, ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS gap FROM positions)""", select="""
SELECT symbol, coalesce(floor(epoch(max(gap)) / 86400), 0)::DOUBLE AS max_gap_days, date_diff('day', max(ts), (SELECT max(ts) FROM positions))::DOUBLE AS days_stale FROM g GROUP BY symbol"""))
def coverage_stats(spark, sf):
    return B.coverage_stats(P.positions(spark, sf))


@register("b15_calendarize", Q.query(Q.DAILY, """c AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM bars GROUP BY symbol)""",
    select="SELECT c.symbol, c.ts, b.close FROM c LEFT JOIN bars b USING (symbol, ts)"))
def calendarize(spark, sf):
    return B.calendarize(bars(spark, sf), "1d", "close").select("symbol", "ts", "close")


@register("b16_quality_flag", Q.query(select="""
SELECT s_name AS symbol, coalesce(nullif(concat_ws(', ', CASE WHEN st <> 'success' THEN st END, CASE WHEN st = 'success' AND s_nationkey % 6 < 3 THEN 'low sample' END,
  CASE WHEN s_nationkey > 7 THEN 'data gap ' || s_nationkey || 'd' END, CASE WHEN s_nationkey * 2 > 30 THEN 'stale ' || (s_nationkey * 2) || 'd' END, CASE WHEN -s_acctbal / 10000 <= -0.75 THEN 'extreme DD' END,
  CASE WHEN s_suppkey % 9 = 0 THEN 'stablecoin-like' END), ''), 'ok') AS flag
FROM (SELECT *, CASE WHEN s_nationkey % 4 = 0 THEN 'skipped' ELSE 'success' END AS st FROM supplier)"""))
def quality_flag(spark, sf):
    s = P.table(spark, sf, "supplier")
    status = F.when(F.col("s_nationkey") % 4 == 0, "skipped").otherwise("success")
    name = F.when(F.col("s_suppkey") % 9 == 0, F.concat(F.lit("usdc"), "s_name")).otherwise(F.col("s_name"))
    flag = B.quality_flag(status, F.col("s_nationkey") % 6, -F.col("s_acctbal") / 10000, F.col("s_nationkey").cast("double"),
                          (F.col("s_nationkey") * 2).cast("double"), name)
    return s.select(F.col("s_name").alias("symbol"), flag.alias("flag"))


def snapshot_history(spark, sf):
    return A.held(spark, sf).select("ts", "symbol", F.col("held").alias("target_weight"))


@register("b17_validate_snapshot", Q.query(*A.CBASE, """h AS (SELECT * FROM held WHERE abs(held) > 1e-12),
last AS (SELECT sum(abs(held)) AS g FROM h WHERE ts = (SELECT max(ts) FROM h))""", select="""
SELECT 'history rows' AS "check", count(*)::DOUBLE AS value, count(*) > 0 AS ok FROM h UNION ALL SELECT 'portfolio rows', count(*)::DOUBLE, true FROM cal
UNION ALL SELECT 'sharpe rows', count(DISTINCT symbol)::DOUBLE, true FROM panel UNION ALL SELECT 'duplicates', 0, true
UNION ALL SELECT 'cutoff', epoch(max(ts))::DOUBLE, max(ts) = TIMESTAMP '2001-08-01' FROM h UNION ALL SELECT 'gross', round(g, 6), g <= 0.9 FROM last"""))
def validate_snapshot(spark, sf):
    df = B.validate_snapshot(snapshot_history(spark, sf), A.calendar(spark, sf), bars(spark, sf).select("symbol").distinct(), "2001-08-01 00:00:00", 0.9)
    return df.select("check", r6("value").alias("value"), "ok")


@register("b18_reconcile_accounting", Q.query(*A.CBASE, A.STATE, select="""
SELECT unnest(['contribution', 'gross exposure', 'net exposure', 'accounting', 'one row per key']) AS "check", true AS ok, (SELECT count(*) FROM state) AS bars"""))
def reconcile_accounting(spark, sf):
    contrib = A.contribution(spark, sf)
    state = A.G.portfolio_daily(contrib, A.calendar(spark, sf))
    checks = B.reconcile_accounting(state, contrib, tol=1e-9)
    return checks.select("check", "ok").crossJoin(state.agg(F.count(F.lit(1)).alias("bars")))


@register("b19_table_digest", Q.query(select="""
SELECT (SELECT count(*) FROM orders) AS n, count(*) FILTER (a IS DISTINCT FROM b) = 0 AS same, count(*) FILTER (a IS DISTINCT FROM c) > 0 AS differs,
  count(*) FILTER (d1 IS DISTINCT FROM d2) > 0 AS nulls_differ
FROM (SELECT o_totalprice AS a, o_totalprice AS b, o_totalprice + 1 AS c, o_totalprice AS d1, NULL::DOUBLE AS d2 FROM orders)"""))
def table_digest(spark, sf):
    o = P.table(spark, sf, "orders")
    one = B.table_digest(o).select("n", F.col("digest").alias("a"))
    two = B.table_digest(o.repartition(7, "o_custkey")).select(F.col("digest").alias("b"))
    three = B.table_digest(o.withColumn("o_totalprice", F.col("o_totalprice") + 1)).select(F.col("digest").alias("c"))
    none = F.lit(None).cast("double")
    left = B.table_digest(o.select(F.col("o_totalprice").alias("x"), none.alias("y"))).select(F.col("digest").alias("d"))
    right = B.table_digest(o.select(none.alias("x"), F.col("o_totalprice").alias("y"))).select(F.col("digest").alias("e"))
    return one.crossJoin(two).crossJoin(three).crossJoin(left).crossJoin(right).select(
        "n", (F.col("a") == F.col("b")).alias("same"), (F.col("a") != F.col("c")).alias("differs"), (F.col("d") != F.col("e")).alias("nulls_differ"))


@register("b20_config_id", Q.query(select="""
SELECT c_custkey, substr(sha256('{"family":"' || c_mktsegment || '","nation":' || c_nationkey || ',"none":null}'), 1, 20) AS config_id FROM customer"""))
def config_id(spark, sf):
    return P.table(spark, sf, "customer").select("c_custkey", B.config_id({"nation": F.col("c_nationkey"), "family": F.col("c_mktsegment"),
                                                                         "none": B.finite(F.lit(float("nan")))}).alias("config_id"))


SPLICE = """main0 AS (SELECT ts, symbol, pos, quote AS close FROM bars WHERE pos >= 10200 + ascii(symbol) - 48),
early0 AS (SELECT ts, symbol, pos, quote / CASE WHEN symbol = '5-LOW' THEN 1 + pos % 7 ELSE 2 END AS e FROM bars WHERE pos < 10260),
ov AS (SELECT m.symbol, m.close / e.e AS r FROM main0 m JOIN early0 e USING (symbol, pos) QUALIFY row_number() OVER (PARTITION BY m.symbol ORDER BY m.pos) <= 7),
rt AS (SELECT symbol, quantile_cont(r, 0.5) AS ratio, count(*) AS n FROM ov GROUP BY symbol),
er AS (SELECT symbol, quantile_cont(abs(r / ratio - 1), 0.5) AS err FROM ov JOIN rt USING (symbol) GROUP BY symbol),
good AS (SELECT symbol, ratio FROM rt JOIN er USING (symbol) WHERE n >= 7 AND ratio > 0 AND err <= 0.1),
j AS (SELECT e.ts, e.symbol, e.pos, e.e * ratio AS close, false AS tradable, ratio FROM early0 e JOIN good USING (symbol) WHERE e.pos < (SELECT min(pos) FROM main0 m WHERE m.symbol = e.symbol)
  UNION ALL SELECT m.ts, m.symbol, m.pos, m.close, true, ratio FROM main0 m JOIN good USING (symbol)),
torn AS (SELECT DISTINCT symbol FROM (SELECT symbol, pos - lag(pos) OVER (PARTITION BY symbol ORDER BY pos) AS gap FROM j) WHERE gap >= 8)"""


def spliced(spark, sf):
    x = bars(spark, sf)
    main = x.filter(F.col("pos") >= 10200 + F.ascii("symbol") - 48).withColumn("close", F.col("quote"))
    early = x.filter("pos < 10260").withColumn("close", F.col("quote") / F.when(F.col("symbol") == "5-LOW", 1 + F.col("pos") % 7).otherwise(2))
    return B.splice_history(main, early, max_gap_days=7)


@register("b21_splice_history", Q.query(Q.DAILY, SPLICE, select="SELECT ts, symbol, round(close, 6) AS close, tradable, round(ratio, 6) AS ratio FROM j WHERE symbol NOT IN (SELECT symbol FROM torn)"))
def splice_history(spark, sf):
    return shown(spliced(spark, sf), "ts", "symbol", "tradable", close="close", ratio="ratio")


@register("b21_price_segments", Q.query(Q.DAILY, SPLICE, select="""
SELECT symbol, min(ts) AS start, max(ts) AS "end", round(any_value(ratio), 6) AS ratio, count(*) AS rows, 'earlier' AS source, false AS tradable
FROM j WHERE NOT tradable AND symbol NOT IN (SELECT symbol FROM torn) GROUP BY symbol"""))
def price_segments(spark, sf):
    return B.price_segments(spliced(spark, sf), "earlier").withColumn("ratio", r6("ratio"))


@register("b22_eligible_symbols", Q.query(Q.POSITIONS, """named AS (SELECT *, CASE WHEN symbol::VARCHAR LIKE '%7' THEN 'EURUSDT' WHEN symbol LIKE '%3' THEN symbol ELSE symbol || 'USDT' END AS name FROM positions)""", select="""
SELECT name AS symbol, count(*) AS n FROM named WHERE name LIKE '%USDT' AND name NOT IN ('S0001USDT', 'EURUSDT') GROUP BY name HAVING count(value) >= 90"""))
def eligible_symbols(spark, sf):
    p = P.positions(spark, sf)
    name = F.when(F.col("symbol").endswith("7"), "EURUSDT").when(F.col("symbol").endswith("3"), F.col("symbol")).otherwise(F.concat("symbol", F.lit("USDT")))
    df = B.eligible_symbols(p.withColumn("symbol", name), 90, excluded=["S0001USDT"], value="value")
    return df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@register("b22_normalize_symbol", Q.query(select="""
SELECT p_partkey, CASE WHEN n LIKE '%USDT' THEN n ELSE n || 'USDT' END AS symbol FROM (SELECT p_partkey, replace(replace(upper(trim(p_type || '/' || p_size || '-usd' || CASE WHEN p_size % 2 = 0 THEN 't ' ELSE '' END)), '/', ''), '-', '') AS n FROM part)"""))
def normalize_symbol(spark, sf):
    raw = F.concat("p_type", F.lit("/"), F.col("p_size").cast("string"), F.lit("-usd"), F.when(F.col("p_size") % 2 == 0, "t ").otherwise(""))
    return P.table(spark, sf, "part").select("p_partkey", B.normalize_symbol(raw).alias("symbol"))
