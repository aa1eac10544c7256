"""Scans: wide panels, kline payloads, funding and income tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import timeaxis as T
from sextant.functions.dedupe import keep_first, keep_last

# Field order of a kline payload.
KLINE_FIELDS = ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume",
                "trades", "taker_base", "taker_quote", "ignore")
# Column names of account exports and what they are called here.
INCOME_ALIASES = {"tranId": "transaction_id", "time": "ts", "timestamp": "ts", "income": "income_usd",
                  "incomeType": "income_type"}
INCOME_COLUMNS = ("transaction_id", "symbol", "asset", "ts", "income_usd")


def from_millis(ms: Column) -> Column:
    """UTC timestamp without zone of an epoch in milliseconds; 0 and null have none."""
    n = F.nullif(ms.cast("bigint"), F.lit(0).cast("bigint"))
    return F.timestamp_add("MILLISECOND", n, T.ntz("1970-01-01 00:00:00"))


def utc_ntz(ts: Column, zone: str | None = None) -> Column:
    """Local wall time of ``zone`` as UTC without zone; a zoned timestamp just loses its zone."""
    if zone is None:
        return ts.cast("timestamp_ntz")
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), ts.cast("timestamp_ntz"))


def wide_to_long(wide: DataFrame, ts: str = "ts", value: str = "close") -> DataFrame:
    """A date x symbol matrix as (ts, symbol, value) without the missing cells."""
    symbols = [c for c in wide.columns if c != ts]
    return wide.unpivot([ts], symbols, "symbol", value).filter(
        F.col(value).isNotNull() & ~F.isnan(value))


def read_panel(spark: SparkSession, path: str, ts: str = "ts") -> DataFrame:
    return wide_to_long(spark.read.parquet(path), ts)


def patch_panel(new: DataFrame, old: DataFrame, value: str = "close") -> DataFrame:
    """Union of the cells of two panels; the new value wins where it is not null."""
    a = new.select("ts", "symbol", F.col(value).alias("_new"))
    b = old.select("ts", "symbol", F.col(value).alias("_old"))
    return a.join(b, ["ts", "symbol"], "full").select("ts", "symbol", F.coalesce("_new", "_old").alias(value))


def _exploded(raw: DataFrame, payload: str) -> DataFrame:
    rows = F.from_json(payload, "array<array<string>>")
    rest = [c for c in raw.columns if c != payload]
    return raw.select(*rest, F.posexplode(rows).alias("_at", "_k"))


def flatten_klines(raw: DataFrame, payload: str = "payload", seq: str = "seq") -> DataFrame:
    """Typed bars of kline payloads (symbol, seq, payload); the last duplicate of a bar wins."""
    x = _exploded(raw, payload)
    field = {name: F.col("_k")[i] for i, name in enumerate(KLINE_FIELDS)}
    doubles = [n for n in KLINE_FIELDS if n not in ("open_time", "close_time", "ignore")]
    bars = x.select("symbol", from_millis(field["open_time"]).alias("ts"), F.struct(seq, "_at").alias("_order"),
                    *[field[n].cast("double").alias(n) for n in doubles])
    return keep_last(bars, ["symbol", "ts"], "_order").drop("_order")


def flatten_mark_klines(raw: DataFrame, payload: str = "payload", seq: str = "seq") -> DataFrame:
    """Mark prices of 8 h klines: the open, known at the event timestamp."""
    x = _exploded(raw, payload).select(
        "symbol", from_millis(F.col("_k")[0]).alias("ts"), F.col("_k")[1].cast("double").alias("mark"),
        F.struct(seq, "_at").alias("_order"))
    return keep_last(x, ["symbol", "ts"], "_order").drop("_order")


def kline_quote_volume(raw: DataFrame, payload: str = "payload", seq: str = "seq") -> DataFrame:
    """Quote volume of the bars by UTC day; bars shorter than a day add up."""
    bars = flatten_klines(raw, payload, seq)
    return bars.groupBy(T.day(F.col("ts")).alias("day"), "symbol").agg(
        F.sum("quote_volume").alias("quote_volume")).withColumnRenamed("day", "ts")


def rename_income(df: DataFrame, aliases: Mapping[str, str] = INCOME_ALIASES) -> DataFrame:
    """Exports under our column names; a missing required column is an error."""
    for old, new in aliases.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    missing = sorted(set(INCOME_COLUMNS) - set(df.columns))
    if missing:
        raise ValueError(f"income table is missing {missing}")
    return df


def income_from_export(df: DataFrame, only: str | None = "FUNDING_FEE") -> DataFrame:
    """Typed income rows, filtered by income type where the export has one, one per transaction."""
    x = rename_income(df)
    if only and "income_type" in x.columns:
        x = x.filter(F.upper("income_type") == only)
    x = x.select(F.col("transaction_id").cast("string").alias("transaction_id"), "symbol", "asset",
                 T.ntz(F.col("ts")).alias("ts"), F.col("income_usd").cast("double").alias("income_usd"))
    return keep_first(x, ["transaction_id"], F.struct("ts", "symbol", "asset", "income_usd"))


def read_income_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Income rows of CSV files with a header; everything is read as text and cast once."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return income_from_export(spark.read.csv(path, header=True, schema=schema))


def normalize_funding(raw: DataFrame, seq: str = "seq") -> DataFrame:
    """Funding payload rows (fundingTime ms, text numbers) typed; the last of (symbol, time) wins."""
    x = raw.select("symbol", from_millis(F.col("fundingTime")).alias("funding_time"),
                   F.col("fundingRate").cast("double").alias("funding_rate"),
                   F.expr("try_cast(markPrice AS double)").alias("mark_price"), F.col(seq).alias("_seq"))
    return keep_last(x, ["symbol", "funding_time"], "_seq").drop("_seq")


def normalize_income(raw: DataFrame, seq: str = "seq") -> DataFrame:
    """Income payload rows typed, the last of each transaction wins."""
    x = raw.select(F.col("tranId").cast("string").alias("transaction_id"), "symbol", "asset",
                   from_millis(F.col("time")).alias("ts"), F.col("income").cast("double").alias("income_usd"),
                   F.col(seq).alias("_seq"))
    return keep_last(x, ["transaction_id"], "_seq").drop("_seq")
