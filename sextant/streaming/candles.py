"""Closed-candle stream into a panel, and the ledger of emitted signals.

A micro-batch only writes its own rows below ``batch=<id>``, replacing what an
earlier attempt of the same batch wrote, so re-deliveries are harmless and no
batch rewrites the stored panel.  Readers resolve keys over all batches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sextant.functions.dedupe import keep_first, keep_last
from sextant.sources.readers import from_millis

_KLINE = "struct<s: string, i: string, t: bigint, c: string, x: boolean>"
CANDLE_SCHEMA = f"struct<E: bigint, k: {_KLINE}, data: struct<E: bigint, k: {_KLINE}>>"
EMISSION_KEYS = ("data_cutoff", "model", "symbol")


def closed_candles(stream: DataFrame, value: str = "value") -> DataFrame:
    """Finished candles of JSON messages, wrapped in ``data`` or not: symbol, interval, ts, close, arrival."""
    x = stream.select(F.from_json(value, CANDLE_SCHEMA).alias("m"))
    x = x.select(F.coalesce("m.data.k", "m.k").alias("k"), F.coalesce("m.data.E", "m.E").alias("arrival"))
    return x.filter(F.col("k.x")).select(
        F.upper("k.s").alias("symbol"), F.col("k.i").alias("interval"), from_millis(F.col("k.t")).alias("ts"),
        F.col("k.c").cast("double").alias("close"), "arrival")


def known_only(stream: DataFrame, universe: DataFrame) -> DataFrame:
    """Rows of stored symbols; a stream may not widen the universe."""
    return stream.join(universe.select("symbol").distinct(), "symbol", "left_semi")


def write_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    """The last arrival of each (ts, symbol) of one batch, idempotent by batch id."""
    keep_last(rows.select("ts", "symbol", "close", "arrival"), ["ts", "symbol"], F.struct("arrival", "close")) \
        .write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def upsert_candles(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start the merge of closed candles into ``path``."""
    writer = stream.writeStream.foreachBatch(lambda rows, batch: write_batch(rows, batch, path)).option(
        "checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current_panel(spark: SparkSession, path: str, base: DataFrame | None = None) -> DataFrame:
    """Panel after all batches: the last arrival of each cell wins over earlier ones and over ``base``."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*").select("ts", "symbol", "close", "arrival", F.col("batch").cast("bigint").alias("batch"))
    if base is not None:
        none = F.lit(-1).cast("bigint")
        rows = rows.unionByName(base.select("ts", "symbol", "close", none.alias("arrival"), none.alias("batch")))
    return keep_last(rows, ["ts", "symbol"], F.struct("arrival", "batch", "close")).select("ts", "symbol", "close")


def compact(spark: SparkSession, path: str, out: str) -> None:
    """Write the resolved panel by month, as the base of later batches."""
    panel = current_panel(spark, path)
    panel.withColumn("month", F.date_format("ts", "yyyy-MM")).write.mode("overwrite").partitionBy("month").parquet(out)


def append_shadow(rows: DataFrame, batch_id: int, path: str) -> None:
    """Emissions of one batch, the earliest per (data_cutoff, model, symbol); earlier batches win on reading."""
    keep_first(rows, list(EMISSION_KEYS), "emitted_at").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def emitted_signals(spark: SparkSession, path: str, keys: Sequence[str] = EMISSION_KEYS) -> DataFrame:
    """One emission per data cutoff, model and symbol: the one of the first batch, then the earliest."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*").withColumn("batch", F.col("batch").cast("bigint"))
    return keep_first(rows, list(keys), F.struct("batch", "emitted_at")).drop("batch")


def incremental(panel: DataFrame, new: DataFrame, value: str = "close") -> DataFrame:
    """New rows after each symbol's last valid row of the panel; unknown symbols pass whole."""
    last = panel.filter(F.col(value).isNotNull()).groupBy("symbol").agg(F.max("ts").alias("_last"))
    return new.join(last, "symbol", "left").filter(F.col("_last").isNull() | (F.col("ts") > F.col("_last"))).drop("_last")
