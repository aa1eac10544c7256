"""Ledgers and result sinks: append-only parquet with keys enforced by anti-joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions.dedupe import keep_first
from sextant.operators.quality import config_id

# The ledger tables and their unique keys.
LEDGER_KEYS = {
    "universe_snapshots": ("as_of", "symbol", "snapshot_hash"),
    "signal_records": ("timestamp", "symbol", "model_name", "model_version", "data_hash", "config_hash"),
    "funding_events": ("symbol", "funding_time", "source"),
    "actual_funding": ("transaction_id",),
    "portfolio_runs": ("run_id",),
    "daily_portfolio": ("run_id", "timestamp"),
}


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop) or not any(s.getPath().getName().endswith(".parquet") or s.isDirectory()
                                        for s in fs.listStatus(hadoop)):
        return None
    return spark.read.parquet(path)


def new_rows(df: DataFrame, existing: DataFrame | None, keys: Sequence[str], order: Column | str) -> DataFrame:
    """First row of each key that ``existing`` does not hold yet."""
    first = keep_first(df, list(keys), order)
    return first if existing is None else first.join(existing.select(*keys), list(keys), "left_anti")


def append_ledger(df: DataFrame, path: str, keys: Sequence[str], order: Column | str,
                  partition_by: Sequence[str] = ()) -> DataFrame:
    """Insert or ignore on ``keys``; returns the ledger after the append."""
    spark = df.sparkSession
    rows = new_rows(df, _read(spark, path), keys, order)
    rows.write.mode("append").partitionBy(*partition_by).parquet(path)
    return spark.read.parquet(path)


def export_ledger(spark: SparkSession, root: str, out: str, tables: Sequence[str] = tuple(LEDGER_KEYS)) -> None:
    """Each ledger table as CSV and parquet."""
    for name in tables:
        table = _read(spark, f"{root}/{name}")
        if table is not None:
            table.write.mode("overwrite").option("header", True).csv(f"{out}/{name}.csv")
            table.write.mode("overwrite").parquet(f"{out}/{name}.parquet")


def melt_with_run_id(wide: DataFrame, run_id: Column | str, ts: str = "ts", name: str = "model",
                     value: str = "value") -> DataFrame:
    """Wide daily matrices as (run_id, ts, model, value)."""
    models = [c for c in wide.columns if c != ts]
    run = F.lit(run_id) if isinstance(run_id, str) else run_id
    return wide.unpivot([ts], models, name, value).filter(F.col(value).isNotNull()).withColumn("run_id", run)


def content_run_id(manifest: Column) -> Column:
    """Run id addressed by the content of a manifest struct."""
    return F.substring(F.sha2(F.to_json(manifest), 256), 1, 24)


def flatten_config_metrics(df: DataFrame, config_schema: str, metric_schema: str, splits: Sequence[str]) -> DataFrame:
    """JSON columns config and metrics as columns; split metrics are prefixed, nested leftovers stay JSON."""
    cfg = F.from_json("config", config_schema)
    met = F.from_json("metrics", f"map<string,struct<{metric_schema}>>")
    x = df.withColumn("_c", cfg).withColumn("_m", met)
    fields = x.select("_c.*").schema.fields
    plain = [F.to_json(F.col(f"_c.{f.name}")).alias(f.name) if f.dataType.typeName() in ("struct", "array", "map")
             else F.col(f"_c.{f.name}").alias(f.name) for f in fields]
    names = [p.split(":")[0].split()[0].strip() for p in metric_schema.split(",")]
    metrics = [F.col("_m")[s][n].alias(f"{s}_{n}") for s in splits for n in names]
    return x.select("config_id", *plain, *metrics)


def write_candidates(df: DataFrame, path: str) -> None:
    """Score ledger, one row per configuration and fold, partitioned for pruned reads."""
    df.write.mode("append").partitionBy("variant", "family").option("compression", "zstd").parquet(path)


def config_catalog(candidates: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Distinct configurations with their re-computed id: config_id, fields, config JSON, matches."""
    rows = keep_first(candidates.select("config_id", *fields), ["config_id"], F.struct(*fields))
    return rows.withColumn("config", F.to_json(F.struct(*sorted(fields)))).withColumn(
        "matches", F.col("config_id") == config_id(fields))


def catalog_check(catalog: DataFrame) -> DataFrame:
    """Count of configurations; a hash mismatch is an error."""
    bad = F.count_if(~F.col("matches"))
    return catalog.agg(F.count(F.lit(1)).alias("configurations"), bad.alias("_bad")).select(
        F.when(F.col("_bad") == 0, F.col("configurations")).otherwise(
            F.raise_error(F.lit("configuration hash mismatch")).cast("bigint")).alias("configurations"))


def write_catalog(catalog: DataFrame, selection: DataFrame, path: str) -> None:
    """All tested configurations and the selected ones as JSON lines."""
    catalog.select("config_id", "config").write.mode("overwrite").json(f"{path}/all_tested")
    catalog.select("config_id", "config").join(
        selection.filter("selected").drop("config"), "config_id").write.mode("overwrite").json(f"{path}/selected")


def headline_grid(configs: DataFrame, n: int = 250) -> DataFrame:
    """Best ``n`` headline configurations (taker 1, 5 bps; missing counts as such) by validation Sharpe."""
    eligible = configs.filter((F.coalesce("taker_share", F.lit(1.0)) == 1) & (F.coalesce("slippage_bps", F.lit(5.0)) == 5))
    return eligible.orderBy(F.desc_nulls_last("validation_net_sharpe"), "config_id").limit(n)


def newest(rows: DataFrame, n: int = 100, ties: Sequence[str] = ()) -> DataFrame:
    return rows.orderBy(F.desc("ts"), *ties).limit(n)


def funding_totals(summary: DataFrame) -> DataFrame:
    """Paid, received and net per model over the ALL-period rows."""
    return summary.filter(F.col("period") == "ALL").groupBy("model").agg(
        F.sum("paid").alias("paid"), F.sum("received").alias("received"), F.sum("net").alias("net"))
