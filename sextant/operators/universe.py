"""Universe membership: contracts, provider identities, ranks with hysteresis, sectors, tradability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions import spread as D
from sextant.functions import timeaxis as T
from sextant.functions.dedupe import keep_first
from sextant.operators.quality import STABLE_BASES, table_digest
from sextant.sources.readers import from_millis

CONTRACT_SCHEMA = (
    "struct<symbols: array<struct<symbol: string, baseAsset: string, quoteAsset: string, contractType: string, "
    "status: string, onboardDate: bigint, deliveryDate: bigint>>>")


def eligible_contracts(info: DataFrame, payload: str = "payload", quote: str = "USDT") -> DataFrame:
    """Perpetual contracts of exchange metadata; only a contract no longer trading has a delisting time."""
    row = info.select(F.explode(F.from_json(payload, CONTRACT_SCHEMA)["symbols"]).alias("s")).select("s.*")
    x = row.filter((F.col("quoteAsset") == quote) & (F.col("contractType") == "PERPETUAL"))
    base = F.coalesce("baseAsset", F.regexp_replace("symbol", f"{quote}$", ""))
    return x.select("symbol", base.alias("base_asset"), from_millis(F.col("onboardDate")).alias("listing_time"),
                    F.when(F.col("status") != "TRADING", from_millis(F.col("deliveryDate"))).alias("delisting_time"))


def resolve_assets(assets: DataFrame, provider_rows: DataFrame, provider: str) -> DataFrame:
    """Assets with the provider row of their base: highest FDV, then lowest id.

    Adds provider, provider_id, fdv, candidate_count and provenance; an asset
    without a match keeps nulls.
    """
    rows = provider_rows.withColumn("symbol", F.upper("symbol"))
    best = keep_first(rows.select(F.col("symbol").alias("base_asset"), "provider_id", "fdv"), ["base_asset"],
                      F.struct(F.col("fdv").isNull(), -F.col("fdv"), F.col("provider_id")))
    counts = rows.groupBy(F.col("symbol").alias("base_asset")).agg(F.count(F.lit(1)).alias("candidate_count"))
    x = assets.join(best.join(counts, "base_asset"), "base_asset", "left")
    found = F.col("provider_id").isNotNull()
    return x.withColumn("provider", F.when(found, F.lit(provider))).withColumn("provenance", F.when(
        found, F.format_string(f"{provider}:symbol=%s;candidates=%d", "base_asset", "candidate_count")))


def provider_cascade(providers: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Rows of the first provider in order that has any FDV at all."""
    rows = None
    for rank, (name, df) in enumerate(providers):
        part = df.select("provider_id", "symbol", F.col("fdv").cast("double").alias("fdv"), F.lit(name).alias("provider"), F.lit(rank).alias("_rank"))
        rows = part if rows is None else rows.unionByName(part)
    chosen = rows.filter(F.col("fdv").isNotNull()).agg(F.min("_rank").alias("_rank"))
    return rows.join(chosen, "_rank").drop("_rank")


def trailing_median_volume(df: DataFrame, n: int = 30, value: str = "quote") -> DataFrame:
    """Median of each symbol over the newest ``n`` dates of the panel."""
    recent = df.select("ts").distinct().orderBy(F.desc("ts")).limit(n)
    return D.quantiles(df.join(recent, "ts", "left_semi"), ["symbol"], value, {"median_volume": 0.5})


def reconstitution_cutoff(as_of: Column) -> Column:
    """Last microsecond of the month before ``as_of``."""
    return T.month(as_of) - F.expr("INTERVAL '0.000001' SECOND")


def monthly_snapshot(assets: DataFrame, volumes: DataFrame, previous: DataFrame | None, as_of, *, min_volume: float,
                     max_members: int = 100, entry_rank: int = 90, exit_rank: int = 110,
                     stable: Sequence[str] = STABLE_BASES) -> DataFrame:
    """Ranks and membership of one month: as_of, symbol, fdv, volume, rank, eligible, member, reasons, snapshot_hash.

    ``assets``: symbol, base_asset, fdv; ``previous``: symbols of the month before.
    The first month takes the top ``max_members``; later a member stays to
    ``exit_rank`` and a newcomer needs ``entry_rank``.  Ranks are bucketed, and at
    most ``exit_rank`` candidates are counted against the cap.
    """
    x = assets.select("symbol", "base_asset", "fdv").join(
        volumes.select("symbol", F.col("median_volume").alias("volume")), "symbol", "left")
    is_stable = F.upper("base_asset").isin(list(stable))
    low = F.coalesce(F.col("volume") < min_volume, F.lit(True))
    reasons = F.array_compact(F.array(
        F.when(F.col("fdv").isNull(), F.lit("missing_fdv")), F.when(low, F.lit("low_volume")), F.when(is_stable, F.lit("stablecoin"))))
    x = x.withColumn("reasons", reasons).withColumn("eligible", F.size("reasons") == 0)
    ranked = D.rank_within(x.withColumn("_f", F.when(F.col("eligible"), F.col("fdv"))), [], "_f", "rank", how="row",
                           ties=["symbol"], descending=True).drop("_f")
    if previous is None:
        judged = ranked.withColumn("_limit", F.lit(max_members))
    else:
        was = previous.select("symbol", F.lit(True).alias("_was"))
        started = previous.agg((F.count(F.lit(1)) > 0).alias("_any"))
        judged = ranked.join(was, "symbol", "left").crossJoin(started).withColumn("_limit", F.when(
            ~F.col("_any"), F.lit(max_members)).when(F.coalesce("_was", F.lit(False)), F.lit(exit_rank)).otherwise(
            F.lit(entry_rank))).drop("_was", "_any")
    passing = judged.filter(F.col("rank") <= F.col("_limit")).select("symbol", "rank")
    order = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("rank"))
    members = passing.withColumn("_k", order).filter(F.col("_k") <= max_members).select("symbol", F.lit(True).alias("_m"))
    digest = table_digest(ranked.select("symbol", "fdv", "volume", "rank")).select(F.col("digest").alias("snapshot_hash"))
    out = judged.drop("_limit").join(members, "symbol", "left").crossJoin(digest)
    return out.select(reconstitution_cutoff(T.ntz(as_of)).alias("as_of"), "symbol", "fdv", "volume", "rank", "eligible",
                      F.coalesce("_m", F.lit(False)).alias("member"), "reasons", "snapshot_hash")


def enrich_universe(members: DataFrame, mapping: DataFrame, meta: DataFrame, volumes: DataFrame) -> DataFrame:
    """Members with listing time, sector (first category or Unclassified), categories as JSON and median volume."""
    x = members.join(mapping.select("symbol", "provider_id", "listing_time"), "symbol", "left").join(
        meta.select("provider_id", "categories"), "provider_id", "left").join(volumes.select("symbol", "median_volume"), "symbol", "left")
    sector = F.coalesce(F.try_element_at("categories", F.lit(1)), F.lit("Unclassified"))
    return x.withColumn("sector", sector).withColumn("categories", F.to_json(F.coalesce("categories", F.array().cast("array<string>"))))


def sector_symbols(mapping: DataFrame, meta: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Symbols with a category that contains any of the terms, ignoring case."""
    wanted = [t.lower() for t in terms]

    def hit(category: Column) -> Column:
        out = F.lit(False)
        for term in wanted:
            out = out | F.contains(F.lower(category), F.lit(term))
        return out

    x = mapping.join(meta.select("provider_id", "categories"), "provider_id")
    return x.filter(F.exists("categories", hit)).select("symbol").distinct()


def tradability_mask(calendar: DataFrame, events: DataFrame, symbols: DataFrame, strict: bool = True) -> DataFrame:
    """Is each symbol tradable on each day: from the day after its first priced funding event."""
    first = events.filter(F.col("mark_price").isNotNull()).groupBy("symbol").agg(F.min("funding_time").alias("_f"))
    x = symbols.select("symbol").distinct().join(first, "symbol", "left")
    if strict:
        x = x.withColumn("_f", F.when(F.col("_f").isNull(), F.raise_error(
            F.concat(F.lit("no fully priced funding event for "), "symbol")).cast("timestamp_ntz")).otherwise(F.col("_f")))
    x = x.withColumn("_d", F.date_add(F.to_date("_f"), 1))
    return calendar.crossJoin(x).select("ts", "pos", "symbol", F.coalesce(F.to_date("ts") >= F.col("_d"), F.lit(False)).alias("tradable"))
