"""Time alignment, coverage, validation and identity of panels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions import series as S
from sextant.functions import spread as D
from sextant.functions import timeaxis as T
from sextant.session import cut_lineage
from sextant.sources.readers import patch_panel

# Bar length in seconds by frequency label.
FREQ_SECONDS = {"1d": T.DAY, "4h": 4 * T.HOUR, "1h": T.HOUR}
# Bases that follow a currency, and prefixes that read like one.
STABLE_BASES = ("USDT", "USDC", "BUSD", "TUSD", "FDUSD", "USDP", "DAI", "FRAX", "PYUSD", "USDE", "USD1", "EUR", "EURC")
STABLE_PREFIXES = ("USDC", "FDUSD", "TUSD", "USDP")


def last_complete_open(now: Column, freq: str) -> Column:
    """Open of the newest bar that is complete at ``now``."""
    n, unit = int(freq[:-1]), freq[-1]
    if unit == "d":
        return T.from_epoch(T.epoch_second(T.day(now)) - n * T.DAY)
    if unit == "h":
        return T.from_epoch(T.epoch_second(T.floor_to(now, n * T.HOUR)) - n * T.HOUR)
    raise ValueError(f"unsupported frequency {freq!r}")


def freshness(df: DataFrame, freq: str, now) -> DataFrame:
    """Newest row of each symbol against the last complete bar: symbol, latest, required, is_fresh."""
    required = last_complete_open(T.ntz(now), freq)
    return df.groupBy("symbol").agg(F.max("ts").alias("latest")).withColumn("required", required).withColumn(
        "is_fresh", F.col("latest") >= F.col("required"))


def _calendar_gaps(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Seconds from the previous row of each series: (keys, pos, gap), pos in seconds."""
    rows = df.select(*keys, T.epoch_second(F.col("ts")).alias("pos")).distinct()
    lagged = S.running(rows, {"_prev": ("last", "pos", False)}, keys=keys, block=90 * T.DAY)
    return lagged.filter(F.col("_prev").isNotNull()).select(
        *keys, "pos", "_prev", (F.col("pos") - F.col("_prev")).alias("gap"))


def infer_frequency(df: DataFrame) -> DataFrame:
    """Modal distance of consecutive timestamps, ties to the smallest: (gap, frequency)."""
    counts = _calendar_gaps(df).groupBy("gap").agg(F.count(F.lit(1)).alias("n"))
    modal = counts.agg(F.min_by("gap", F.struct(-F.col("n"), F.col("gap"))).alias("gap"))
    label = F.when(F.col("gap").isNull(), "unknown")
    for name, seconds in FREQ_SECONDS.items():
        label = label.when(F.col("gap") == seconds, name)
    return modal.withColumn("frequency", label.otherwise(F.concat(F.lit("irregular:"), F.col("gap").cast("string"), F.lit("s"))))


def resolve_frequency(inferred: DataFrame, configured: str = "auto", strict: bool = False) -> DataFrame:
    """Adds effective, is_match and warning; a strict mismatch raises when evaluated."""
    odd = F.col("frequency").startswith("irregular:") | (F.col("frequency") == "unknown")
    if configured == "auto":
        return inferred.withColumn("effective", F.col("frequency")).withColumn("is_match", F.lit(True)).withColumn(
            "warning", F.when(odd, F.concat(F.lit("no regular frequency: "), "frequency")))
    same = F.col("frequency") == configured
    text = F.concat(F.lit(f"configured {configured} differs from "), "frequency")
    warning = F.when(~same, F.raise_error(text) if strict else text)
    return inferred.withColumn("effective", F.lit(configured)).withColumn("is_match", same).withColumn(
        "warning", warning.cast("string"))


def profile_panel(df: DataFrame, value: str = "close") -> DataFrame:
    """One row: rows (timestamps), columns (symbols), span, duplicate cells, missing share and warnings."""
    cells = df.groupBy("ts", "symbol").agg(F.count(F.lit(1)).alias("_n"), F.count(value).alias("_v"))
    x = cells.agg(
        F.countDistinct("ts").alias("rows"), F.countDistinct("symbol").alias("columns"), F.min("ts").alias("start"),
        F.max("ts").alias("end"), F.sum(F.col("_n") - 1).alias("duplicates"), F.count_if(F.col("_v") > 0).alias("_f"))
    missing = (1 - F.col("_f") / F.nullif(F.col("rows") * F.col("columns"), F.lit(0))) * 100
    x = x.withColumn("missing_pct", F.coalesce(missing, F.lit(0.0))).drop("_f")
    return x.withColumn("warnings", F.array_compact(F.array(
        F.when(F.col("duplicates") > 0, F.concat(F.col("duplicates").cast("string"), F.lit(" duplicate cells"))),
        F.when(F.col("rows") < 2, F.lit("too few rows")))))


def coverage_starts(df: DataFrame, onboard: DataFrame, value: str = "close") -> DataFrame:
    """First valid row on or after the onboard date, else the onboard date, else the first valid row."""
    wanted = onboard.select("symbol", F.col("onboard_ts").alias("_o"))
    seen = df.filter(F.col(value).isNotNull()).join(wanted, "symbol", "left").groupBy("symbol").agg(
        F.min(F.when(F.col("_o").isNull() | (F.col("ts") >= F.col("_o")), F.col("ts"))).alias("_s"))
    return wanted.join(seen, "symbol", "full").select("symbol", F.coalesce("_s", "_o").alias("start"))


def missing_cells(df: DataFrame, starts: DataFrame, freq: str, required, value: str = "close") -> DataFrame:
    """Expected cells from each start through ``required`` that the panel lacks: (symbol, ts)."""
    step = FREQ_SECONDS[freq]
    a, b = T.epoch_second(F.col("start")), T.epoch_second(T.ntz(required))
    expected = starts.filter(F.col("start") <= T.ntz(required)).select(
        "symbol", F.explode(F.sequence(a, b, F.lit(step).cast("bigint"))).alias("_sec")).select(
        "symbol", T.from_epoch(F.col("_sec")).alias("ts"))
    return expected.join(df.filter(F.col(value).isNotNull()).select("symbol", "ts"), ["symbol", "ts"], "left_anti")


def coverage_by_symbol(df: DataFrame, required_symbols: DataFrame, starts: DataFrame, freq: str, required,
                       allowed: DataFrame | None = None, value: str = "close") -> DataFrame:
    """Per required symbol: present, fresh, duplicates, missing cells and how many of them are confirmed."""
    due = T.ntz(required)
    want = required_symbols.select("symbol").distinct()
    panel = df.join(want, "symbol", "left_semi")
    per = panel.groupBy("symbol").agg(
        F.max(F.when(F.col(value).isNotNull() & (F.col("ts") <= due), F.col("ts"))).alias("_last"),
        (F.count(F.lit(1)) - F.countDistinct("ts")).alias("duplicates"), F.lit(True).alias("present"))
    valid = panel.filter(F.col(value).isNotNull()).select("symbol").distinct()
    gaps = missing_cells(panel, starts.join(valid, "symbol", "left_semi"), freq, required, value)
    known = (allowed if allowed is not None else gaps.limit(0)).select("symbol", "ts", F.lit(True).alias("_a"))
    counts = gaps.join(known, ["symbol", "ts"], "left").groupBy("symbol").agg(
        F.count(F.lit(1)).alias("missing_cells"), F.count("_a").alias("confirmed"))
    x = want.join(per, "symbol", "left").join(counts, "symbol", "left")
    zero = F.lit(0).cast("bigint")
    return x.select("symbol", F.coalesce("present", F.lit(False)).alias("present"),
                    F.coalesce(F.col("_last") >= due, F.lit(False)).alias("fresh"),
                    *[F.coalesce(c, zero).alias(c) for c in ("duplicates", "missing_cells", "confirmed")])


def coverage_report(by_symbol: DataFrame) -> DataFrame:
    """One row: counts over the required symbols and whether the panel may be published."""
    x = by_symbol.agg(
        F.count(F.lit(1)).alias("required"), F.count_if("present").alias("present"), F.count_if("fresh").alias("fresh"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("missing_cells", "confirmed", "duplicates")])
    x = x.withColumn("unresolved", F.col("missing_cells") - F.col("confirmed"))
    return x.withColumn("is_publishable", (F.col("required") > 0) & (F.col("present") == F.col("required")) & (
        F.col("fresh") == F.col("required")) & (F.col("unresolved") == 0) & (F.col("duplicates") == 0))


def first_gap(df: DataFrame, starts: DataFrame, freq: str, required=None, value: str = "close") -> DataFrame:
    """First missing bar of each symbol: its start if the head is missing, else the first inner gap."""
    step = FREQ_SECONDS[freq]
    valid = df.filter(F.col(value).isNotNull()).join(starts.select("symbol", F.col("start").alias("_s")), "symbol", "left")
    valid = valid.filter(F.col("_s").isNull() | (F.col("ts") >= F.col("_s")))
    if required is not None:
        valid = valid.filter(F.col("ts") <= T.ntz(required))
    gaps = _calendar_gaps(valid, ["symbol"]).filter(F.col("gap") > step).groupBy("symbol").agg(
        F.min(F.col("_prev") + step).alias("_g"))
    heads = valid.groupBy("symbol").agg(F.min("ts").alias("_first"))
    x = starts.select("symbol", F.col("start").alias("_s")).join(heads, "symbol", "full").join(gaps, "symbol", "left")
    late = F.col("_s").isNotNull() & (F.col("_first").isNull() | (F.col("_first") > F.col("_s")))
    return x.select("symbol", F.when(late, F.col("_s")).otherwise(T.from_epoch(F.col("_g"))).alias("gap_start")).filter(
        F.col("gap_start").isNotNull())


def confirmed_unavailable(missing: DataFrame, fetch_starts: DataFrame) -> DataFrame:
    """Missing cells at or after a successful fetch start (symbol, fetch_start)."""
    return missing.join(fetch_starts, "symbol").filter(F.col("ts") >= F.col("fetch_start")).select("symbol", "ts")


def incremental_merge(old: DataFrame, new: DataFrame, required, gap_starts: DataFrame | None = None,
                      active: DataFrame | None = None, value: str = "close") -> DataFrame:
    """Old panel patched with new rows after each symbol's last valid row (or from its gap on).

    The stored value wins where both exist; nothing after ``required`` is kept;
    with ``active`` the other symbols are dropped.
    """
    due = T.ntz(required)
    last = old.filter(F.col(value).isNotNull()).groupBy("symbol").agg(F.max("ts").alias("_last"))
    x = new.join(last, "symbol", "left")
    if gap_starts is not None:
        x = x.join(gap_starts.select("symbol", F.col("gap_start").alias("_gap")), "symbol", "left")
    else:
        x = x.withColumn("_gap", F.lit(None).cast("timestamp_ntz"))
    keep = F.when(F.col("_gap").isNotNull(), F.col("ts") >= F.col("_gap")).when(
        F.col("_last").isNotNull(), F.col("ts") > F.col("_last")).otherwise(F.lit(True))
    fresh = x.filter(keep & (F.col("ts") <= due)).select("ts", "symbol", value)
    out = patch_panel(old, fresh, value).filter(F.col("ts") <= due)
    return out if active is None else out.join(active.select("symbol").distinct(), "symbol", "left_semi")


def filled_cells(base: DataFrame, merged: DataFrame, value: str = "close") -> DataFrame:
    """Cells that only the merged panel fills: one row."""
    a = base.select("ts", "symbol", F.col(value).alias("_a"))
    b = merged.select("ts", "symbol", F.col(value).alias("_b"))
    return a.join(b, ["ts", "symbol"], "full").agg(F.count_if(F.col("_a").isNull() & F.col("_b").isNotNull()).alias("filled"))


def event_coverage(events: DataFrame, symbols: DataFrame, max_gap_h: float, time: str = "funding_time") -> DataFrame:
    """Violations of event coverage: (symbol, problem) with duplicate, gap or missing."""
    x = events.withColumn("ts", F.col(time))
    twice = x.groupBy("symbol", "ts").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("symbol").distinct()
    wide = _calendar_gaps(x, ["symbol"]).filter(F.col("gap") > max_gap_h * T.HOUR).select("symbol").distinct()
    none = symbols.select("symbol").distinct().join(x.select("symbol"), "symbol", "left_anti")
    return twice.withColumn("problem", F.lit("duplicate")).unionByName(
        wide.withColumn("problem", F.lit("gap"))).unionByName(none.withColumn("problem", F.lit("missing")))


def ohlc_violations(df: DataFrame, freq: str) -> DataFrame:
    """Bars that break a sanity rule, with the list of broken rules."""
    step = FREQ_SECONDS[freq]
    gaps = _calendar_gaps(df, ["symbol"]).filter(F.col("gap") != step).select("symbol", T.from_epoch(F.col("pos")).alias("ts"),
                                                                              F.lit(True).alias("_gap"))
    body_high, body_low = F.greatest("open", "close", "low"), F.least("open", "close", "high")
    x = df.join(gaps, ["symbol", "ts"], "left")
    rules = F.array_compact(F.array(
        F.when(F.coalesce("_gap", F.lit(False)), F.lit("gap")),
        F.when(F.least("open", "high", "low", "close") <= 0, F.lit("price")),
        F.when(F.col("high") < body_high, F.lit("high")), F.when(F.col("low") > body_low, F.lit("low")),
        F.when(F.col("volume") < 0, F.lit("volume")),
        F.when(F.col("taker") > F.col("quote") * 1.000001, F.lit("taker"))))
    return x.withColumn("broken", rules).filter(F.size("broken") > 0).drop("_gap")


def coverage_stats(df: DataFrame) -> DataFrame:
    """Largest gap and age in whole days of each symbol against the newest row of all."""
    gaps = _calendar_gaps(df, ["symbol"]).groupBy("symbol").agg(F.max("gap").alias("_g"))
    ends = df.groupBy("symbol").agg(F.max("ts").alias("_e"))
    x = D.with_totals(ends.join(gaps, "symbol", "left"), [], _all=F.max("_e"))
    return x.select("symbol", F.floor(F.coalesce(F.col("_g"), F.lit(0)) / T.DAY).cast("double").alias("max_gap_days"),
                    F.floor((T.epoch_second(F.col("_all")) - T.epoch_second(F.col("_e"))) / T.DAY).cast("double").alias("days_stale"))


def calendarize(df: DataFrame, freq: str, *values: str) -> DataFrame:
    """Each series on every bar from its first to its last row; added bars are null."""
    step = FREQ_SECONDS[freq]
    ends = df.groupBy("symbol").agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    bars = ends.select("symbol", F.explode(F.sequence(
        T.epoch_second(F.col("_a")), T.epoch_second(F.col("_b")), F.lit(step).cast("bigint"))).alias("_sec"))
    bars = bars.select("symbol", T.from_epoch(F.col("_sec")).alias("ts"))
    return bars.join(df.select("symbol", "ts", *values), ["symbol", "ts"], "left")


def quality_flag(status: Column, windows: Column, drawdown: Column, gap: Column, stale: Column, symbol: Column) -> Column:
    """Comma separated warnings of a study row, ``ok`` without any."""
    looks_stable = F.lit(False)
    for prefix in STABLE_PREFIXES:
        looks_stable = looks_stable | F.upper(symbol).startswith(prefix)
    flags = F.array_compact(F.array(
        F.when(status != "success", status), F.when((status == "success") & (windows < 3), F.lit("low sample")),
        F.when(gap > 7, F.format_string("data gap %.0fd", gap)), F.when(stale > 30, F.format_string("stale %.0fd", stale)),
        F.when(drawdown <= -0.75, F.lit("extreme DD")), F.when(looks_stable, F.lit("stablecoin-like"))))
    return F.when(F.size(flags) == 0, F.lit("ok")).otherwise(F.concat_ws(", ", flags))


def validate_snapshot(history: DataFrame, portfolio: DataFrame, sharpes: DataFrame, cutoff, gross_cap: float) -> DataFrame:
    """Checks of a snapshot: (check, value, ok)."""
    h = history.groupBy("ts", "symbol").agg(F.count(F.lit(1)).alias("_n"), F.sum("target_weight").alias("_w")).groupBy("ts").agg(
        F.sum("_n").alias("_n"), F.sum(F.col("_n") - 1).alias("_dup"), F.sum(F.abs("_w")).alias("_g"))
    x = h.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum("_dup"), F.lit(0)).alias("dup"),
              F.max("ts").alias("last"), F.max_by("_g", "ts").alias("g"))
    p = portfolio.agg(F.count(F.lit(1)).alias("np"))
    s = sharpes.agg(F.count(F.lit(1)).alias("ns"))
    one = x.crossJoin(p).crossJoin(s)

    def check(name: str, value: Column, ok: Column) -> Column:
        return F.struct(F.lit(name).alias("check"), value.cast("double").alias("value"), F.coalesce(ok, F.lit(False)).alias("ok"))

    return one.select(F.inline(F.array(
        check("history rows", F.col("n"), F.col("n") > 0), check("portfolio rows", F.col("np"), F.col("np") > 0),
        check("sharpe rows", F.col("ns"), F.col("ns") > 0), check("duplicates", F.col("dup"), F.col("dup") == 0),
        check("cutoff", T.epoch_second(F.col("last")), F.col("last") == T.ntz(cutoff)),
        check("gross", F.col("g"), F.col("g") <= gross_cap + 1e-6))))


def reconcile_accounting(state: DataFrame, positions: DataFrame, keys: Sequence[str] = ("ts",), tol: float = 1e-12) -> DataFrame:
    """Largest differences between a daily state and its positions: (check, value, ok).

    ``state``: keys, net, gross, fee, slippage, funding, gross_exposure, net_exposure;
    ``positions``: keys, symbol, held, contribution.
    """
    sums = positions.groupBy(*keys).agg(
        F.sum("contribution").alias("_c"), F.sum(F.abs("held")).alias("_g"), F.sum("held").alias("_n"))
    twice = state.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k")).agg(F.coalesce(F.max("_k"), F.lit(0)).alias("_k"))
    x = state.join(sums, list(keys)).agg(
        F.max(F.abs(F.col("net") - F.col("_c"))).alias("a"), F.max(F.abs(F.col("gross_exposure") - F.col("_g"))).alias("b"),
        F.max(F.abs(F.col("net_exposure") - F.col("_n"))).alias("c"),
        F.max(F.abs(F.col("net") - (F.col("gross") - F.col("fee") - F.col("slippage") + F.col("funding")))).alias("d")).crossJoin(twice)
    names = {"contribution": "a", "gross exposure": "b", "net exposure": "c", "accounting": "d"}
    rows = [F.struct(F.lit(n).alias("check"), F.col(c).alias("value"), F.coalesce(F.col(c) < tol, F.lit(False)).alias("ok"))
            for n, c in names.items()]
    rows.append(F.struct(F.lit("one row per key").alias("check"), F.col("_k").cast("double").alias("value"), (F.col("_k") <= 1).alias("ok")))
    return x.select(F.inline(F.array(*rows)))


def table_digest(df: DataFrame) -> DataFrame:
    """Digest of the content of a table, whatever the order of its rows."""
    names = sorted(df.columns)
    # the hash passes over nulls, so their places are hashed too
    row = F.xxhash64(F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in names]), *[F.col(c) for c in names])
    x = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(row).alias("_x"), F.sum(row.cast("decimal(38,0)")).alias("_s"))
    return x.select("n", F.sha2(F.concat_ws("|", "n", F.coalesce("_x", F.lit(0)).cast("string"),
                                            F.coalesce("_s", F.lit(0)).cast("string")), 256).alias("digest"))


def config_id(fields: Sequence[str] | Mapping[str, Column]) -> Column:
    """First 20 hex digits of the SHA-256 of canonical JSON; keys sorted, NaN and infinity as null, null keys kept."""
    cols = {f: F.col(f) for f in fields} if not isinstance(fields, Mapping) else dict(fields)
    record = F.struct(*[_json_safe(cols[n]).alias(n) for n in sorted(cols)])
    return F.substring(F.sha2(F.to_json(record, {"ignoreNullFields": "false"}), 256), 1, 20)


def _json_safe(x: Column) -> Column:
    """Null for a floating point value that JSON cannot hold; other types as they are."""
    value = x.try_cast("double")
    odd = F.typeof(x).isin("double", "float") & (F.isnan(value) | (F.abs(value) == float("inf")))
    return F.when(~F.coalesce(odd, F.lit(False)), x)


def finite(x: Column) -> Column:
    """Null for NaN and infinity."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def splice_history(main: DataFrame, earlier: DataFrame, overlap: int = 7, max_error: float = 0.10,
                   max_gap_days: int = 2) -> DataFrame:
    """Older prices of each symbol scaled to the main series over the first common days.

    Returns (ts, symbol, pos, close, tradable, ratio) for symbols that pass: enough
    overlap, a positive median ratio, a median relative error of at most
    ``max_error`` and no gap above ``max_gap_days``.  Scaled rows are not tradable.
    """
    a = main.filter(F.col("close").isNotNull()).select("ts", "symbol", "pos", "close")
    b = earlier.filter(F.col("close").isNotNull()).select("ts", "symbol", "pos", F.col("close").alias("_e"))
    both = a.join(b.select("symbol", "pos", "_e"), ["symbol", "pos"]).withColumn("_r", F.col("close") / F.nullif(F.col("_e"), F.lit(0.0)))
    both = cut_lineage(S.running(both, {"_k": ("count", F.lit(1), True)}).filter(F.col("_k") <= overlap))
    n = both.groupBy("symbol").agg(F.count("_r").alias("_n"))
    ratio = D.quantiles(both, ["symbol"], "_r", {"ratio": 0.5})
    error = D.quantiles(both.join(ratio, "symbol").withColumn("_x", F.abs(F.col("_r") / F.nullif(F.col("ratio"), F.lit(0.0)) - 1)),
                        ["symbol"], "_x", {"_err": 0.5})
    good = cut_lineage(n.join(ratio, "symbol").join(error, "symbol").filter(
        (F.col("_n") >= overlap) & (F.col("ratio") > 0) & (F.col("_err") <= max_error)).select("symbol", "ratio"))
    first = a.groupBy("symbol").agg(F.min("pos").alias("_first"))
    older = b.join(first, "symbol").filter(F.col("pos") < F.col("_first")).join(good, "symbol").select(
        "ts", "symbol", "pos", (F.col("_e") * F.col("ratio")).alias("close"), F.lit(False).alias("tradable"), "ratio")
    joined = older.unionByName(a.join(good, "symbol").select("ts", "symbol", "pos", "close", F.lit(True).alias("tradable"), "ratio"))
    torn = _calendar_gaps(joined, ["symbol"]).filter(F.col("gap") >= (max_gap_days + 1) * T.DAY).select("symbol").distinct()
    return joined.join(torn, "symbol", "left_anti")


def price_segments(spliced: DataFrame, source: str) -> DataFrame:
    """One record per symbol of the scaled stretch."""
    return spliced.filter(~F.col("tradable")).groupBy("symbol").agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.first("ratio").alias("ratio"),
        F.count(F.lit(1)).alias("rows")).withColumn("source", F.lit(source)).withColumn("tradable", F.lit(False))


def normalize_symbol(x: Column, quote: str = "USDT") -> Column:
    """Upper case without separators, with the quote suffix."""
    bare = F.regexp_replace(F.upper(F.trim(x)), "[/-]", "")
    return F.when(bare.endswith(quote), bare).otherwise(F.concat(bare, F.lit(quote)))


def eligible_symbols(df: DataFrame, min_obs: int, quote: str = "USDT", excluded: Sequence[str] = (),
                     stable: Sequence[str] = STABLE_BASES, value: str = "close") -> DataFrame:
    """Rows of symbols with the quote suffix, no excluded or stable base and enough observations."""
    base = F.upper(F.substring(F.col("symbol"), F.lit(1), F.length("symbol") - len(quote)))
    named = df.filter(F.col("symbol").endswith(quote) & ~F.col("symbol").isin(list(excluded) or [""]) & ~base.isin(list(stable)))
    enough = named.groupBy("symbol").agg(F.count(value).alias("_n")).filter(F.col("_n") >= min_obs)
    return named.join(enough.select("symbol"), "symbol", "left_semi")
