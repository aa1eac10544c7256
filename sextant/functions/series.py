"""Windows along one series, split so that no series has to fit one task.

A series (``keys``) may hold a large share of all rows, so none of the helpers
partitions a window by ``keys`` alone.  Rows are cut into blocks of ``BLOCK``
bars and

* frames of bounded reach copy the few bars around a block border into the
  neighbouring block (:func:`over_bars`);
* unbounded running values are taken inside the block, and one summary row per
  block carries them on (:func:`running`, :func:`linear_recurrence`), in the
  second case as affine maps that are composed.

Frames are RANGE frames over the bar number ``pos``: an absent bar takes its
place in the frame, as a missing cell does in a wide panel, without a dense
grid ever being built.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = 4_096
# rows in a block that is cut by row count
BLOCK_ROWS = 65_536
# exp() of the summed log decay of one block stays far inside double range
DECAY_RANGE = 500.0
# block summaries that are composed in one row
GROUP = 1_024


def _block(block: int) -> Column:
    return F.floor(F.col("pos") / F.lit(block)).cast("bigint")


def _place(order: Sequence[str]) -> Column:
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def over_bars(
    df: DataFrame,
    build: Callable[[WindowSpec], Mapping[str, Column]],
    *,
    before: int = 0,
    after: int = 0,
    keys: Sequence[str] = ("symbol",),
    block: int = BLOCK,
) -> DataFrame:
    """Add window columns whose frames reach ``before``/``after`` bars.

    ``build`` receives the window (partitioned and ordered, without a frame) and
    returns the columns to add; they may use any RANGE frame within reach.
    """
    first = F.floor((F.col("pos") - F.lit(after)) / F.lit(block)).cast("bigint")
    last = F.floor((F.col("pos") + F.lit(before)) / F.lit(block)).cast("bigint")
    spread = df.withColumn("_blk", F.explode(F.sequence(first, last)))
    w = Window.partitionBy(*keys, "_blk").orderBy("pos")
    added = {name: col for name, col in build(w).items()}
    kept = [c for c in df.columns if c not in added]
    return (
        spread.select(*kept, "_blk", *[c.alias(n) for n, c in added.items()])
        .filter(F.col("_blk") == _block(block))
        .drop("_blk")
    )


def at(x, k: int, w: WindowSpec) -> Column:
    """Value of ``x`` exactly ``k`` bars away (negative = earlier), null if absent."""
    return F.first(x).over(w.rangeBetween(k, k))


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    """The last ``n`` bars including the current one."""
    return w.rangeBetween(-(n - 1), 0)


def full(x, n: int, w: WindowSpec, value: Column) -> Column:
    """``value`` only where the last ``n`` bars all hold ``x``."""
    return F.when(F.count(x).over(trailing(w, n)) >= n, value)


def rolling_std(x, n: int, w: WindowSpec, min_bars: int | None = None) -> Column:
    frame = trailing(w, n)
    return F.when(F.count(x).over(frame) >= (min_bars or n), F.stddev_samp(x).over(frame))


def rolling_mean(x, n: int, w: WindowSpec, min_bars: int | None = None) -> Column:
    frame = trailing(w, n)
    return F.when(F.count(x).over(frame) >= (min_bars or n), F.avg(x).over(frame))


def trailing_parts(df: DataFrame, parts: Mapping[str, tuple[Callable[[Column], Column], str]], length: str,
                   keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Aggregates over the last ``length`` bars (a column, constant in a series), in two parts to be merged.

    A series is cut into chunks of ``length`` bars, so a frame is the end of one chunk and the start of
    the next; both are running aggregates, and the work per row does not grow with ``length``.  ``parts``
    maps a name to an aggregate and its column; ``{name}_a`` is the earlier part, ``{name}_b`` the later.
    """
    chunk = F.floor(F.col("pos") / F.col(length)).cast("bigint")
    twice = df.withColumn("_old", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "_chunk", chunk + F.col("_old")).withColumn("_at", F.col("pos") + F.col("_old") * F.col(length))
    w = Window.partitionBy(*keys, "_chunk")
    start = w.orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    # rows of the chunk before that are younger than ``length`` bars; one of exactly that age comes after the row
    end = w.orderBy(F.desc("_at"), "_old").rowsBetween(Window.unboundedPreceding, 0)
    later = {f"{n}_b": agg(F.when(F.col("_old") == 0, F.col(c))).over(start) for n, (agg, c) in parts.items()}
    earlier = {f"{n}_a": agg(F.when(F.col("_old") == 1, F.col(c))).over(end) for n, (agg, c) in parts.items()}
    both = twice.select("*", *[c.alias(n) for n, c in {**later, **earlier}.items()])
    return both.filter("_old = 0").drop("_old", "_chunk", "_at")


def simple_returns(df: DataFrame, value: str = "close", k: int = 1, out: str = "ret",
                   keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """``k``-bar return; null where the earlier bar is absent."""
    return over_bars(
        df, lambda w: {out: F.col(value) / F.nullif(at(value, -k, w), F.lit(0.0)) - 1},
        before=k, keys=keys,
    )


_COMBINE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "product": (F.product, lambda a, b: F.coalesce(a * b, a, b)),
    "count": (F.count, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
}


def row_blocks(df: DataFrame, out: str, *, cell: int, keys: Sequence[str] = ("symbol",), rows: int = BLOCK_ROWS) -> DataFrame:
    """Number blocks of each series that hold about ``rows`` rows, however densely they lie.

    Rows are counted per cell of ``cell`` bars; a block is a run of cells whose rows begin within
    the same ``rows`` of the running count, so it exceeds ``rows`` by less than its last cell
    holds.  Only the counts are ordered per key, not the rows.
    """
    celled = df.withColumn("_cell", F.floor(F.col("pos") / F.lit(cell)).cast("bigint"))
    counts = celled.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.select(*keys, "_cell", F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / F.lit(rows)).alias(out))
    return celled.join(blocks, [*keys, "_cell"]).drop("_cell")


def running(
    df: DataFrame,
    specs: Mapping[str, tuple[str, Column | str, bool]],
    *,
    keys: Sequence[str] = ("symbol",),
    block: int | str = BLOCK,
    order: Sequence[str] = ("pos",),
) -> DataFrame:
    """Add running values from the start of each series.

    ``specs`` maps a new column to ``(kind, column, include_current)`` with kind
    ``sum``, ``max``, ``min``, ``product``, ``count`` or ``last`` (the last
    non-null value).  ``block`` is a number of bars, or a column of block numbers
    that never decrease along ``pos``.  ``order`` begins with ``pos``; more columns order rows of one bar.
    """
    base = df.withColumn("_blk", F.col(block) if isinstance(block, str) else _block(block))
    exprs = {}
    for name, (kind, col, inclusive) in specs.items():
        exprs[name] = (kind, F.col(col) if isinstance(col, str) else col, inclusive)
    for i, (name, (kind, col, _)) in enumerate(exprs.items()):
        base = base.withColumn(f"_x{i}", col)
    w = Window.partitionBy(*keys, "_blk").orderBy(*order)
    by_block = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    local, summary, carry, final = [], [], [], []
    for i, (name, (kind, _, inclusive)) in enumerate(exprs.items()):
        frame = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        x = F.col(f"_x{i}")
        if kind == "last":
            local.append(F.last(x, ignorenulls=True).over(frame).alias(f"_l{i}"))
            summary.append(F.max_by(x, F.when(x.isNotNull(), _place(order))).alias(f"_s{i}"))
            carry.append(F.last(f"_s{i}", ignorenulls=True).over(by_block).alias(f"_c{i}"))
            final.append(F.coalesce(f"_l{i}", f"_c{i}").alias(name))
        else:
            agg, combine = _COMBINE[kind]
            over_blocks = F.sum if kind == "count" else agg
            local.append(agg(x).over(frame).alias(f"_l{i}"))
            summary.append(agg(x).alias(f"_s{i}"))
            carry.append(over_blocks(F.col(f"_s{i}")).over(by_block).alias(f"_c{i}"))
            final.append(combine(F.col(f"_l{i}"), F.col(f"_c{i}")).alias(name))
    carried = base.groupBy(*keys, "_blk").agg(*summary).select(*keys, "_blk", *carry)
    kept = [c for c in df.columns if c not in specs]
    return (
        base.select("*", *local).join(carried, [*keys, "_blk"]).select(*kept, *final)
    )


def _compose(first: Column, then: Column) -> Column:
    """The affine map ``y -> a * y + b`` that applies ``first`` and ``then``."""
    return F.struct((then["a"] * first["a"]).alias("a"), (then["a"] * first["b"] + then["b"]).alias("b"))


def _before_each(maps: Column, name: str) -> Column:
    """(maps before each element, the map of all) of an array of structs with a map ``name``."""
    same = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    start = F.struct(F.expr("cast(array() as array<struct<a: double, b: double>>)").alias("each"), same.alias("all"))
    return F.aggregate(maps, start, lambda acc, e: F.struct(
        F.concat(acc["each"], F.array(acc["all"])).alias("each"), _compose(acc["all"], e[name]).alias("all")))


def affine_carry(ends: DataFrame, maps: Sequence[str], keys: Sequence[str] = ("symbol",), group: int = GROUP) -> DataFrame:
    """(keys, _blk) plus, per map, the value with which each block begins; the first begins at 0.

    ``ends`` has one row per key and block and struct columns ``maps`` with fields (a, b): the block
    turns ``y`` into ``a * y + b``, a null map leaves it.  Composition is associative, so ``group``
    neighbouring blocks become one map each, those are scanned in order, and every block adds what
    stands before it in its group.  Nothing is cut off: a block sees all blocks before it.
    """
    neutral = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    filled = ends.select(*keys, "_blk", *[F.coalesce(F.col(m), neutral).alias(m) for m in maps])
    grouped = filled.groupBy(*keys, F.floor(F.col("_blk") / F.lit(group)).alias("_grp")).agg(
        F.sort_array(F.collect_list(F.struct("_blk", *maps))).alias("_maps"))
    scanned = grouped.select(*keys, "_grp", F.col("_maps._blk").alias("_blks"),
                             *[_before_each(F.col("_maps"), m).alias(m) for m in maps])
    start = F.struct(F.expr("cast(array() as array<double>)").alias("each"), F.lit(0.0).alias("y"))

    def begins_of(m: str) -> Column:
        return F.aggregate("_all", start, lambda acc, e: F.struct(
            F.concat(acc["each"], F.array(acc["y"])).alias("each"), (e[m]["a"] * acc["y"] + e[m]["b"]).alias("y")))["each"]

    whole = scanned.groupBy(*keys).agg(F.sort_array(F.collect_list(
        F.struct("_grp", *[F.col(f"{m}.all").alias(m) for m in maps]))).alias("_all"))
    begins = whole.select(*keys, F.col("_all._grp").alias("_grps"), *[begins_of(m).alias(m) for m in maps])
    begins = begins.select(*keys, F.explode(F.arrays_zip("_grps", *maps)).alias("_g")).select(
        *keys, F.col("_g._grps").alias("_grp"), *[F.col(f"_g.{m}").alias(f"_y_{m}") for m in maps])
    each = scanned.select(*keys, "_grp", F.explode(F.arrays_zip("_blks", *[F.col(f"{m}.each").alias(m) for m in maps])).alias("_e"))
    return each.join(begins, [*keys, "_grp"]).select(
        *keys, F.col("_e._blks").alias("_blk"),
        *[(F.col(f"_e.{m}.a") * F.col(f"_y_{m}") + F.col(f"_e.{m}.b")).alias(m) for m in maps])


def linear_recurrence(
    df: DataFrame,
    specs: Mapping[str, tuple[str, str, str]],
    *,
    keys: Sequence[str] = ("symbol",),
    block: int,
    group: int = GROUP,
    order: Sequence[str] = ("pos",),
) -> DataFrame:
    """Add ``y = a * y + b`` per series, taken at the rows where ``x`` is present (``y`` starts at 0).

    ``specs`` maps ``y`` to its columns ``(a, b, x)``, ``0 < a <= 1``; a row without ``x``
    repeats ``y``.  Inside a block the recurrence is a running sum of ``b`` over the running
    product of ``a``, the factor of the first row present in the block left aside; a whole
    block is one affine map, and :func:`affine_carry` composes those exactly.
    """
    base = df.withColumn("_blk", _block(block))
    w = Window.partitionBy(*keys, "_blk").orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    pairs = list(enumerate(specs.values()))
    sources = sorted({x for _, _, x in specs.values()})
    at = {x: f"_k{j}" for j, x in enumerate(sources)}
    base = base.select("*", *[F.count(x).over(run).alias(k) for x, k in at.items()])
    # log decay since the first row present in the block
    base = base.select("*", *[
        F.when(F.col(x).isNull() | (F.col(at[x]) <= 1), F.lit(0.0)).otherwise(F.log(F.col(a))).alias(f"_g{i}")
        for i, (a, _, x) in pairs])
    base = base.select("*", *[F.sum(f"_g{i}").over(run).alias(f"_s{i}") for i, _ in pairs])
    base = base.select("*", *[
        (F.exp(f"_s{i}") * F.coalesce(F.sum(F.when(F.col(x).isNotNull(), F.col(b) * F.exp(-F.col(f"_s{i}")))).over(run),
                                      F.lit(0.0))).alias(f"_v{i}")
        for i, (_, b, x) in pairs])

    def first_factor(a: str, x: str) -> Column:
        return F.min_by(F.col(a), F.when(F.col(x).isNotNull(), _place(order)))

    ends = base.groupBy(*keys, "_blk").agg(*[
        F.when(F.count(x) > 0, F.struct((first_factor(a, x) * F.exp(F.max_by(f"_s{i}", _place(order)))).alias("a"),
                                        F.max_by(f"_v{i}", _place(order)).alias("b"))).alias(f"_c{i}")
        for i, (a, _, x) in pairs])
    carry = affine_carry(ends, [f"_c{i}" for i, _ in pairs], keys, group)
    kept = [c for c in df.columns if c not in specs]
    # the factor left aside stands at the first row present, so every row from there on carries it
    base = base.select("*", *[F.first(F.when(F.col(x).isNotNull(), F.col(a)), ignorenulls=True).over(run).alias(f"_f{i}")
                              for i, (a, _, x) in pairs])
    return base.join(carry, [*keys, "_blk"]).select(*kept, *[
        (F.col(f"_v{i}") + F.exp(f"_s{i}") * F.col(f"_c{i}") * F.coalesce(f"_f{i}", F.lit(1.0))).alias(n)
        for n, (i, _) in zip(specs, pairs, strict=True)])


def ewma(
    df: DataFrame,
    specs: Mapping[str, tuple[str, float]],
    *,
    adjust: bool = False,
    min_bars: Mapping[str, int] | None = None,
    keys: Sequence[str] = ("symbol",),
    block: int = BLOCK,
    group: int = GROUP,
    order: Sequence[str] = ("pos",),
    most: int = 1,
) -> DataFrame:
    """Exponentially weighted means ``{out: (value, span)}`` along each series.

    An absent or null bar ages the earlier mean by one step and repeats it where
    the row exists; values may be as far apart as the series is long.  ``adjust`` divides
    by the summed weights instead of starting from the first value.  ``min_bars[out]``
    values are needed before a mean shows.  With rows that share a bar, taken one after the other without
    ageing, ``order`` says in which order and ``most`` how many a bar holds at most.
    """
    need = dict(min_bars or {})
    prior = {}
    for value in sorted({value for value, _ in specs.values()}):
        seen = F.when(F.col(value).isNotNull(), F.col("pos"))
        prior[f"_p_{value}"] = ("last", seen, False)
        prior[f"_n_{value}"] = ("count", F.col(value), True)
    out = running(df, prior, keys=keys, block=block, order=order)
    recur: dict[str, tuple[str, str, str]] = {}
    steepest = 0.0
    for name, (value, span) in specs.items():
        alpha = 2.0 / (span + 1.0)
        decay = -math.log1p(-alpha) if alpha < 1 else 40.0
        steepest = max(steepest, decay + (most - 1) * math.log1p(alpha))
        first = F.col(f"_p_{value}").isNull()
        aged = F.exp((F.col("pos") - F.col(f"_p_{value}")) * F.lit(-decay))
        keep = aged if adjust else aged / (aged + F.lit(alpha))
        out = out.withColumn(f"_a_{name}", F.when(first, F.lit(1.0)).otherwise(keep))
        share = F.lit(1.0) if adjust else F.when(first, F.lit(1.0)).otherwise(1 - F.col(f"_a_{name}"))
        out = out.withColumn(f"_b_{name}", share * F.col(value))
        recur[f"_y_{name}"] = (f"_a_{name}", f"_b_{name}", value)
        if adjust:
            out = out.withColumn(f"_w_{name}", F.lit(1.0))
            recur[f"_d_{name}"] = (f"_a_{name}", f"_w_{name}", value)
    # a factor is at least the decay to the power of its gap, so a block's product stays in range
    width = max(1, min(block, int(DECAY_RANGE / steepest)))
    out = linear_recurrence(out, recur, keys=keys, block=width, group=group, order=order)
    kept = [c for c in df.columns if c not in specs]
    final = []
    for name, (value, _) in specs.items():
        mean = F.col(f"_y_{name}") / F.nullif(F.col(f"_d_{name}"), F.lit(0.0)) if adjust else F.col(f"_y_{name}")
        final.append(F.when(F.col(f"_n_{value}") >= max(1, need.get(name, 1)), mean).alias(name))
    return out.select(*kept, *final)
