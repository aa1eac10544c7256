"""Statistics of many overlapping histories from one pass over the rows.

A refit at bar ``refit`` looks at the bars from ``start`` to before it, and refits overlap.  The
starts and ends of all histories cut the calendar into segments; every history is a union of
whole segments.  Rows are aggregated per segment once, and a refit merges the aggregates of its
segments.  A row is never repeated per refit.

Forecasts are scaled by a factor of the refit and capped, which does not merge.  But
``cap(s * v)`` is ``s * v`` up to a threshold of ``|v|`` and ``+-cap`` beyond, so rows are also
told apart by the band between two thresholds they lie in, and moments are kept of both forms.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions import spread as D

# a spread this far below the sum of squares is the rounding of no spread
NOISE = 1e-13


class Histories:
    """Segments of the histories of a refit table (refit, start), which is small: one row per refit date.

    ``embargoes`` are numbers of bars by which some histories end before their refit.  The table
    comes to the driver once; segments then are an expression of the bar number, without a join.
    """

    def __init__(self, refits: DataFrame, embargoes: Sequence[int] = ()):
        self.spark = refits.sparkSession
        self.refits = sorted((r["refit"], r["start"]) for r in refits.select("refit", "start").collect())
        ends = {0, *embargoes}
        self.marks = sorted({m for refit, start in self.refits for m in (start, *[refit - e for e in ends])})

    def seg(self, pos: str = "pos") -> Column:
        """First bar of the segment of a bar, null outside all histories."""
        if not self.marks:
            return F.lit(None).cast("bigint")
        before = F.filter(F.array(*[F.lit(m).cast("bigint") for m in self.marks]), lambda m: m <= F.col(pos))
        return F.when((F.col(pos) >= self.marks[0]) & (F.col(pos) < self.marks[-1]), F.array_max(before))

    def of(self, rows: DataFrame) -> DataFrame:
        """Rows of any history with their ``seg``."""
        return rows.withColumn("seg", self.seg()).filter(F.col("seg").isNotNull())

    def cover(self, embargo: int = 0) -> DataFrame:
        """(refit, seg, known) of the segments of every history; ``known`` if it ends ``embargo`` bars earlier too."""
        rows = [(refit, m, m < refit - embargo) for refit, start in self.refits for m in self.marks if start <= m < refit]
        return self.spark.createDataFrame(rows, "refit bigint, seg bigint, known boolean")


def medians(rows: DataFrame, histories: Histories, value: Column, out: str) -> DataFrame:
    """Exact median of ``value`` per refit and rule: (refit, rule, out); none without a value.

    Bucket counts per segment locate it; only values of the buckets that some median falls
    into are looked at again, as counted distinct values.
    """
    x = histories.of(rows.select("rule", "pos", value.cast("double").alias("_v")).filter(F.col("_v").isNotNull()))
    x = x.select("rule", "seg", "_v", D.value_bucket(F.col("_v")).alias("_b"))
    of = histories.cover().select("refit", "seg")
    counts = x.groupBy("rule", "_b", "seg").agg(F.count(F.lit(1)).alias("_n")).join(of, "seg").groupBy(
        "refit", "rule", "_b").agg(F.sum("_n").alias("_n"))
    spots = D.locate(counts, ["refit", "rule"], {out: 0.5})
    near = x.join(spots.select("rule", "_b"), ["rule", "_b"], "left_semi")
    counted = near.groupBy("rule", "_b", "_v", "seg").agg(F.count(F.lit(1)).alias("_n")).join(of, "seg").groupBy(
        "refit", "rule", "_b", "_v").agg(F.sum("_n").alias("_n"))
    return D.settle(counted, spots, ["refit", "rule"], [out])


def thresholds(scalars: DataFrame, cap: float) -> tuple[DataFrame, DataFrame]:
    """(rule, limits) with the ascending thresholds of |value|, and (refit, rule, scalar, place) among them."""
    size = F.abs("scalar")
    at = scalars.withColumn("_t", F.when(size > 0, F.lit(float(cap)) / size).otherwise(F.lit(float("inf"))))
    limits = at.groupBy("rule").agg(F.array_sort(F.collect_set("_t")).alias("limits"))
    places = at.join(limits, "rule").select("refit", "rule", "scalar", (F.array_position("limits", F.col("_t")) - 1).alias("place"))
    return limits, places


def _band(value: Column, limits: Column) -> Column:
    """Number of thresholds below |value|: it is capped for those, and only those, whose place is smaller."""
    return F.coalesce(F.size(F.filter(limits, lambda t: t < F.abs(value))), F.lit(0))


def scores(rows: DataFrame, histories: Histories, scalars: DataFrame, cap: float, embargo: int) -> DataFrame:
    """Median over symbols of max(mean / deviation of capped forecast / 10 times ``ret``, 0): (refit, rule, score).

    ``rows``: (symbol, rule, pos, value, ret).  Outcomes within ``embargo`` bars of the refit are
    not known yet; a symbol with rows but without spread scores 0.
    """
    limits, places = thresholds(scalars, cap)
    x = histories.of(rows).join(limits, "rule")
    free, stuck = F.col("value") * F.col("ret") / 10.0, F.signum("value") * F.col("ret") * (cap / 10.0)
    x = x.select("symbol", "rule", "seg", _band(F.col("value"), F.col("limits")).alias("band"), free.alias("_f"), stuck.alias("_g"))
    moments = x.groupBy("symbol", "rule", "seg", "band").agg(
        F.count("_f").alias("n"), F.avg("_f").alias("mf"), (F.var_pop("_f") * F.count("_f")).alias("vf"),
        F.avg("_g").alias("mg"), (F.var_pop("_g") * F.count("_g")).alias("vg"))
    y = moments.join(histories.cover(embargo), "seg").join(places, ["refit", "rule"])
    below, s = F.col("band") <= F.col("place"), F.col("scalar")
    mean = F.when(below, s * F.col("mf")).otherwise(F.signum(s) * F.col("mg"))
    inner = F.when(below, s * s * F.col("vf")).otherwise(F.col("vg"))
    known = F.col("known") & (F.col("n") > 0)
    y = y.select("refit", "rule", "symbol", F.when(known, F.col("n")).alias("n"), F.when(known, mean).alias("m"), F.when(known, inner).alias("v"))
    n, total, square = F.sum("n"), F.sum(F.col("n") * F.col("m")), F.sum(F.col("n") * F.col("m") * F.col("m"))
    each = y.groupBy("refit", "rule", "symbol").agg(n.alias("n"), total.alias("t"), square.alias("q"), F.sum("v").alias("v"))
    between = F.col("q") - F.col("t") * F.col("t") / F.col("n")
    spread = F.col("v") + F.when(between > NOISE * F.col("q"), between).otherwise(F.lit(0.0))
    deviation = F.sqrt(F.when(F.col("n") > 1, spread / (F.col("n") - 1)))
    each = each.select("refit", "rule", F.when(deviation > 0, F.greatest(F.col("t") / F.col("n") / deviation, F.lit(0.0))).otherwise(
        F.lit(0.0)).alias("score"))
    return D.quantiles(each, ["refit", "rule"], "score", {"score": 0.5})


def pearson(n: Column, a: Column, b: Column, aa: Column, bb: Column, ab: Column) -> Column:
    """Correlation from sums, null without spread."""
    va, vb = aa - a * a / n, bb - b * b / n
    return F.when((n > 0) & (va > NOISE * aa) & (vb > NOISE * bb), (ab - a * b / n) / F.sqrt(va * vb))


def pair_corr(pairs: DataFrame, histories: Histories) -> DataFrame:
    """Correlation of ``a`` and ``b`` over complete rows per refit: (refit, corr)."""
    x = histories.of(pairs.filter(F.col("a").isNotNull() & F.col("b").isNotNull()))
    per = x.groupBy("seg").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"),
                               F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"),
                               F.sum(F.col("a") * F.col("b")).alias("ab"))
    return per.join(histories.cover(), "seg").groupBy("refit").agg(
        pearson(*[F.sum(c) for c in ("n", "a", "b", "aa", "bb", "ab")]).alias("corr"))


def rule_corrs(wide: DataFrame, histories: Histories, scalars: DataFrame, rules: Sequence[str], cap: float) -> DataFrame:
    """Pooled correlations of the capped scaled rules per refit with rows: (refit, corrs), one per pair of ``rules``.

    ``wide`` has a column per rule.  Rows are aggregated per segment and combination of bands.
    """
    limits, places = thresholds(scalars, cap)
    flat = limits.groupBy().pivot("rule", list(rules)).agg(F.first("limits")).select(
        *[F.col(f"`{r}`").alias(f"_l{i}") for i, r in enumerate(rules)], F.lit(1).alias("_one"))
    x = histories.of(wide).withColumn("_one", F.lit(1)).join(flat, "_one")
    x = x.select("seg", *[F.col(f"`{r}`").alias(f"v{i}") for i, r in enumerate(rules)],
                 *[_band(F.col(f"`{r}`"), F.col(f"_l{i}")).alias(f"b{i}") for i, r in enumerate(rules)])
    sums = [F.count(F.lit(1)).alias("rows")]
    pairs = list(combinations(range(len(rules)), 2))
    for i, j in pairs:
        both = F.col(f"v{i}").isNotNull() & F.col(f"v{j}").isNotNull()
        a, b = F.when(both, F.col(f"v{i}")), F.when(both, F.col(f"v{j}"))
        u, w = F.signum(a) * cap, F.signum(b) * cap
        terms = {"n": F.when(both, F.lit(1.0)), "a": a, "b": b, "aa": a * a, "bb": b * b, "ab": a * b, "u": u, "w": w, "uw": u * w,
                 "aw": a * w, "ub": u * b}
        sums += [F.coalesce(F.sum(t), F.lit(0.0)).alias(f"{k}_{i}_{j}") for k, t in terms.items()]
    bands = [f"b{i}" for i in range(len(rules))]
    moments = x.groupBy("seg", *bands).agg(*sums)
    scale = places.groupBy("refit").pivot("rule", list(rules)).agg(F.first("scalar").alias("s"), F.first("place").alias("p"))
    y = moments.join(histories.cover(), "seg").join(scale, "refit")
    merged = []
    for i, j in pairs:
        def term(k: str, i: int = i, j: int = j) -> Column:
            return F.col(f"{k}_{i}_{j}")

        s, t = F.col(f"`{rules[i]}_s`"), F.col(f"`{rules[j]}_s`")
        left, right = F.col(f"b{i}") <= F.col(f"`{rules[i]}_p`"), F.col(f"b{j}") <= F.col(f"`{rules[j]}_p`")
        gs, gt = F.signum(s), F.signum(t)
        merged += [F.sum(c).alias(f"{k}_{i}_{j}") for k, c in {
            "n": term("n"), "a": F.when(left, s * term("a")).otherwise(gs * term("u")), "b": F.when(right, t * term("b")).otherwise(gt * term("w")),
            "aa": F.when(left, s * s * term("aa")).otherwise(term("n") * cap * cap),
            "bb": F.when(right, t * t * term("bb")).otherwise(term("n") * cap * cap),
            "ab": F.when(left & right, s * t * term("ab")).when(left, s * gt * term("aw")).when(right, gs * t * term("ub")).otherwise(
                gs * gt * term("uw"))}.items()]
    total = y.groupBy("refit").agg(F.sum("rows").alias("rows"), *merged).filter(F.col("rows") > 0)
    return total.select("refit", F.array(*[pearson(*[F.col(f"{k}_{i}_{j}") for k in ("n", "a", "b", "aa", "bb", "ab")])
                                           for i, j in pairs]).alias("corrs"))


def means(rows: DataFrame, histories: Histories, embargo: int, value: str, by: Sequence[str], out: str) -> DataFrame:
    """Mean of ``value`` up to ``embargo`` bars before each refit, per refit and ``by``; absent without a row."""
    per = histories.of(rows).groupBy("seg", *by).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    return per.join(histories.cover(embargo).filter("known"), "seg").groupBy("refit", *by).agg((F.sum("_s") / F.nullif(F.sum("_n"), F.lit(0))).alias(out))
