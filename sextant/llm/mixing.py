"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target of words by water-filling. Documents of a source get
``floor(target / source size)`` certain whole copies; the rest of the target is a fixed-size
unequal-probability sample drawn by Pareto ordering. A document's inclusion probability is
proportional to the power of two at or below its size, so long documents are likelier; where
that exceeds one the document is taken for certain and the others share what is left. The
probabilities times the sizes add up to the rest of the target. Documents are ranked by their
random odds divided by their inclusion odds and taken from the front until its words are reached.

The cut in the ranking is found without sorting a source: documents are counted in buckets
of the ranking variable, the bucket that holds the cut is found from bucket sums, and only
that bucket (about the root of the source's documents) is ordered. What remains is one
threshold row per source, so documents never move.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import Scratch, fresh, word_count

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_COPIES = 2.0
# sources whose thresholds are broadcast; beyond, Spark chooses the join
BROADCAST_SOURCES = 100_000


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
            most: float = MAX_COPIES) -> DataFrame:
    """(source, n_docs, source_size) plus weight and target.

    Weights repeat along the sources in code point order, null last. A target stops at
    ``most`` times its source; in order of that limit per weight, the level of the others
    is what is left over their weights, so the excess is reshared until none is above.
    One row per source is ordered in one task.
    """
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source")))
    turn = F.pmod(number - 1, F.lit(len(weights))) + 1
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn))
    rows = rows.withColumn("limit", F.lit(float(most)) * F.col("source_size"))
    everything = Window.partitionBy(F.lit(0))
    rows = rows.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
    order = everything.orderBy(F.col("limit") / F.col("weight"), F.asc_nulls_last("source"))
    earlier = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.col("budget") - earlier) / rest)
    stopped = F.col("level") * F.col("weight") > F.col("limit")
    common = F.max(F.when(~stopped, F.col("level"))).over(everything)
    return rows.withColumn("target", F.when(stopped, F.col("limit")).otherwise(common * F.col("weight"))).select(
        "source", "n_docs", "source_size", "weight", "target")


def _uniform(seed: int, *columns: Column) -> Column:
    """A number inside (0, 1) that depends on the row's content only."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 12).cast("double") + 0.5) / F.lit(float(1 << 52))


def _weight(size: Column) -> Column:
    """The power of two at or below a size, 0 without words: at most 63 classes in a source."""
    return F.when(size > 0, F.pow(F.lit(2.0), F.length(F.bin(size)) - 1)).otherwise(F.lit(0.0))


def inclusion(classes: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, rate, top, sure) of each source with words.

    ``classes`` has source, w and words, ``plan`` source and wanted. Documents above the
    weight ``top`` are certain and hold ``sure`` words; others are included with
    probability ``rate * w``. The largest ``top`` that keeps all probabilities below one is
    taken. A window orders the classes of one source.
    """
    rows = classes.filter(F.col("w") > 0).alias("c").join(
        _small(plan).alias("p"), F.col("c.source").eqNullSafe(F.col("p.source"))).select("c.source", "w", "words", "wanted")
    along = Window.partitionBy("source").orderBy(F.desc("w"))
    sure = F.coalesce(F.sum("words").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    mass = F.sum(F.col("words") * F.col("w")).over(along.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.select("source", "w", sure.alias("sure"), ((F.col("wanted") - sure) / mass).alias("rate"))
    best = F.max_by(F.struct("rate", F.col("w").alias("top"), "sure"), "w").alias("b")
    return rows.filter(F.col("rate") * F.col("w") < 1).groupBy("source").agg(best).select("source", "b.*")


def _odds(p: Column) -> Column:
    return p / (1 - p)


def _rank_variable(draw: Column, part: Column) -> Column:
    """Random odds over inclusion odds, brought into (0, 1) by x / (1 + x)."""
    x = _odds(draw) / _odds(part)
    return F.when((part > 0) & (part < 1), x / (1 + x))


def _part(size: Column, rate: Column, top: Column) -> Column:
    """Inclusion probability of a document: 1 for a certain one, 0 without words."""
    return F.when(_weight(size) > top, 1.0).otherwise(rate * _weight(size))


def thresholds(docs: DataFrame, scratch: Scratch, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
               most: float = MAX_COPIES) -> DataFrame:
    """One row per source: target, whole copies, inclusion rate, and the last rank taken.

    ``docs`` has source, size, draw and tie. Rows that agree in draw and tie are repeated rows;
    the cut may fall among them, so the last such group taken comes with its number of rows
    and how many of them are taken.
    """
    classes = scratch.keep(docs.groupBy("source", _weight(F.col("size")).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), "classes")
    sizes = classes.groupBy("source").agg(F.sum("n").alias("n_docs"), F.sum("words").alias("source_size"))
    plan = targets(sizes, weights, share, most)
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(copies + F.lit(1e-12))
    plan = plan.select("*", whole.cast("long").alias("whole"),
                       F.greatest(F.lit(0.0), F.col("target") - whole * F.col("source_size")).alias("wanted"),
                       F.ceil(F.sqrt("n_docs")).alias("n_buckets"))
    plan = scratch.keep(plan, "whole_copies")
    plan = plan.alias("p").join(inclusion(classes, plan).alias("i"), F.col("p.source").eqNullSafe(F.col("i.source")), "left").select(
        "p.source", "source_size", "target", "whole", "n_buckets", (F.col("wanted") - F.coalesce("sure", F.lit(0))).alias("wanted"),
        F.coalesce("rate", F.lit(0.0)).alias("rate"), F.coalesce("top", F.lit(0.0)).alias("top"))
    plan = scratch.keep(plan, "plan")
    ranked = docs.alias("d").join(_small(plan).alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select(
        "d.source", "size", "tie", "wanted", "n_buckets",
        _rank_variable(F.col("draw"), _part(F.col("size"), F.col("rate"), F.col("top"))).alias("rank")
    ).filter(F.col("rank").isNotNull())
    bucket = F.floor(F.col("rank") * F.col("n_buckets"))
    ranked = ranked.withColumn("bucket", bucket)
    sums = ranked.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("wanted").alias("wanted"))
    along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("words").over(along), F.lit(0)).alias("before")
    edge = sums.select("*", before).filter(F.col("before") <= F.col("wanted")).groupBy("source").agg(
        F.max("bucket").alias("edge"), F.max_by("before", "bucket").alias("before"))
    edge = scratch.keep(edge, "edge")
    inside = ranked.alias("d").join(
        _small(edge).alias("e"),
        F.col("d.source").eqNullSafe(F.col("e.source")) & (F.col("d.bucket") == F.col("e.edge")))
    inside = inside.select("d.source", "size", "rank", "tie", "wanted", "before")
    order = Window.partitionBy("source").orderBy("rank", "tie").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("size") / 2
    last = inside.select("source", "rank", "tie", (at <= F.col("wanted")).alias("in")).groupBy("source", "rank", "tie").agg(
        F.count_if("in").alias("taken"), F.count(F.lit(1)).alias("rows")).filter(F.col("taken") > 0)
    last = last.groupBy("source").agg(F.max(F.struct("rank", "tie", "taken", "rows")).alias("last"))
    p, e, x = plan.alias("p"), edge.alias("e"), last.alias("x")
    return p.join(e, F.col("p.source").eqNullSafe(F.col("e.source")), "left").join(
        x, F.col("p.source").eqNullSafe(F.col("x.source")), "left").select(
        "p.source", "source_size", "target", "whole", "rate", "top", "n_buckets", "edge",
        F.col("x.last.rank").alias("last_rank"), F.col("x.last.tie").alias("last_tie"),
        F.col("x.last.taken").alias("last_taken"), F.col("x.last.rows").alias("last_rows"))


def _numbered(rows: DataFrame, group: str, number: str, scratch: Scratch) -> DataFrame:
    """``rows`` with a number from 1 inside each group. The rows are written with their place in
    their task; they are numbered per task, and only counts of group and task meet."""
    place, task = fresh(rows, "place", "task")
    kept = scratch.keep(rows.withColumn(place, F.monotonically_increasing_id()), "cut_groups").withColumn(
        task, F.shiftright(place, 33))
    before = Window.partitionBy("_g").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    starts = kept.groupBy(F.col(group).alias("_g"), F.col(task).alias("_t")).agg(F.count(F.lit(1)).alias("_n")).select(
        "_g", "_t", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = kept.withColumn(number, F.row_number().over(Window.partitionBy(group, task).orderBy(place)))
    both = local.join(starts, (local[group] == starts["_g"]) & (local[task] == starts["_t"]))
    return both.select(*rows.columns, (F.col("_before") + F.col(number)).alias(number))


def _small(rows: DataFrame) -> DataFrame:
    """Marked for broadcast if it is proven to be small; ``rows`` has been written."""
    return F.broadcast(rows) if rows.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else rows


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MAX_COPIES,
        seed: int = 7) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` plus size, source size, target and copies; returns the frame and the new names.

    Size is the number of words (null text: 0). A null source is a source of its own. A
    source without words has target 0 and no copies; a text without words is taken with the
    whole copies only. Reruns agree: draws are hashes of
    doc_id, source and text. Repeated rows share one draw; where the cut falls among them, as
    many as fit are taken, and it does not matter which.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    size, draw, tie = fresh(docs, "size", "draw", "tie")
    key = (F.col("doc_id"), F.col("source"), F.col("text"))
    drawn = docs.withColumns({size: word_count(F.col("text")), draw: _uniform(seed, *key),
                              tie: F.xxhash64(F.lit(seed + 1), *key)})
    narrow = scratch.keep(drawn.select("source", F.col(size).alias("size"), F.col(draw).alias("draw"),
                                       F.col(tie).alias("tie")), "draws")
    written = scratch.keep(thresholds(narrow, scratch, weights, share, most), "cut")
    split = not written.filter(F.col("last_taken") < F.col("last_rows")).isEmpty()
    cut = _small(written).select(F.struct("*").alias("cut"))
    names = dict(zip(("size", "source_size", "target", "copies"),
                     fresh(drawn, "size", "source_size", "target", "copies"), strict=True))
    rank_name, part_name, cut_name, number = fresh(drawn, "rank", "part", "cut", "number")
    part = _part(F.col(size), F.col("cut.rate"), F.col("cut.top"))
    found = drawn.alias("d").join(cut, F.col("d.source").eqNullSafe(F.col("cut.source"))).select(
        "d.*", F.col("cut").alias(cut_name), part.alias(part_name), _rank_variable(F.col(draw), part).alias(rank_name))

    def of(field: str) -> Column:
        return F.col(f"{cut_name}.{field}")

    rank = F.col(rank_name)
    bucket = F.floor(rank * of("n_buckets"))
    at_edge = (bucket == of("edge")) & of("last_rank").isNotNull()
    here, last = F.struct(rank, F.col(tie)), F.struct(of("last_rank"), of("last_tie"))
    among = F.coalesce(at_edge & (here == last), F.lit(False))

    def shown(rows: DataFrame, taken: Column) -> DataFrame:
        return rows.select(
            *[F.col(f"`{c}`") for c in docs.columns], F.col(size).alias(names["size"]),
            of("source_size").alias(names["source_size"]), of("target").alias(names["target"]),
            (of("whole") + taken).cast("long").alias(names["copies"]))

    whole = shown(found if not split else found.filter(~among),
                  F.when(F.col(part_name) >= 1, 1).when(bucket < of("edge"), 1).when(at_edge & (here <= last), 1).otherwise(0))
    if split:  # repeated rows at the cut: as many of them as fit
        equal = _numbered(found.filter(among), tie, number, scratch)
        whole = whole.unionByName(shown(equal, F.when(F.col(number) <= of("last_taken"), 1).otherwise(0)))
    return whole, names


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of every row."""
    out, names = mix(docs.select("doc_id", "source", "text"))
    size, copies = F.col(names["size"]), F.col(names["copies"])
    return out.select("doc_id", size.alias("size"), F.col(names["source_size"]).cast("long").alias("source_size"),
                      F.col(names["target"]).alias("target"), (size * copies).alias("taken"), copies.alias("copies"))


def resample(docs: DataFrame) -> DataFrame:
    """Every row as often as the mix takes it; columns as they are."""
    out, names = mix(docs)
    copy = fresh(out, "copy")[0]
    return out.filter(F.col(names["copies"]) > 0).withColumn(
        copy, F.explode(F.sequence(F.lit(1), F.col(names["copies"])))).select(*docs.columns)
