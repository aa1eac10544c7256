"""Hard negatives by angular triangle filtering.

Every row stores its norm and its angles to a few reference directions. Two rows whose angles
to one direction are s and t stand at an angle between |s - t| and min(s + t, 2 pi - s - t),
which bounds their cosine and, times the norms, their score. Bounds are widened by more than
their rounding error, so a pair that they exclude can't qualify; only the others are scored,
as integers.

Rows are sorted by nearest direction and angle and cut into blocks that carry the range of
their angles and norms. Blocks of anchors meet blocks of rows whose bounds overlap what the
anchors look for: first rows of their own label (positives), then, with the windows that the
positives give, rows of other labels. A block is bounded, so no label, cell or repeated
vector makes a large task. The references are chosen from a bounded sample; every row is
compared to all of them, and the result does not depend on the choice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import Scratch

SCALE = 256
REFERENCES = 16
SAMPLE_ROWS = 512
ROW_BLOCK = 1024
ANCHOR_BLOCK = 256
BLOCKS_PER_TASK = 32
# anchor blocks that meet under one key
MEET = 64
# squared norms stay below this, so that a hundred times any score fits in 64 bits
MAX_SQUARE = float(1 << 56)
# doubles hold integers below this exactly
EXACT = float(1 << 53)
# angles are stored as 32-bit floats; this is above their rounding and that of arccos
SLACK = 4e-6
NONE = -1e300
# a negative qualifies when WINDOW[0] * positive <= WINDOW[1] * negative <= WINDOW[2] * positive
WINDOW = (50, 100, 95)

_KINDS = {"block": ("bigint", pa.int64()), "label": ("bigint", pa.int64()), "n": ("int", pa.int32()),
          "ids": ("binary", pa.binary()), "labels": ("binary", pa.binary()), "vectors": ("binary", pa.binary()),
          "norms": ("binary", pa.binary()), "angles": ("binary", pa.binary()), "counts": ("binary", pa.binary()),
          "positives": ("binary", pa.binary()), "scores": ("binary", pa.binary()),
          "lo": ("array<double>", pa.list_(pa.float64())), "hi": ("array<double>", pa.list_(pa.float64())),
          "norm_lo": ("double", pa.float64()), "norm_hi": ("double", pa.float64()),
          "wanted_lo": ("double", pa.float64()), "wanted_hi": ("double", pa.float64())}
BLOCK_DDL = ", ".join(f"{name} {kind}" for name, (kind, _) in _KINDS.items())
BLOCK = {name: kind for name, (_, kind) in _KINDS.items()}
_LOAD = ("n", "ids", "labels", "vectors", "norms", "angles", "counts", "positives", "scores")


def quantise(rows: DataFrame, row_id: str, vector: str, label: Column, scale: int = SCALE) -> DataFrame:
    """(id, label, q) of the rows that take part: components floor(scale * x) as integers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    scaled = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    square = F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x)
    kept = rows.filter(F.col(row_id).isNotNull() & F.col(vector).isNotNull() & finite).select(
        F.col(row_id).cast("long").alias("id"), label.cast("long").alias("label"), scaled.alias("q"))
    kept = kept.filter(F.col("label").isNotNull() & (square < MAX_SQUARE))
    one = kept.groupBy("id").agg(F.min(F.struct("label", F.transform("q", lambda x: x.cast("long")).alias("q"))).alias("v"))
    return one.select("id", "v.label", "v.q")


def choose_references(vectors: np.ndarray, count: int) -> np.ndarray:
    """Unit directions out of a sample, each far from those before it."""
    norms = np.linalg.norm(vectors, axis=1)
    units = vectors[norms > 0] / norms[norms > 0][:, None]
    if not len(units):
        return np.eye(1, max(vectors.shape[1], 1))
    chosen, nearest = [0], units @ units[0]
    while len(chosen) < min(count, len(units)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, units @ units[chosen[-1]])
    return units[chosen]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists as rows of ``dim`` integers; a shorter one counts as padded by zeros."""
    lists = column.cast(pa.large_list(pa.int64()))
    offsets = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(offsets) and (offsets == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(offsets), dim), dtype=np.int64)
    out[np.arange(dim) < offsets[:, None]] = flat
    return out


def _measure(references: np.ndarray):
    """Batch function: adds norm, angles, nearest direction and the angle to it."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("q"), references.shape[1]).astype(np.float64)
            norms = np.linalg.norm(v, axis=1)
            angles = np.arccos(np.clip(v @ references.T / np.maximum(norms, 1e-300)[:, None], -1, 1)).astype(np.float32)
            cell = angles.argmin(axis=1) if len(angles) else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id"), "label": batch.column("label"), "q": batch.column("q"), "norm": pa.array(norms),
                "angles": pa.FixedSizeListArray.from_arrays(pa.array(angles.ravel()), len(references)).cast(pa.list_(pa.float32())),
                "cell": pa.array(cell.astype(np.int32)), "near": pa.array(angles.min(axis=1, initial=np.float32(9)))})

    return measure


def _scores(a: np.ndarray, b: np.ndarray, norm: float) -> np.ndarray:
    """Exact inner products of integer rows; ``norm`` bounds the product of any two norms."""
    if norm < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _cuts(labels: np.ndarray, size: int, split: bool) -> np.ndarray:
    """Borders of blocks: every ``size`` rows, counted anew where the label changes if ``split``."""
    n = len(labels)
    begins = np.concatenate(([0], np.flatnonzero(labels[1:] != labels[:-1]) + 1)) if split else np.array([0])
    ends = np.append(begins[1:], n)
    return np.append(np.concatenate([np.arange(b, e, size) for b, e in zip(begins, ends, strict=True)]), n)


def _packer(size: int, dim: int, split: bool, rivals: int, n_positives: int):
    """Batch function: sorted rows become blocks of at most ``size`` rows, of one label if ``split``.

    With ``rivals`` a block of anchors notes the least score that so many positives reach inside
    the block; with positives in the input it notes the windows they open.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, labels, norms = (batch.column(c).to_numpy() for c in ("id", "label", "norm"))
            vectors = _matrix(batch.column("q"), dim)
            if norms.max() < 2 ** 31 - 1:
                vectors = vectors.astype(np.int32)
            angles = batch.column("angles").flatten().to_numpy().reshape(len(ids), -1)
            windows = "positives" in batch.schema.names
            if windows:
                counts = pa.compute.list_value_length(batch.column("positives")).to_numpy().astype(np.int32)
                positives, scores = (_matrix(batch.column(c), n_positives) for c in ("positives", "scores"))
                low, high = batch.column("low").to_numpy(), batch.column("high").to_numpy()
            cuts = _cuts(labels, size, split)
            out = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                wanted = (NONE, -NONE)
                if rivals and b - a > rivals:
                    inside = _scores(vectors[a:b], vectors[a:b], norms[a:b].max() ** 2)
                    np.fill_diagonal(inside, np.iinfo(np.int64).min)
                    wanted = float(np.partition(inside, b - a - rivals, axis=1)[:, b - a - rivals].min()), -NONE
                elif windows:
                    wanted = float(low[a:b].min()), float(high[a:b].max())
                row = [key, int(labels[a]) if split else None, b - a, ids[a:b], labels[a:b], vectors[a:b], norms[a:b], angles[a:b]]
                row += [counts[a:b], positives[a:b], scores[a:b]] if windows else [None] * 3
                row += [angles[a:b].min(axis=0).astype(float).tolist(), angles[a:b].max(axis=0).astype(float).tolist(),
                        float(norms[a:b].min()), float(norms[a:b].max()), *wanted]
                out.append([x.tobytes() if isinstance(x, np.ndarray) else x for x in row])
                key += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), BLOCK.values(), strict=True)],
                                             list(BLOCK))

    return pack


def _blocks(rows: DataFrame, size: int, dim: int, split: bool, count: int, rivals: int = 0, n_positives: int = 0) -> DataFrame:
    """Blocks of neighbouring rows; ``count`` rows are dealt to as many tasks as their number asks for."""
    keys = [*(["label"] if split else []), "cell", "near", "id"]
    tasks = max(1, -(-count // (size * BLOCKS_PER_TASK)))
    ordered = rows.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).coalesce(tasks)
    return ordered.mapInArrow(_packer(size, dim, split, rivals, n_positives), BLOCK_DDL)


def _bounds(a: str, r: str) -> tuple[Column, Column]:
    """(least, most) score of any pair of a block of anchors and a block of rows."""
    def of(side: str, name: str) -> Column:
        return F.col(f"{side}.{name}")

    pi = F.lit(math.pi)
    apart = F.greatest(F.lit(0.0), F.array_max(F.zip_with(of(a, "lo"), of(r, "hi"), lambda x, y: x - y)),
                       F.array_max(F.zip_with(of(r, "lo"), of(a, "hi"), lambda x, y: x - y)))
    sums = F.zip_with(F.zip_with(of(a, "lo"), of(r, "lo"), lambda x, y: x + y),
                      F.zip_with(of(a, "hi"), of(r, "hi"), lambda x, y: x + y), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    around = F.array_min(F.transform(sums, lambda s: F.when((s["x"] <= pi) & (s["y"] >= pi), pi).otherwise(
        F.greatest(F.least(s["x"], 2 * pi - s["x"]), F.least(s["y"], 2 * pi - s["y"])))))
    high, low = F.cos(F.greatest(apart - SLACK, F.lit(0.0))), F.cos(F.least(around + SLACK, pi))
    big, small = of(a, "norm_hi") * of(r, "norm_hi"), of(a, "norm_lo") * of(r, "norm_lo")
    spare = 1e-9 * big + 1
    return F.when(low > 0, small * low).otherwise(big * low) - spare, F.when(high > 0, big * high).otherwise(small * high) + spare


def _meetings(anchors: DataFrame, rows: DataFrame, split: bool) -> DataFrame:
    """(anchor block, row block) whose score bounds overlap what the anchors look for.

    Only the summaries meet, not the vectors: under their label, or else every block of rows
    under each key that holds some ``MEET`` blocks of anchors.
    """
    light = ["block", "label", "lo", "hi", "norm_lo", "norm_hi"]
    a, r = anchors.select(*light, "wanted_lo", "wanted_hi"), rows.select(*light)
    if split:
        a, r = a.withColumn("meet", F.col("label")), r.withColumn("meet", F.col("label"))
    else:
        keys = 1 + anchors.count() // MEET
        a = a.withColumn("meet", F.pmod(F.xxhash64("block"), F.lit(keys)))
        r = r.withColumn("meet", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(keys - 1).cast("long"))))
    low, high = _bounds("a", "r")
    met = a.alias("a").join(r.alias("r"), F.col("a.meet") == F.col("r.meet"))
    return met.filter((high >= F.col("a.wanted_lo")) & (low <= F.col("a.wanted_hi"))).select(
        F.col("a.block").alias("a_block"), F.col("r.block").alias("r_block"))


def _unpack(table: pa.Table, side: str, dim: int) -> dict[str, np.ndarray]:
    raw = {name: table.column(f"{side}_{name}")[0].as_py() for name in _LOAD}
    n = raw["n"]

    def get(name: str, kind) -> np.ndarray:
        return np.frombuffer(raw[name] or b"", dtype=kind)

    wide = len(raw["vectors"]) == 8 * n * dim
    return {"ids": get("ids", np.int64), "labels": get("labels", np.int64), "norms": get("norms", np.float64),
            "vectors": get("vectors", np.int64 if wide else np.int32).reshape(n, dim),
            "angles": get("angles", np.float32).reshape(n, -1).astype(np.float64), "counts": get("counts", np.int32),
            "positives": get("positives", np.int64).reshape(n, -1), "scores": get("scores", np.int64).reshape(n, -1)}


def _pair_bounds(a: dict, r: dict) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) score of every anchor with every row, widened beyond rounding."""
    shape = len(a["ids"]), len(r["ids"])
    apart, around = np.zeros(shape), np.full(shape, math.pi)
    for s, t in zip(a["angles"].T, r["angles"].T, strict=True):
        np.maximum(apart, np.abs(s[:, None] - t), out=apart)
        total = s[:, None] + t
        np.minimum(around, np.minimum(total, 2 * math.pi - total), out=around)
    norms = a["norms"][:, None] * r["norms"]
    spare = 1e-9 * norms + 1
    most = norms * np.cos(np.maximum(apart - SLACK, 0)) + spare
    return norms * np.cos(np.minimum(around + SLACK, math.pi)) - spare, most


def _first(eligible: np.ndarray, scores: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row) of the ``count`` highest eligible scores of each anchor, ties by row."""
    worst = np.iinfo(np.int64).min
    held = np.where(eligible, scores, worst)
    if held.shape[1] > count:
        bar = np.partition(held, held.shape[1] - count, axis=1)[:, held.shape[1] - count]
        eligible = eligible & (held >= bar[:, None])
    i, j = np.nonzero(eligible)
    order = np.lexsort((j, -held[i, j], i))
    i, j = i[order], j[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < count], j[place < count]


def _scored(table: pa.Table, dim: int, bar: str) -> tuple[dict, dict, np.ndarray, np.ndarray]:
    """Anchors, rows by id, pairs whose bounds overlap what the anchor looks for, their scores."""
    a, r = _unpack(table, "a", dim), _unpack(table, "r", dim)
    order = np.argsort(r["ids"], kind="stable")
    r = {k: v[order] if len(v) == len(order) else v for k, v in r.items()}
    low, most = _pair_bounds(a, r)
    if bar == "positives":
        open_pairs = (most >= table.column("a_wanted_lo")[0].as_py()) & (a["ids"][:, None] != r["ids"])
        open_pairs &= a["labels"][:, None] == r["labels"]
    else:
        open_pairs = (a["labels"][:, None] != r["labels"]) & _overlap(a, low, most)
    rows = np.flatnonzero(open_pairs.any(axis=0))
    r = {k: v[rows] if len(v) == len(order) else v for k, v in r.items()}
    norm = a["norms"].max(initial=0) * r["norms"].max(initial=0)
    return a, r, open_pairs[:, rows], _scores(a["vectors"], r["vectors"], norm)


def _overlap(a: dict, low: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Pairs whose bounds overlap the window of at least one positive of the anchor."""
    out = np.zeros(low.shape, dtype=bool)
    for k in range(a["scores"].shape[1]):
        p, there = a["scores"][:, k].astype(np.float64), a["counts"] > k
        from_, to = p * WINDOW[0] / WINDOW[1], p * WINDOW[2] / WINDOW[1]
        out |= (there & (from_ <= to))[:, None] & (most >= from_[:, None] - 1) & (low <= to[:, None] + 1)
    return out


def _positives(dim: int, count: int):
    def best(table: pa.Table) -> pa.Table:
        a, r, open_pairs, scores = _scored(table, dim, "positives")
        i, j = _first(open_pairs, scores, count)
        return pa.table({"anchor": a["ids"][i], "positive": r["ids"][j], "score": scores[i, j]})

    return best


def _negatives(dim: int, count: int):
    low, per, high = WINDOW

    def best(table: pa.Table) -> pa.Table:
        a, r, open_pairs, scores = _scored(table, dim, "windows")
        parts = []
        for k in range(a["scores"].shape[1]):
            p = a["scores"][:, k][:, None]
            inside = open_pairs & (a["counts"] > k)[:, None] & (low * p <= per * scores) & (per * scores <= high * p)
            i, j = _first(inside, scores, count)
            parts.append((a["ids"][i], a["positives"][i, k], r["ids"][j], a["scores"][i, k], scores[i, j]))
        names = ("anchor", "positive", "negative", "positive_score", "score")
        return pa.table({n: np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c, n in enumerate(names)})

    return best


def _tiles(meetings: DataFrame, anchors: DataFrame, rows: DataFrame, work, ddl: str) -> DataFrame:
    """``work`` on every meeting, one pair of blocks in memory at a time."""
    def load(blocks: DataFrame, side: str, *more: str) -> DataFrame:
        return blocks.select(F.col("block").alias(f"{side}_block"), *[F.col(c).alias(f"{side}_{c}") for c in (*_LOAD, *more)])

    both = meetings.join(load(anchors, "a", "wanted_lo"), "a_block").join(load(rows, "r"), "r_block")
    return both.groupBy("r_block", "a_block").applyInArrow(work, ddl)


def mine(rows: DataFrame, is_anchor: Column, row_id: str = "vec_id", vector: str = "embedding", label: Column | None = None,
         n_positives: int = 5, n_negatives: int = 3, references: int = REFERENCES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows for which ``is_anchor``, a condition on ``id``, holds. Scores are inner
    products of the components floor(256 x), higher first, ties by smaller id. An anchor's
    positives are its first ``n_positives`` other rows of its label; for each, the first
    ``n_negatives`` rows of other labels whose score lies in ``WINDOW`` of the positive's follow.

    Rows with a null id, label, vector or component, or a component that is not finite, take
    no part, nor do rows whose squared norm is 2 ** 56 or more, whose scores would not fit. Of rows
    that share an id the least by label and vector counts. A shorter vector counts as padded by
    zeros; an empty or zero vector scores 0. No anchors, no positives or no negative in the
    window: no row. Other columns do not matter.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "negatives")
    clean = scratch.keep(quantise(rows, row_id, vector, F.col("label") if label is None else label), "clean")
    about = clean.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_anchor, 1)).alias("anchors"), F.max(F.size("q")).alias("dim")).first()
    dim = max(about["dim"] or 0, 1)
    sample = clean.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("q").toArrow()
    directions = choose_references(_matrix(sample.column("q").combine_chunks(), dim).astype(np.float64), references)
    measured = scratch.keep(clean.mapInArrow(_measure(directions),
                            "id bigint, label bigint, q array<bigint>, norm double, angles array<float>, cell int, near float"), "measured")
    anchors = measured.filter(is_anchor)

    by_label = scratch.keep(_blocks(measured, ROW_BLOCK, dim, True, about["n"]), "rows_by_label")
    askers = scratch.keep(_blocks(anchors, ANCHOR_BLOCK, dim, True, about["anchors"], rivals=n_positives), "anchors_by_label")
    found = _tiles(_meetings(askers, by_label, True), askers, by_label, _positives(dim, n_positives),
                   "anchor bigint, positive bigint, score bigint")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "positive")
    found = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n_positives)
    of_anchor = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "positive", "score"))).alias("p"))
    low, per, high = WINDOW
    of_anchor = scratch.keep(of_anchor.select(
        F.col("anchor").alias("id"), F.col("p.positive").alias("positives"), F.col("p.score").alias("scores"),
        (F.array_min("p.score") * F.lit(low / per) - 1).alias("low"), (F.array_max("p.score") * F.lit(high / per) + 1).alias("high")), "positives")

    mixed = scratch.keep(_blocks(measured, ROW_BLOCK, dim, False, about["n"]), "rows")
    askers = scratch.keep(_blocks(anchors.join(of_anchor, "id"), ANCHOR_BLOCK, dim, False, about["anchors"], n_positives=n_positives), "anchors")
    pairs = _tiles(_meetings(askers, mixed, False), askers, mixed, _negatives(dim, n_negatives),
                   "anchor bigint, positive bigint, negative bigint, positive_score bigint, score bigint")
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "negative")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n_negatives)
    return ranked.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank",
                         F.col("negative").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def report(rows: DataFrame) -> DataFrame:
    """Every fiftieth row against all; every seventh counts under the next label of ten."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows, F.col("id") % 50 == 0, label=moved)
