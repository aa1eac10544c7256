"""Hard negatives against a plain version; bounds never exclude a pair; blocks that prune."""

import math
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.llm import negatives
from sextant.llm.common import Scratch

KINDS = "vec_id long, embedding array<float>, label int, id int, `Q` string"


def table():
    """Clusters, one vector in a third of the rows, ties, short and zero vectors, bad rows."""
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(240):
        if i % 3 == 0:
            v = [0.5, 0.25, -0.125, 0.5, 0.0, 1.0]
        else:
            v = [c + rng.gauss(0, 0.2) for c in centres[rng.randrange(5)]]
        rows.append((i, v, rng.choice([0, 0, 0, 1, 2, 7])))
    return [*rows, (300, [1.0, 2.0], 0), (301, [0.0] * 6, 0), (302, [], 1), (350, [0.0] * 6, 1), (400, [3000.0, -2.0, 1.0, 0.0, 0.0, 0.0], 2),
            (450, [1.0] * 6, 999), (500, [2.5] * 6, 2)], [
        (600, None, 1), (650, [1.0, None, 1.0], 1), (700, [1.0, math.nan], 0), (750, [math.inf], 0), (800, [1.0] * 6, None), (None, [1.0] * 6, 0),
        (850, [3e30] * 6, 0)]


def as_integers(rows):
    return [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, label in rows]


@pytest.mark.parametrize(("row_block", "anchor_block"), [(1024, 256), (16, 8)])
def test_equals_plain_version(spark, monkeypatch, row_block, anchor_block):
    monkeypatch.setattr(negatives, "ROW_BLOCK", row_block)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", anchor_block)
    good, bad = table()
    rows = [*good, *bad, good[10], (good[10][0], [9.0] * 6, 8)]  # a repeated row, and an id with a greater label
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], KINDS).repartition(5)
    out = negatives.mine(df, F.col("id") % 5 == 0)
    assert sorted(tuple(r) for r in out.collect()) == brute.hard_negatives(as_integers(good), lambda i: i % 5 == 0)


def test_bounds_hold_and_prune(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(-300, 300, (400, 8))
    v[:200] = v[0] + rng.integers(-20, 20, (200, 8))
    v[5] = 0
    references = negatives.choose_references(v.astype(float), 6)
    norms = np.linalg.norm(v, axis=1)
    angles = np.arccos(np.clip(v @ references.T / np.maximum(norms, 1e-300)[:, None], -1, 1)).astype(np.float32).astype(float)
    side = {"ids": np.arange(400), "norms": norms, "angles": angles}
    low, most = negatives._pair_bounds(side, side)
    exact = v @ v.T
    assert (low <= exact).all() and (exact <= most).all()

    rows = [(i, [float(x) / 256 for x in w], i % 2) for i, w in enumerate(v.tolist())]
    clean = negatives.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), "vec_id", "embedding", F.col("label"))
    scratch = Scratch(spark, "test")
    measured = scratch.keep(clean.mapInArrow(negatives._measure(references),
                            "id bigint, label bigint, q array<bigint>, norm double, angles array<float>, cell int, near float"), "measured")
    rows = scratch.keep(negatives._blocks(measured, 16, 8, True, 400), "rows")
    anchors = scratch.keep(negatives._blocks(measured.filter("id < 200"), 16, 8, True, 200, rivals=5), "anchors")
    every = rows.alias("r").join(anchors.alias("a"), F.col("a.label") == F.col("r.label")).count()
    assert 0 < negatives._meetings(anchors, rows, True).count() < 0.7 * every


def test_wide_values_and_nothing(spark):
    rows = [(i, [float((i * 37) % 11) * 4000, float(i % 5) * 9000, -3.0], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = brute.hard_negatives([(i, k, [math.floor(256 * x) for x in v]) for i, v, k in rows], lambda i: i % 4 == 0)
    assert want and sorted(tuple(r) for r in negatives.mine(df, F.col("id") % 4 == 0).collect()) == want
    assert negatives.report(df.limit(0)).count() == 0
    assert negatives.mine(df, F.col("id") < 0).count() == 0
    assert negatives.mine(df.withColumn("label", F.lit(1)), F.col("id") == 0).count() == 0
