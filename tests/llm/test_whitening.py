"""Whitening against a dense eigensolver; corner cases of the table."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sextant.llm import whitening as W


def plain(x):
    """(sums of squares, eigenvalues, vectors, centred) of integer rows, by dense algebra."""
    n = len(x)
    c = np.array([[float(v - int(s) // n) - (int(s) % n) / n for v, s in zip(row, x.sum(axis=0), strict=True)] for row in x])
    e, u = np.linalg.eigh(c.T @ c / n)
    s = [int(v) for v in x.sum(axis=0)]
    exact = [sum((n * int(v) - t) ** 2 for v, t in zip(row, s, strict=True)) for row in x]
    return exact, e[::-1], u[:, ::-1], c


def check(spark, vectors, count=8, tolerance=1e-7):
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, x int").repartition(5)
    out = W.whiten(df, count=count).toPandas()
    x = np.floor(1024 * vectors.astype(np.float32).astype(float)).astype(np.int64) + 100_000
    exact, e, u, c = plain(x)
    k = min(count, x.shape[1])
    assert len(out) == len(x) * k and set(out.component) == set(range(1, k + 1)) and (out.n == len(x)).all()
    assert dict(zip(out.id, out.deviation, strict=True)) == dict(enumerate(exact))
    for j in range(k):
        got = out[out.component == j + 1].sort_values("id")
        want = c @ u[:, j] / math.sqrt(e[j])
        assert min(np.abs(got.whitened - want).max(), np.abs(got.whitened + want).max()) < tolerance
        assert abs(got.explained.iloc[0] / (e[j] / e.sum()) - 1) < 1e-9
    assert out.identity_error.max() < 1e-9 and out.identity_error.nunique() == 1


def test_equals_dense_algebra(spark):
    rng = np.random.default_rng(4)
    check(spark, rng.standard_normal((400, 64)) * 0.125)
    check(spark, rng.standard_normal((500, 100)) * np.linspace(2, 0.01, 100), count=3)
    check(spark, rng.standard_normal((50, 3)))


@pytest.mark.parametrize("dim", [5, 40, 150])
def test_solver_locks_to_rounding(dim):
    rng = np.random.default_rng(dim)
    q = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    e = np.sort(np.concatenate([[7.0, 7.0, 5.0], rng.random(dim - 3) * 4.9]))[::-1]
    v = q * e @ q.T
    calls = []
    values, vectors = W.leading_pairs(lambda u: calls.append(u.shape[1]) or v @ u, dim, 8)
    assert np.allclose(values, e[:len(values)], rtol=0, atol=1e-12)
    assert np.linalg.norm(v @ vectors - vectors * values, axis=0).max() < 1e-11
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
    assert len(calls) < 120


def test_rows_that_take_no_part(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(x) for x in rng.standard_normal(4)]) for i in range(30)] + [(3, [1.0, 2.0, 3.0, 4.0]), (3, [1.0, 2.0, 3.0, 4.0]), (None, [0.5] * 4)]
    bad = [(90, None), (91, []), (92, [1.0, None, 1.0, 1.0]), (93, [math.nan] * 4), (94, [math.inf, 0.0, 0.0, 0.0]), (95, [1.0] * 3), (96, [1e30] * 4)]
    kinds = "vec_id long, embedding array<double>"
    one = W.report(spark.createDataFrame(good, kinds)).orderBy("vec_id", "component", "whitened").collect()
    two = W.report(spark.createDataFrame([*good, *bad], kinds).repartition(3)).orderBy("vec_id", "component", "whitened").collect()
    assert len(one) == len(two) == 33 * 4
    for a, b in zip(one, two, strict=True):
        assert a[:4] == b[:4] and abs(a["whitened"] - b["whitened"]) < 1e-9


def test_no_variance_and_nothing(spark):
    kinds = "vec_id long, embedding array<double>"
    assert W.report(spark.createDataFrame([], kinds)).count() == 0
    assert W.report(spark.createDataFrame([(1, None)], kinds)).count() == 0
    single = W.report(spark.createDataFrame([(1, [0.5, 0.25])], kinds)).collect()
    assert [tuple(r) for r in single] == [(1, k, 1, 0, None, None, None) for k in (1, 2)]
    flat = W.report(spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(9)], kinds)).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in flat) and flat[0]["identity_error"] < 1e-9
    wide = W.report(spark.createDataFrame([(i, [float(i) * 2 ** 35]) for i in range(3)], kinds)).filter(F.col("component") == 1).collect()
    assert {r["vec_id"]: r["deviation"] for r in wide} == {0: None, 1: 0, 2: None}
