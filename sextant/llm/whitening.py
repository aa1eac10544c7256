"""Whitening of embeddings by a matrix-free Jacobi-Davidson eigensolver.

The covariance is never built. What the solver asks for is its product with a few vectors at
once, and such a product is one pass over the rows: every task centres its rows, multiplies
them with the vectors and back, and Spark adds up the small results. The driver holds
matrices of (dimensions x basis) only.

Each outer step takes Ritz pairs of the current subspace, solves the correction equation of
every pair that has not converged by a few MINRES steps, all pairs in step so that they share
the passes, and widens the subspace. Pairs whose residual is down to rounding are locked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import Scratch

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
# entries beyond can't be held exactly
MAX_ENTRY = float(1 << 50)
# residual over the largest eigenvalue at which a pair is locked
TOLERANCE = 2.0 ** -44
INNER_STEPS = 4
OUTER_STEPS = 300
# basis vectors per wanted component before a restart
BASIS = 8
# eigenvalues below this share of the largest are zero
ZERO = 1e-12


def quantise(rows: DataFrame, row_id: str, vector: str, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(id, x) of the rows that take part, x = floor(scale * entry) + shift as integers."""
    fits = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * float(scale) < MAX_ENTRY))
    x = F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long") + F.lit(shift).cast("long"))
    return rows.filter(F.col(vector).isNotNull() & fits).select(F.col(row_id).alias("id"), x.alias("x"))


def _rows_of(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, dim)


class Centre:
    """Exact means: sums = whole * n + part."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.dim = n, len(sums)
        self.whole = np.array([s // n for s in sums], dtype=np.int64)
        self.part = np.array([s % n for s in sums], dtype=np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n; the whole part is taken off before anything is rounded."""
        return (x - self.whole).astype(np.float64) - self.part / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - sums) ** 2; None where 64 bits can't hold one."""
        about = self.n * self.centred(x)
        size = (about * about).sum(axis=1)
        low = np.abs(about).max(axis=1, initial=0) < 2.0 ** 30
        exact = (self.n * (x - self.whole) - self.part) if low.all() else None
        if exact is not None and (size < 2.0 ** 62).all():
            return (exact * exact).sum(axis=1).tolist()
        out = []
        for row, s in zip(x.tolist(), size.tolist(), strict=True):
            total = None if s > 2.0 ** 64 else sum(
                (self.n * (v - w) - p) ** 2 for v, w, p in zip(row, self.whole.tolist(), self.part.tolist(), strict=True))
            out.append(total if total is not None and total < 1 << 63 else None)
        return out


def _sums(dim: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * dim, 0
        for batch in batches:
            x = _rows_of(batch, dim)
            n += len(x)
            for part in np.array_split(x, -(-len(x) // 4096) or 1):  # 4,096 entries below 2 ** 51 stay below 2 ** 63
                total = [a + b for a, b in zip(total, part.sum(axis=0).tolist(), strict=True)]
        if n:
            yield pa.RecordBatch.from_pydict({"at": pa.array([*range(dim), dim], pa.int32()),
                                              "s": pa.array([*total, n], pa.decimal128(38, 0))})

    return add


def _summed(data: DataFrame, work: Callable, shape: tuple[int, ...]) -> np.ndarray:
    """Sum over all batches of ``work(rows)``, an array of this shape; partial sums per task."""
    size = int(np.prod(shape))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(shape), False
        for batch in batches:
            total, some = total + work(batch), True
        if some:
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(size, dtype=np.int32)), "s": pa.array(total.ravel())})

    out = np.zeros(size)
    for r in data.mapInArrow(add, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect():
        out[r["at"]] = r["s"]
    return out.reshape(shape)


def covariance_product(data: DataFrame, centre: Centre, vectors: np.ndarray) -> np.ndarray:
    """Covariance times vectors, one pass over the rows."""
    def work(batch: pa.RecordBatch) -> np.ndarray:
        c = centre.centred(_rows_of(batch, centre.dim))
        return c.T @ (c @ vectors)

    return _summed(data.select("x"), work, vectors.shape) / centre.n


def _orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``new`` adds to orthonormal columns; directions lost to rounding go."""
    out = np.zeros((new.shape[0], 0))
    for v in new.T:
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v = v / size
        for _ in range(3):
            for q in (*against, out):
                v = v - q @ (q.T @ v)
            left = np.linalg.norm(v)
            if left < 1e-10:
                break
            v = v / left
        else:
            out = np.column_stack([out, v])
    return out


def corrections(product: Callable, locked: np.ndarray, x: np.ndarray, theta: np.ndarray, residual: np.ndarray, steps: int) -> np.ndarray:
    """MINRES on (I - P P') (V - theta) (I - P P') t = -residual for every column, all in step.

    P holds the locked vectors and the column's own Ritz vector. One product of all columns a step.
    """
    def project(v: np.ndarray) -> np.ndarray:
        v = v - locked @ (locked.T @ v)
        return v - x * (x * v).sum(axis=0)

    v = project(-residual)
    beta = np.linalg.norm(v, axis=0)
    safe = lambda b: np.where(b > 0, b, 1.0)
    v, v_old = v / safe(beta), np.zeros_like(v)
    t, w, w_old = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
    eta, beta_now = beta.copy(), np.zeros_like(beta)
    c, c_old, s, s_old = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        z = project(product(v) - theta * v)
        alpha = (v * z).sum(axis=0)
        z = z - alpha * v - beta_now * v_old
        beta_next = np.linalg.norm(z, axis=0)
        gap = c * alpha - c_old * s * beta_now
        r1 = np.hypot(gap, beta_next)
        r2, r3 = s * alpha + c_old * c * beta_now, s_old * beta_now
        c_old, s_old = c, s
        c, s = gap / safe(r1), beta_next / safe(r1)
        w_new = (v - r3 * w_old - r2 * w) / safe(r1)
        w_old, w = w, w_new
        t = t + c * eta * w
        eta = -s * eta
        v_old, v, beta_now = v, z / safe(beta_next), beta_next
    return project(t)


def leading_pairs(product: Callable, dim: int, count: int, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, vectors) of the ``count`` largest of a symmetric operator known by its products."""
    count = min(count, dim)
    most = min(dim, BASIS * count)
    locked, values = np.zeros((dim, 0)), []
    basis = _orthonormal(np.random.default_rng(1).standard_normal((dim, min(dim, 2 * count))))
    image = product(basis)
    scale = 0.0
    for _ in range(OUTER_STEPS):
        theta, y = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        basis, image = basis @ y, image @ y
        scale = max(scale, float(theta[0]))
        want = count - len(values)
        residual = image[:, :want] - basis[:, :want] * theta[:want]
        residual -= locked @ (locked.T @ residual)
        bad = np.linalg.norm(residual, axis=0) > tolerance * scale
        ready = int(np.argmax(bad)) if bad.any() else len(bad)
        if ready:
            values += theta[:ready].tolist()
            locked = np.column_stack([locked, basis[:, :ready]])
            basis, image = basis[:, ready:], image[:, ready:]
            theta, residual, bad = theta[ready:], residual[:, ready:], bad[ready:]
        if len(values) == count:
            return np.array(values), locked
        if basis.shape[1] + locked.shape[1] + int(bad.sum()) > most and basis.shape[1] + locked.shape[1] < dim:
            keep = min(basis.shape[1], 2 * count)
            basis, image = basis[:, :keep], image[:, :keep]
        at = np.flatnonzero(bad)
        t = corrections(product, locked, basis[:, at], theta[at], residual[:, at], INNER_STEPS)
        more = _orthonormal(t, locked, basis)
        if not more.shape[1]:  # nothing new: refresh what rounding has worn
            basis = _orthonormal(basis, locked)
            image = product(basis)
            continue
        image = np.column_stack([image, product(more)])
        basis = np.column_stack([basis, more])
    raise ArithmeticError(f"{count - len(values)} of {count} pairs did not converge")


def whiten(rows: DataFrame, row_id: str = "vec_id", vector: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every row that takes
    part and its first ``count`` components.

    Rows with a null vector, a null entry or one that is not finite or beyond 2 ** 50 / 1024 take no
    part; nor do vectors of another length than the commonest (of equally common ones the longest)
    or without entries. Ids may repeat or be null; equal rows all count. The sign of a component
    makes its largest entry positive. Fewer dimensions give fewer components. A component
    without variance (one row, constant or dependent columns) has a null ``whitened`` and is left
    out of ``identity_error``, which is null if none is left; ``explained`` is null if there is no
    variance at all; ``deviation`` is null where 64 bits can't hold it. No rows, no result.
    """
    spark = rows.sparkSession
    kind = rows.schema[row_id].dataType.simpleString()
    ddl = f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    scratch = Scratch(spark, "whitening")
    clean = scratch.keep(quantise(rows, row_id, vector).filter(F.size("x") > 0), "clean")
    lengths = clean.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if lengths is None:
        return spark.createDataFrame([], ddl)
    dim = lengths["dim"]
    data = clean.filter(F.size("x") == dim)
    sums = {r["at"]: int(r["s"]) for r in data.select("x").mapInArrow(_sums(dim), "at int, s decimal(38,0)").groupBy("at").agg(
        F.sum("s").cast("decimal(38,0)").alias("s")).collect()}
    centre = Centre(sums[dim], [sums[k] for k in range(dim)])

    values, vectors = leading_pairs(lambda u: covariance_product(data, centre, u), dim, count)
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))] < 0, -1.0, 1.0)
    live = values > ZERO * max(values.max(), 0.0)
    live &= values > 0
    whitener = np.where(live, vectors / np.sqrt(np.where(live, values, 1.0)), 0.0)

    def spread(batch: pa.RecordBatch) -> np.ndarray:
        c = centre.centred(_rows_of(batch, dim))
        w = c @ whitener
        return np.append((w.T @ w).ravel(), (c * c).sum())

    k = len(values)
    found = _summed(data.select("x"), spread, (k * k + 1,)) / centre.n
    off = np.abs(found[:-1].reshape(k, k) - np.eye(k))[np.ix_(live, live)]
    error = float(off.max()) if off.size else None
    trace = float(found[-1])
    explained = [max(float(v), 0.0) / trace if trace > 0 else None for v in values]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows_of(batch, dim)
            w = centre.centred(x) @ whitener
            m = len(x)
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id").take(pa.array(np.repeat(np.arange(m), k))),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                "n": pa.array(np.full(m * k, centre.n, dtype=np.int64)),
                "deviation": pa.array([d for d in centre.deviations(x) for _ in range(k)], pa.int64()),
                "whitened": pa.array(w.ravel(), mask=np.tile(~live, m)),
                "explained": pa.array(explained * m, pa.float64()), "identity_error": pa.array([error] * (m * k), pa.float64())})

    return data.mapInArrow(emit, ddl)


def report(rows: DataFrame) -> DataFrame:
    return whiten(rows).withColumnRenamed("id", "vec_id")
