"""Whitening of embeddings: pivoted Cholesky of the centred scatter, one-sided Jacobi on its factor.

Components of a vector become whole numbers (256 times, floored). The distinct vectors are the fit list.
Two passes over it give its exact sums and then the scatter of vectors from which the mean has been taken;
each task sends one small matrix, which Spark adds up. On the driver, where only a matrix of dimension by
dimension arrives, the covariance is factored by Cholesky with pivoting (it stops at the rank), and plane
rotations make the columns of the triangular factor orthogonal: their squared norms are the
eigenvalues, the columns divided by their norms the components. The covariance is never
squared and no eigenproblem is formed. A third pass measures how far the whitened fit list is from unit
covariance. Rows are then projected task by task, without a shuffle.

Defined results: rows with a null vector, null or non-finite entries or no entries take no part, nor do
vectors of another length than the most frequent one (the least of several); repeated rows each give their
rows; a component whose eigenvalue is zero (fewer distinct directions than components) is not returned, so
one distinct vector, or none, gives no rows; entries beyond the range of a long are clipped to it; a
deviation beyond a long is null; of tied eigenvalues any orthogonal choice may come; a component's entry
of largest size is positive; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .vectors import dimension, matrix, valid

#: Steps of one unit into which an entry is cut, and components returned.
SCALE, COMPONENTS = 256, 4
#: A pivot below this share of the first one ends the factorization; rotations end when no two columns' cosine is larger.
RANK_LIMIT, COSINE = 1e-13, 1e-15
SWEEPS = 60


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with L @ L.T = a, its columns in the order of the pivots (rows are not permuted back: row i is
    dimension i). As many columns as the rank."""
    d = len(a)
    rest, low = np.diag(a).astype(float).copy(), np.zeros((d, d))
    limit = RANK_LIMIT * max(rest.max(initial=0.0), 0.0)
    free = np.ones(d, bool)
    for k in range(d):
        p = int(np.argmax(np.where(free, rest, -np.inf)))
        if rest[p] <= limit:
            return low[:, :k]
        free[p] = False
        low[p, k] = np.sqrt(rest[p])
        low[free, k] = (a[free, p] - low[free, :k] @ low[p, :k]) / low[p, k]
        rest[free] -= low[free, k] ** 2
    return low


def rounds_of(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Every pair of n columns once, in rounds of disjoint pairs."""
    m = n + n % 2
    order, out = list(range(m)), []
    for _ in range(m - 1):
        pairs = [(min(p), max(p)) for p in zip(order[: m // 2], reversed(order[m // 2 :]), strict=True) if max(p) < n]
        out.append((np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int)))
        order = [order[0], order[-1], *order[1:-1]]
    return out


def one_sided_jacobi(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, components as rows) of low @ low.T, by falling eigenvalue: columns are rotated in
    pairs until all are orthogonal."""
    x = low.T.copy()  # columns as rows: contiguous
    for _ in range(SWEEPS):
        worst = 0.0
        for i, j in rounds_of(len(x)):
            if not len(i):
                continue
            a, b = x[i], x[j]
            p, q, r = (a * a).sum(1), (b * b).sum(1), (a * b).sum(1)
            size = np.sqrt(p * q)
            cosine = np.divide(np.abs(r), size, out=np.zeros_like(r), where=size > 0)
            worst = max(worst, cosine.max())
            turn = cosine > COSINE
            if not turn.any():
                continue
            zeta = np.divide(q - p, 2 * r, out=np.zeros_like(r), where=turn)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta)), 0.0)
            c = 1 / np.hypot(1, t)
            s = c * t
            x[i], x[j] = c[:, None] * a - s[:, None] * b, s[:, None] * a + c[:, None] * b
        if worst <= COSINE * 4:
            break
    norms = np.sqrt((x * x).sum(1))
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > 0]
    v = x[order] / norms[order, None]
    big = v[np.arange(len(v)), np.abs(v).argmax(1)]
    return norms[order] ** 2, v * np.where(big < 0, -1.0, 1.0)[:, None]


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors, their exact sums, all eigenvalues, the components kept as rows, and the error."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    trace: float
    error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, the whole part of S / n taken off exactly first."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([s % self.n for s in self.sums], float) / self.n
        near = np.abs(x.astype(float) - whole) < 2**62
        return np.where(near, (x - whole).astype(float), x.astype(float) - whole) - part

    def whitened(self, x: np.ndarray) -> np.ndarray:
        k = len(self.components)
        return self.centred(x) @ (self.components / np.sqrt(self.values[:k])[:, None]).T

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2, exact; null beyond a long."""
        most = max((abs(s) for s in self.sums), default=0) + self.n * max(int(x.max(initial=0)), -int(x.min(initial=0)))
        if most * most * max(len(self.sums), 1) < 2**63:
            d = self.n * x - np.array(self.sums, np.int64)
            return (d * d).sum(1).tolist()
        out = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [v if v < 2**63 else None for v in out]


def whole(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(id, x): entries in whole steps."""
    top = float(2**63 - 1024)
    step = lambda c: F.greatest(F.lit(-top), F.least(F.lit(top), c * scale))
    return vectors.select("id", F.transform("v", lambda c: F.floor(step(c)).cast("long")).alias("x"))


def _added(parts: DataFrame) -> DataFrame:
    return parts.groupBy("i", "j").agg(F.sum("v").alias("v"))


def fit(rows: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of the distinct x vectors of ``rows`` (id, x)."""
    distinct = written(rows.select("x").distinct(), "whitening")

    def sums(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # high and low halves of the entries are added apart, so that no sum can leave a long
        total = np.zeros((3, dim), np.int64)
        for b in frames:
            x = matrix(b.column("x"), dim)
            total += np.stack([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0), np.full(dim, len(x))])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), *[pa.array(t, pa.int64()) for t in total]], ["i", "hi", "lo", "n"])

    got = distinct.mapInArrow(sums, "i int, hi long, lo long, n long").groupBy("i").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("hi", "lo", "n")]).collect() if dim else []
    n = int(got[0]["n"]) if got else 0
    if n == 0:
        return Whitening(0, (0,) * dim, np.zeros(0), np.zeros((0, dim)), 0.0)
    base = Whitening(n, tuple((int(r["hi"]) << 32) + int(r["lo"]) for r in sorted(got)), np.zeros(0), np.zeros((0, dim)), 0.0)

    def scatter(frames: Iterator[pa.RecordBatch], model: Whitening = base, project: bool = False) -> Iterator[pa.RecordBatch]:
        k = len(model.components) if project else dim
        total, ones = np.zeros((k, k)), np.zeros(k)
        for b in frames:
            x = matrix(b.column("x"), dim)
            c = model.whitened(x) if project else model.centred(x)
            total += c.T @ c
            ones += c.sum(0)
        i, j = np.indices((k + 1, k)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.concatenate([total, ones[None]]).ravel())], ["i", "j", "v"])

    def covariance(f, k: int) -> np.ndarray:
        """Of what is already centred up to rounding, which the mean that is left takes off."""
        out = np.zeros((k + 1, k))
        for r in _added(distinct.mapInArrow(f, "i int, j int, v double")).toLocalIterator():
            out[r["i"], r["j"]] = r["v"] / n
        return (out[:k] + out[:k].T) / 2 - np.outer(out[k], out[k])

    cov = covariance(scatter, dim)
    values, vectors = one_sided_jacobi(pivoted_cholesky(cov))
    model = Whitening(n, base.sums, values, vectors[:components], float(np.trace(cov)))
    k = len(model.components)
    if k == 0:
        return model
    error = np.abs(covariance(lambda frames: scatter(frames, model, True), k) - np.eye(k)).max()
    return Whitening(n, base.sums, values, model.components, model.trace, float(error))


def projected(rows: DataFrame, model: Whitening, dim: int) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every row (id, x)."""
    k = len(model.components)
    kind = rows.schema["id"].dataType.simpleString()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            x = matrix(b.column("x"), dim)
            m = len(x)
            if not m or not k:
                continue
            at = pa.array(np.repeat(np.arange(m), k))
            cols = [
                b.column("id").take(at), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.n), pa.int64()),
                pa.array(model.deviations(x), pa.int64()).take(at), pa.array(model.whitened(x).ravel()), pa.array(np.tile(model.values[:k] / model.trace, m)), pa.array(np.full(m * k, model.error)),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): each row's first components."""
    own = valid(vectors, id_col, vector)
    dim = dimension(own)
    rows = whole(own.filter(F.size("v") == dim), scale)
    return projected(rows, fit(rows, dim, components), dim).withColumnRenamed("id", id_col)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
