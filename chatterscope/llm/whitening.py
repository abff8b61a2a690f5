"""Whitening of embeddings by a pivoted Cholesky factor and one-sided Jacobi rotations.

Vectors become whole numbers, so that everything summed over the table is exact and does not depend on
how Spark deals the rows:

1.  One pass counts the vectors and sums each dimension.
2.  A second pass centres every entry by its dimension's mean, rounded to a whole number, and sums the
    products of each pair of dimensions in every task; the tasks' sums are added in Spark. What the
    rounding left out is put right in exact fractions, which gives the scatter of the centred entries.
3.  The scatter over n, V, is square in the number of dimensions only and goes to the driver. It is
    factored as L L^T with the largest remaining diagonal entry as pivot; the columns of L are rotated in
    pairs until all are orthogonal. Their squared norms are V's eigenvalues, the normalised columns its
    components, with high relative accuracy for small ones too.
4.  A third pass projects every vector; a fourth measures the covariance of what came out.

A vector that is null, or holds a null, NaN or infinite entry, is dropped, and so is one whose length is
not the most common (of equally common ones the largest). Entries beyond `BOUND` count as `BOUND`.
Repeated rows count each time; null ids are kept. Components whose eigenvalue is zero up to rounding
don't exist: one vector, or equal ones, have none and give no rows, like an empty table. Of equal
eigenvalues the components are some orthogonal pair, the same for all rows. A deviation that no long
holds is null. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Steps of a unit that entries are rounded down to, and what is added.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Largest size of an entry; beyond, whole numbers would not be exact in what follows.
BOUND = 2.0**24
#: Vectors that one product of a task takes.
STEP = 4096


def cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order): v[order][:, order] = L L^T, columns until what remains is rounding only."""
    left, order, n = v.copy(), np.arange(len(v)), len(v)
    factor = np.zeros_like(v)
    least = np.diag(v).max(initial=0.0) * np.finfo(float).eps * n
    for k in range(n):
        p = k + int(np.argmax(np.diag(left)[k:]))
        if left[p, p] <= least:
            return factor[:, :k], order
        for x in (left, factor):
            x[[k, p]] = x[[p, k]]
        left[:, [k, p]] = left[:, [p, k]]
        order[[k, p]] = order[[p, k]]
        factor[k, k] = np.sqrt(left[k, k])
        factor[k + 1 :, k] = left[k + 1 :, k] / factor[k, k]
        left[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def rounds(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of n columns such that each pair comes once and those of a round share no column."""
    ring = [*range(n), *[-1] * (n % 2)]
    half, out = len(ring) // 2, []
    for _ in range(len(ring) - 1):
        pairs = [(a, b) for a, b in zip(ring[:half], ring[: half - 1 : -1], strict=True) if a >= 0 and b >= 0]
        out.append(tuple(np.array(x, int) for x in zip(*pairs, strict=True)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return [r for r in out if r]


def jacobi(columns: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """`columns`, rotated in pairs until all are orthogonal to double precision."""
    w, pairs = columns.copy(), rounds(columns.shape[1])
    for _ in range(sweeps):
        worst = 0.0
        for i, j in pairs:
            x, y = w[:, i], w[:, j]
            a, b, c = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(a * b)
            off = np.abs(c) > 1e-15 * size
            worst = max(worst, float((np.abs(c) / np.where(size > 0, size, 1)).max(initial=0)))
            zeta = (b - a) / np.where(off, 2 * c, 1)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            t = np.where(off, t, 0.0)
            cos = 1 / np.hypot(1, t)
            w[:, i], w[:, j] = cos * (x - t * y), cos * (t * x + y)
        if worst <= 1e-14:
            break
    return w


def components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of a covariance, without those of value zero."""
    factor, order = cholesky(v)
    if not factor.shape[1]:
        return np.zeros(0), np.zeros((len(v), 0))
    w = jacobi(factor)
    norms = np.sqrt((w * w).sum(0))
    by_size = np.argsort(-norms, kind="stable")
    vectors = np.empty_like(w)
    vectors[order] = w[:, by_size] / norms[by_size]
    return norms[by_size] ** 2, vectors


def covariance(n: int, sums: list[int], products: np.ndarray) -> np.ndarray:
    """Of whole numbers, from the sums of (rounded-mean-centred) entries and of their products, exact up to
    one rounding."""
    d = len(sums)
    v = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            v[i, j] = v[j, i] = float(Fraction(n * int(products[i, j]) - sums[i] * sums[j], n * n))
    return v


def whole_numbers(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and x, whole numbers, of the rows that have a vector."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    number = lambda c: F.floor(F.least(F.greatest(c, F.lit(-BOUND)), F.lit(BOUND)) * SCALE).cast("long") + SHIFT
    entries = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), entries.alias("c"))
    return rows.where(F.col("c").isNotNull() & F.forall("c", finite)).select("vec_id", F.transform("c", number).alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            yield part.column("x").flatten().to_numpy().reshape(part.num_rows, -1)


def _pair_sums(shift: np.ndarray):
    """Sums of the products of shifted entries, a row for each pair of dimensions and task."""
    d = len(shift)
    i, j = np.triu_indices(d)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), object)
        for x in _matrices(batches):
            y = x - shift
            most = int(np.abs(y).max(initial=0))
            # Products of doubles are exact while their sum stays below 2^53.
            total += (y.astype(float).T @ y.astype(float)).astype(np.int64) if most * most * len(y) < 1 << 53 else y.T.astype(object) @ y.astype(object)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array([int(t) for t in total[i, j]], pa.decimal128(38, 0))], names=["i", "j", "v"]
        )

    return add


class Fit:
    """What whitening needs of the whole table: n, sums by dimension, eigenvalues and components."""

    def __init__(self, rows: DataFrame, most: int = COMPONENTS):
        """rows: vec_id and x, all of one length."""
        sums = rows.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
        found = sorted(sums.collect())  # a row for each dimension
        self.n = int(found[0]["n"]) if found else 0
        self.sums = [int(r["s"]) for r in found]
        d = len(found)
        self.shift = np.array([round(Fraction(s, self.n)) for s in self.sums], np.int64)
        self.rest = np.array([float(Fraction(s, self.n) - int(m)) for s, m in zip(self.sums, self.shift, strict=True)])
        products = np.zeros((d, d), object)
        if d:
            pairs = rows.mapInArrow(_pair_sums(self.shift), "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v"))
            for r in pairs.toLocalIterator():  # a row for each pair of dimensions
                products[r["i"], r["j"]] = int(r["v"])
        left = [s - self.n * int(m) for s, m in zip(self.sums, self.shift, strict=True)]
        v = covariance(self.n, left, products)
        self.trace = float(np.trace(v))
        values, vectors = components(v)
        self.values, self.vectors = values[:most], vectors[:, :most]

    def project(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.shift) - self.rest) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2 for each row, exact."""
        left = np.array([s - self.n * int(m) for s, m in zip(self.sums, self.shift, strict=True)], object)
        y = x - self.shift
        most = int(np.abs(y).max(initial=0)) * self.n + max((abs(int(r)) for r in left), default=0)
        if most * most * len(left) < 1 << 63:
            z = y * self.n - left.astype(np.int64)
            return (z * z).sum(1).tolist()
        z = y.astype(object) * self.n - left
        return [t if (t := int((r * r).sum())) < 1 << 63 else None for r in z]


def _identity_error(rows: DataFrame, fit: Fit) -> float:
    """The largest entry of (covariance of what is whitened) - identity, over all rows."""
    k = len(fit.values)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for x in _matrices(batches):
            z = np.hstack([fit.project(x), np.ones((len(x), 1))])
            total += z.T @ z
        i, j = np.triu_indices(k + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "v"])

    found = rows.mapInArrow(add, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    total = np.zeros((k + 1, k + 1))
    for r in found.collect():  # a row for each pair of components
        total[r["i"], r["j"]] = total[r["j"], r["i"]] = r["v"]
    mean = total[:k, k] / fit.n
    return float(np.abs(total[:k, :k] / fit.n - np.outer(mean, mean) - np.eye(k)).max())


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def of_one_length(rows: DataFrame) -> DataFrame:
    """The rows whose x has the most common length, of equally common ones the largest; empty ones go."""
    lengths = rows.groupBy(F.size("x").alias("d")).count().where("d > 0")
    most = lengths.agg(F.max(F.struct("count", "d")).alias("m")).first()["m"]
    return rows.where(F.size("x") == (most["d"] if most else 0)).where("size(x) > 0")


def whitened(vectors: DataFrame, vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained (share of
    the variance) and identity_error."""
    rows = of_one_length(whole_numbers(vectors, vector))
    fit = Fit(rows, most)
    k = len(fit.values)
    error = _identity_error(rows, fit) if k else 0.0
    explained = fit.values / fit.trace if k else fit.values

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not k:
                continue
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                x = part.column("x").flatten().to_numpy().reshape(part.num_rows, -1)
                m = len(x)
                deviation = pa.array(fit.deviations(x), pa.int64())
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, fit.n)),
                        deviation.take(each), pa.array(fit.project(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(project, _OUT)

