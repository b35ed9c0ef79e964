"""Whitening of vectors by spectral divide and conquer with QDWH polar decompositions.

The covariance is summed up by the tasks; only a matrix of dimensions x dimensions is brought to
the driver. There the polar factor of the shifted covariance, computed by the dynamically
weighted Halley iteration in QR form, gives the projectors onto the eigenvectors above and
below the shift. Orthonormal bases of both split the matrix in two smaller ones, and so on
until single components are left. The whitening matrix then goes back to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skilltrail.llm.vectors import matrices, usable

#: Components per unit, and what is added to them.
SCALE, OFFSET = 64, 1_000_000
#: Components that are returned.
COMPONENTS = 32
#: Eigenvalues below this share of the trace count as 0: they have no component.
LEAST_SHARE = 1e-13
_EPS = np.finfo(np.float64).eps


def polar_factor(a: np.ndarray) -> np.ndarray | None:
    """The orthogonal polar factor of a symmetric matrix; None if it is too close to singular.

    Each step of the iteration X <- X (a I + b X'X) (I + c X'X)^-1 is taken from one QR
    factorisation; its weights follow a lower bound of the least singular value.
    """
    n = len(a)
    norm = np.linalg.norm(a)
    if norm == 0:
        return None
    x, low = a / norm, _EPS
    for _ in range(12):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        root = np.sqrt(1 + d)
        weight = root + np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * root)) / 2
        b = (weight - 1) ** 2 / 4
        c = weight + b - 1
        q, _ = np.linalg.qr(np.concatenate([np.sqrt(c) * x, np.eye(n)]))
        new = b / c * x + (weight - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        low = min(1.0, low * (weight + b * square) / (1 + c * square))
        moved, x = np.linalg.norm(new - x), new
        if low > 1 - 1e-8 and moved < 1e-9 * np.sqrt(n):
            return x
    return None


def _shifts(a: np.ndarray) -> Iterator[float]:
    """Where to split: the middle of the diagonal, then the mean eigenvalue and places around it."""
    values = np.sort(np.diag(a))
    n = len(a)
    yield (values[(n - 1) // 2] + values[n // 2]) / 2
    mean = values.mean()
    # The eigenvalues' standard deviation; there are eigenvalues on both sides of their mean.
    spread = np.sqrt(max(0.0, np.sum((a - mean * np.eye(n)) ** 2) / n))
    for step in range(24):
        # Back and forth around the mean, ever closer to it.
        yield mean + spread * (-1) ** step * 0.7**step * (step > 0)


def split(a: np.ndarray, scale: float) -> tuple[np.ndarray, int] | None:
    """An orthogonal matrix whose first k columns span the eigenvectors above some shift, and k.

    None if no shift separates two groups: the eigenvalues are equal to working precision.
    """
    n = len(a)
    probe = np.random.default_rng(n).standard_normal((n, n))
    for shift in _shifts(a):
        u = polar_factor(a - shift * np.eye(n))
        if u is None:
            continue
        projector = (u + np.eye(n)) / 2
        k = int(round(np.trace(projector)))
        if not 0 < k < n:
            continue
        basis, _ = np.linalg.qr(projector @ probe[:, :k])
        # Once more, with the complement: errors of the first basis are projected out.
        q, _ = np.linalg.qr(projector @ basis, mode="complete")
        if np.linalg.norm(q[:, k:].T @ a @ q[:, :k]) <= 100 * n * _EPS * scale:
            return q, k
    return None


def eigenpairs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns."""
    n = len(a)
    scale = float(np.linalg.norm(a))
    vectors = np.zeros((n, 0))
    # Invariant subspaces still to be split: an orthonormal basis and the matrix inside it.
    open_parts = [(np.eye(n), (a + a.T) / 2)]
    while open_parts:
        basis, inner = open_parts.pop()
        size = len(inner)
        off = inner - np.trace(inner) / max(1, size) * np.eye(size)
        halves = None
        if size > 1 and np.linalg.norm(off) > 4 * _EPS * scale:
            halves = split(inner, scale)
        if halves is None:
            # One component, or equal eigenvalues: any basis of the subspace will do.
            vectors = np.concatenate([vectors, basis], axis=1)
            continue
        q, k = halves
        for part in (q[:, k:], q[:, :k]):
            matrix = part.T @ inner @ part
            open_parts.append((basis @ part, (matrix + matrix.T) / 2))
    vectors, _ = np.linalg.qr(vectors)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _blocks(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    return vectors.select(F.col(vector).cast("array<double>"), F.col(key))


def _summed(parts: DataFrame, size: int, kind: str) -> np.ndarray:
    """Rows (cell, total) of all tasks added up by cell: `size` numbers come to the driver."""
    out = np.zeros(size, dtype=np.int64 if kind == "long" else np.float64)
    # In rising order, so that a repeated run adds in the same order.
    rows = parts.groupBy("cell").agg(F.array_sort(F.collect_list("total")).alias("totals"))
    add = F.aggregate("totals", F.lit(0).cast(kind), lambda x, y: x + y)
    for cell, total in rows.select("cell", add.alias("total")).collect():
        out[cell] = total
    return out


def _cells(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["cell", "total"])


def sums(rows: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    """Number of vectors and sums of their integers, exact."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims + 1, dtype=np.int64)
        for _, grid in matrices(batches, dims, SCALE, OFFSET):
            total[:dims] += grid.sum(axis=0)
            total[dims] += len(grid)
        if total[dims]:
            yield _cells(total)

    found = _summed(rows.mapInArrow(add, "cell long, total long"), dims + 1, "long")
    return int(found[dims]), found[:dims]


def covariance(rows: DataFrame, dims: int, n: int, total: np.ndarray, project: np.ndarray | None = None) -> np.ndarray:
    """Covariance, divisor n, of the centred vectors, or of their projections."""
    size = dims if project is None else project.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, seen = np.zeros((size, size)), False
        for _, grid in matrices(batches, dims, SCALE, OFFSET):
            # Integers up to here: the mean is never rounded.
            centred = (n * grid - total) / n
            if project is not None:
                centred = centred @ project
            out += centred.T @ centred
            seen = True
        if seen:
            yield _cells(out[np.triu_indices(size)])

    found = _summed(rows.mapInArrow(add, "cell long, total double"), size * (size + 1) // 2, "double")
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = found / n
    return out + np.triu(out, 1).T


class Whitening:
    """What whitening needs: count, sums, eigenvalues and vectors, trace."""

    def __init__(self, n: int, total: np.ndarray, matrix: np.ndarray, components: int):
        values, vectors = eigenpairs(matrix)
        self.n, self.total, self.trace = n, total, float(np.trace(matrix))
        count = int(np.count_nonzero(values > LEAST_SHARE * self.trace)) if len(values) else 0
        self.values, self.vectors = values[: min(components, count)], vectors[:, : min(components, count)]

    @property
    def matrix(self) -> np.ndarray:
        """Centred vectors times this are white."""
        return self.vectors / np.sqrt(self.values)

    @property
    def explained(self) -> list[float]:
        return (self.values / self.trace).tolist()


def fitted(
    vectors: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding"
) -> tuple[DataFrame, int, Whitening | None]:
    """Usable rows, their length, and the whitening fitted on all of them (None without rows).

    Components c become floor(64 c) + 1000000 (floor(64 c) beyond +-2**27 is set to that). Rows
    whose vector is null, empty, holds null or non-finite components, or differs in length from
    that of the smallest key are left out. Equal vectors give equal components and as many
    eigenvalues of 0 as dimensions are lost; those have no component, so that a table of one
    vector has none at all.
    """
    rows, dims = usable(vectors, key, vector)
    if not dims:
        return rows, 0, None
    blocks = _blocks(rows, key, vector)
    n, total = sums(blocks, dims)
    return rows, dims, Whitening(n, total, covariance(blocks, dims, n, total), components)


def whitened(
    rows: DataFrame, dims: int, model: Whitening, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """key, deviation (of n x - S, squared and added up; null beyond 64 bits) and white components."""
    n, total, project = model.n, model.total, model.matrix
    key_type = rows.schema[key].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (keys,), grid in matrices(batches, dims, SCALE, OFFSET):
            off = n * grid - total
            white = (off / n) @ project
            most = int(np.abs(off).max()) if off.size else 0
            if most * most * dims < 1 << 63:
                spread = np.einsum("ij,ij->i", off, off)
            else:
                spread = [sum(x * x for x in row) for row in off.tolist()]
                spread = [x if x < 1 << 63 else None for x in spread]
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(grid) + 1, dtype=np.int32) * white.shape[1]), pa.array(white.ravel())
            )
            yield pa.RecordBatch.from_arrays([keys, pa.array(spread, pa.int64()), lists], names=[key, "deviation", "white"])

    return _blocks(rows, key, vector).mapInArrow(apply, f"`{key}` {key_type}, deviation long, white array<double>")


def identity_error(rows: DataFrame, dims: int, model: Whitening, key: str = "vec_id", vector: str = "embedding") -> float:
    """Largest entry of the white vectors' covariance less the identity."""
    if not len(model.values):
        return 0.0
    found = covariance(_blocks(rows, key, vector), dims, model.n, model.total, model.matrix)
    return float(np.abs(found - np.eye(len(found))).max())


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 32 white components of all embeddings."""
    rows, dims, model = fitted(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    if model is None or not len(model.values):
        return spark.createDataFrame(
            [],
            "vec_id long, component int, n long, deviation long, whitened double, explained double, "
            "identity_error double",
        )
    error = identity_error(rows, dims, model)
    shares = F.array(*(F.lit(x) for x in model.explained))
    return (
        whitened(rows, dims, model)
        .select("vec_id", "deviation", F.posexplode("white").alias("place", "whitened"))
        .select(
            "vec_id",
            (F.col("place") + 1).alias("component"),
            F.lit(model.n).cast("long").alias("n"),
            "deviation",
            "whitened",
            F.element_at(shares, F.col("place") + 1).alias("explained"),
            F.lit(error).alias("identity_error"),
        )
    )
