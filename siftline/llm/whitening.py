"""Whitening of embeddings by eigenvalues that a contour encloses."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftline.session import materialize

SCALE, SHIFT = 1024, 100_000
LARGEST = float(1 << 40)
NODES = 8
ROUNDS = 40
SEED = 12


# --- the fit list -------------------------------------------------------------------------------------------


def _dimension(vectors: DataFrame) -> int:
    """The most frequent length of a usable vector, the shorter of two; 0 if there is none."""
    best = vectors.groupBy(F.size("vec").alias("d")).count().agg(F.max(F.struct("count", -F.col("d")))).first()[0]
    return -best[1] if best else 0


def _matrix(column: pa.Array, dims: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, dims)


def _summed(df: DataFrame, part, rows: int, width: int) -> np.ndarray:
    """The sum over the tasks of a ``rows`` x ``width`` matrix, which ``part`` makes of a task's batches, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, width))
        for batch in batches:
            total += part(batch)
        yield pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "v"])

    cells = df.mapInArrow(run, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
    out = np.zeros((rows, width))
    for r in cells.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # of the size of the matrix
        out[r.i, r.j] = r.v
    return out


def covariance(df: DataFrame, column: str, centre: np.ndarray, n: int) -> np.ndarray:
    """The covariance, divisor ``n``, of the vectors in ``column``, centred at ``centre`` before they are multiplied."""
    d = len(centre)

    def part(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros((d, d))
        for at in range(0, batch.num_rows, 2048):
            x = _matrix(batch.column(0).slice(at, 2048), d, np.float64) - centre
            total += x.T @ x
        return total

    return _summed(df.select(column), part, d, d) / n


# --- eigenvalues in an interval -----------------------------------------------------------------------------


def eigenvalues_above(matrix: np.ndarray, bound: float) -> int:
    """How many eigenvalues of a symmetric matrix are above ``bound``: the inertia of its shift.

    Symmetric elimination with the largest pivot, of one or two rows (Bunch and Parlett); by
    Sylvester's law the signs of the pivots are those of the eigenvalues.
    """
    a, positive = matrix - bound * np.eye(len(matrix)), 0
    alpha = (1 + 17**0.5) / 8
    while len(a):
        n = len(a)
        diag = np.abs(np.diag(a))
        off = np.abs(np.tril(a, -1))
        p, q = np.unravel_index(int(off.argmax()), off.shape)
        r = int(diag.argmax())
        if diag[r] == 0 and off[p, q] == 0:
            return positive
        if diag[r] >= alpha * off[p, q]:
            pivot = [r]
            positive += a[r, r] > 0
        else:
            pivot = [int(p), int(q)]
            block = a[np.ix_(pivot, pivot)]
            det = block[0, 0] * block[1, 1] - block[0, 1] ** 2
            positive += 1 if det < 0 else 2 * (block[0, 0] + block[1, 1] > 0)
        rest = np.setdiff1d(np.arange(n), pivot)
        side = a[np.ix_(rest, pivot)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(a[np.ix_(pivot, pivot)], side.T)
        a = (a + a.T) / 2
    return int(positive)


@dataclass(frozen=True)
class Interval:
    low: float
    high: float
    count: int


def split_spectrum(matrix: np.ndarray, most: int, wanted: int) -> list[Interval]:
    """Intervals from the top down that hold ``wanted`` eigenvalues at least, each ``most`` at most unless they are one cluster.

    Each lower bound is bisected by inertia counts until few enough values lie above it.
    """
    top = float(np.abs(matrix).sum(axis=1).max()) * (1 + 1e-9)  # Gershgorin
    floor = float(np.trace(matrix)) * len(matrix) * np.finfo(float).eps
    done, high, above = [], top, 0
    rank = eigenvalues_above(matrix, floor)
    wanted = min(wanted, rank)
    while above < wanted:
        left, right = floor, high  # at left too many or all, at right none
        count = rank - above
        best = (floor, count)
        for _ in range(48):
            if count <= most:
                break
            mid = (left + right) / 2
            found = eigenvalues_above(matrix, mid) - above
            if found == 0:
                right = mid
            else:
                left, best, count = mid, (mid, found), found
        low, count = best
        done.append(Interval(low, high, count))
        above, high = above + count, low
    return done


def contour_eigenpairs(matrix: np.ndarray, interval: Interval, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """All eigenpairs of a symmetric matrix with values in ``interval``, by FEAST.

    The spectral projector is the contour integral of the resolvent around the interval: Gauss-Legendre
    quadrature over the upper half of an ellipse, one complex solve of the shifted matrix per node for a whole
    block of vectors. Rayleigh-Ritz on the projected block gives the pairs, and rounds repeat until the residuals of
    those inside vanish. The inertia count of the interval says how many there are; fewer would mean that some are missed.
    """
    d = len(matrix)
    scale = max(float(np.abs(matrix).sum(axis=1).max()), np.finfo(float).tiny)
    centre, radius = (interval.low + interval.high) / 2, (interval.high - interval.low) / 2
    x, w = np.polynomial.legendre.leggauss(nodes)
    angles = np.pi / 2 * (1 - x)
    size = min(d, interval.count + max(4, interval.count // 2))
    rng = np.random.default_rng(SEED)
    block = rng.standard_normal((d, size))
    for _ in range(ROUNDS):
        projected = np.zeros((d, block.shape[1]))
        for angle, weight in zip(angles, w):
            point = np.exp(1j * angle)
            solved = np.linalg.solve((centre + radius * point) * np.eye(d) - matrix, block.astype(complex))
            projected += weight / 2 * radius * (point * solved).real
        basis, _ = np.linalg.qr(projected)
        values, small = np.linalg.eigh(basis.T @ matrix @ basis)  # Rayleigh-Ritz, of the block's size
        block = basis @ small
        inside = (values > interval.low) & (values <= interval.high)
        residual = np.linalg.norm(matrix @ block - block * values, axis=0)
        # The count is of the exact matrix; a value at the bound may round to the other side.
        best = np.argsort(-values)[: interval.count] if inside.sum() != interval.count else np.flatnonzero(inside)
        near = np.abs(values[best] - centre) <= radius * (1 + 1e-9) + scale * 1e-13
        if len(best) == interval.count and near.all() and residual[best].max(initial=0) <= 1e-13 * scale * d**0.5:
            break
    else:
        raise ArithmeticError(f"{interval.count} eigenvalues lie in {interval.low} to {interval.high}, not all were found")
    order = best[np.argsort(-values[best], kind="stable")]
    return values[order], block[:, order]


def leading_eigenpairs(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues above 0 (fewer if the rank is lower), falling, with unit vectors as columns."""
    found = [contour_eigenpairs(matrix, i) for i in split_spectrum(matrix, 2 * wanted, wanted)]
    if not found:
        return np.empty(0), np.empty((len(matrix), 0))
    values, vectors = np.concatenate([v for v, _ in found])[:wanted], np.concatenate([x for _, x in found], axis=1)[:, :wanted]
    vectors, _ = np.linalg.qr(vectors)  # pairs of different intervals, to the last digit
    tops = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.sign(vectors[tops, range(len(values))])


# --- the operator -------------------------------------------------------------------------------------------


def _projected(dims: int, n: int, sums: list[int], components: np.ndarray):
    """Rows (id, deviation, white): the exact deviation and the projection of every x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _matrix(part.column("x"), dims, np.int64)
                if n * max(int(np.abs(x).max()), 1) + max(map(abs, sums)) < 2**62:
                    away = n * x - np.array(sums, np.int64)
                else:  # beyond 64 bits: numbers of Python
                    away = n * x.astype(object) - np.array(sums, object)
                real = away.astype(np.float64)
                if (real * real).sum(axis=1).max() < 2.0**62:
                    exact = (away * away).sum(axis=1).tolist()
                else:
                    exact = [sum(int(v) ** 2 for v in row) for row in away.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([v if v < 2**63 else None for v in exact], pa.int64()),
                     pa.array(list(real / n @ components), pa.list_(pa.float64()))],
                    ["id", "deviation", "white"],
                )

    return run


def whiten(
    vectors: DataFrame, most: int = 8, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per usable row and component up to ``most``.

    An entry c becomes x = floor(1024 c) + 100000. n rows of x with sums S have the covariance V, divisor n; its unit eigenvectors,
    by falling eigenvalue e, are the components. whitened is (x - S / n) on a component over sqrt(e); deviation is the exact sum of (n x - S)^2,
    null beyond 64 bits; explained is e / trace(V); identity_error is the largest entry of |covariance of whitened - identity|.

    Vectors that are null or empty, or hold null or non-finite entries or some beyond 2^40, are left out, and so are those of another length than the most
    frequent one (the shorter of two). Directions without variance are no components: fewer than ``most`` remain if the rank is lower, and none for
    equal vectors or a single one. Equal ids and repeated rows each give rows; a null id stays null; an empty table gives an empty one; other columns are not read.

    Two passes over the rows give n, S and V: each task adds up its own rows and sends one d x d matrix, so what reaches the driver is d x d numbers
    whatever the number of rows. There FEAST takes the leading eigenpairs of V; the rows are projected in tasks, and a third pass measures the result.
    """
    spark = vectors.sparkSession
    entries = F.col(vector_col).cast("array<double>")
    usable = F.forall(entries, lambda c: c.isNotNull() & (F.abs(c) < LARGEST))  # NaN is above all numbers
    rows = vectors.where(entries.isNotNull() & (F.size(entries) > 0) & usable).select(F.col(id_col).alias("id"), entries.alias("vec"))
    dims = _dimension(rows)
    schema = (
        f"vec_id {vectors.schema[id_col].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, "
        "explained double, identity_error double"
    )
    if not dims:
        return spark.createDataFrame([], schema)
    x = F.transform("vec", lambda c: F.floor(c * SCALE).cast("bigint") + SHIFT)
    fit = materialize(rows.where(F.size("vec") == dims).select("id", x.alias("x")), "fit")
    sums, n = [0] * dims, fit.count()
    for r in fit.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(20)")).alias("s")).collect():
        sums[r.i] = int(r.s)
    v = covariance(fit, "x", np.array([s / n for s in sums]), n)
    values, components = leading_eigenpairs((v + v.T) / 2, most)
    if not len(values):
        return spark.createDataFrame([], schema)
    k = len(values)
    white = fit.mapInArrow(
        _projected(dims, n, sums, components / np.sqrt(values)),
        f"id {fit.schema['id'].dataType.simpleString()}, deviation bigint, white array<double>",
    )
    white = materialize(white, "white")
    mean = _summed(white.select("white"), lambda b: _matrix(b.column(0), k, np.float64).sum(axis=0, keepdims=True), 1, k)[0] / n
    error = float(np.abs(covariance(white, "white", mean, n) - np.eye(k)).max())
    explained = F.array(*[F.lit(float(e)) for e in values / np.trace(v)])
    told = white.select("id", "deviation", F.posexplode("white").alias("at", "whitened"))
    return told.select(
        F.col("id").alias("vec_id"), (F.col("at") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
