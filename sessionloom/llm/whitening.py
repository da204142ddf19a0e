"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its factor.

Entries become whole numbers, so sums and products are exact and do not depend on how rows are
dealt out. Rows are centred at the rounded mean before they are multiplied; what the rounding
leaves (half a unit at most) is taken out of the sums exactly.

With the scatter C = P L Lᵀ Pᵀ, rotations from the right make the columns of L orthogonal. The
squared norms of the rotated columns are the eigenvalues of C, the normalised columns its
eigenvectors; C is never diagonalised itself, so small eigenvalues keep their digits.

Only sums per dimension and per pair of dimensions leave the executors, added up there first.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import Batches, map_batches, shared_folder

SCALE = 1024
OFFSET = 100_000
#: Larger entries have no long that a double holds exactly.
_LARGEST = 2.0**53
#: Numbers a worker adds up before it hands them on.
_HELD = 1 << 20
#: Rows multiplied at a time, so that products of numbers below 2**20 add up exactly as doubles.
_ROWS = 4096
_EXACT = 1 << 20
#: A rotation is left out where columns are orthogonal to this.
_ORTHOGONAL = 1e-15
_SWEEPS = 60


@dataclass(frozen=True)
class Whitening:
    """What the fit list determines. Components are columns, by falling eigenvalue.

    ``sums`` are per dimension, exact; ``values`` are eigenvalues of the covariance, ``trace`` its
    trace. There are as many components as the covariance has rank, up to the number asked for.
    """

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def centre(self) -> np.ndarray:
        """Means, rounded to whole numbers."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)


def entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows that can be used, their lengths, where they begin, all entries as whole numbers)."""
    column = batch.column("embedding")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_list(column.type.value_type))
    flat = column.flatten()
    lengths = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    known = ~np.asarray(flat.is_null().to_numpy(zero_copy_only=False), bool)
    c = np.asarray(flat.fill_null(0).to_numpy(zero_copy_only=False), np.float64) * SCALE
    good = known & np.isfinite(c) & (np.abs(c) < _LARGEST)
    x = np.floor(np.where(good, c, 0)).astype(np.int64) + OFFSET
    bad = np.concatenate(([0], np.cumsum(~good)))
    usable = np.asarray(column.is_valid().to_numpy(zero_copy_only=False), bool) & (bad[ends] == bad[begins])
    return np.flatnonzero(usable), lengths, begins, x


def _rows_of(batch: pa.RecordBatch, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of that many entries that can be used, their entries as a matrix)."""
    usable, lengths, begins, x = entries(batch)
    own = usable[lengths[usable] == dimensions]
    return own, x[begins[own][:, None] + np.arange(dimensions)]


def _sums(batches: Batches) -> Batches:
    """(length, dimension, n, total) of a partition, handed on when many are held."""
    held: dict[int, tuple[int, np.ndarray]] = {}

    def flush():
        at = [(length, d, n, Decimal(int(t))) for length, (n, total) in held.items() for d, t in enumerate(total.tolist())]
        held.clear()
        columns = list(zip(*at)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.decimal128(38, 0))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["length", "dimension", "n", "total"])

    for batch in batches:
        usable, lengths, begins, x = entries(batch)
        for length in np.unique(lengths[usable]).tolist():
            own = usable[lengths[usable] == length]
            n, total = held.get(length, (0, np.zeros(length, object)))
            rows = x[begins[own][:, None] + np.arange(length)]
            held[length] = n + len(own), total + _column_sums(rows)
        if sum(len(total) + 1 for _, total in held.values()) >= _HELD:
            yield flush()
    yield flush()


def _column_sums(rows: np.ndarray) -> np.ndarray:
    """Exact, as Python numbers: high and low halves are summed apart."""
    high, low = rows >> 26, rows & ((1 << 26) - 1)
    return high.sum(axis=0).astype(object) * (1 << 26) + low.sum(axis=0).astype(object)


def _products(y: np.ndarray) -> np.ndarray:
    """YᵀY, exact: as doubles while all partial sums are below 2**53, else as Python numbers."""
    if y.size and np.abs(y).max() >= _EXACT:
        own = y.astype(object)
        return own.T @ own
    real = y.astype(np.float64)
    return (real.T @ real).astype(np.int64).astype(object)


def _scatter(centre: np.ndarray):
    """(cell, total): products of centred rows of a partition, by cell of the upper triangle."""
    d = len(centre)
    cells = np.triu_indices(d)

    def run(batches: Batches) -> Batches:
        total = np.zeros((d, d), object)
        for batch in batches:
            _, rows = _rows_of(batch, d)
            for at in range(0, len(rows), _ROWS):
                total = total + _products(rows[at : at + _ROWS] - centre)
        places = cells[0] * d + cells[1]
        values = [Decimal(int(v)) for v in total[cells]]
        yield pa.RecordBatch.from_arrays([pa.array(places.astype(np.int64)), pa.array(values, pa.decimal128(38, 0))], ["cell", "total"])

    return run


def pivoted_cholesky(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with matrix[order][:, order] = L Lᵀ for a positive semidefinite matrix.

    The largest remaining diagonal entry is the next pivot; L has as many columns as there are
    pivots above rounding, which is the rank.
    """
    a = matrix.astype(np.float64).copy()
    d = len(a)
    order = np.arange(d)
    factor = np.zeros((d, d))
    least = d * np.finfo(float).eps * max(a.diagonal().max(initial=0.0), 0.0)
    for k in range(d):
        rest = a.diagonal()[k:]
        p = k + int(rest.argmax())
        if a[p, p] <= least:
            return factor[:, :k], order
        for rows in (a, factor):
            rows[[k, p]] = rows[[p, k]]
        a[:, [k, p]] = a[:, [p, k]]
        order[[k, p]] = order[[p, k]]
        factor[k, k] = np.sqrt(a[k, k])
        factor[k + 1 :, k] = a[k + 1 :, k] / factor[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def _rounds(columns: int):
    """Every pair of columns once, in rounds of pairs that share no column (a round-robin)."""
    players = list(range(columns)) + [-1] * (columns % 2)
    half = len(players) // 2
    for _ in range(len(players) - 1):
        pairs = [(a, b) for a, b in zip(players[:half], reversed(players[half:])) if min(a, b) >= 0]
        yield np.array([min(p) for p in pairs]), np.array([max(p) for p in pairs])
        players = [players[0], players[-1], *players[1:-1]]


def one_sided_jacobi(factor: np.ndarray) -> np.ndarray:
    """factor times a rotation, with orthogonal columns, by falling norm.

    A sweep rotates every pair of columns until their product is nothing beside their norms.
    """
    u = factor.copy()
    if u.shape[1] < 2:
        return u
    rounds = list(_rounds(u.shape[1]))
    for _ in range(_SWEEPS):
        turned = False
        for a, b in rounds:
            x, y = u[:, a], u[:, b]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            apart = np.abs(gamma) > _ORTHOGONAL * np.sqrt(alpha * beta)
            if not apart.any():
                continue
            turned = True
            zeta = (beta - alpha) / np.where(apart, 2 * gamma, 1.0)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            t = np.where(apart, t, 0.0)
            c = 1 / np.hypot(1.0, t)
            u[:, a], u[:, b] = c * x - c * t * y, c * t * x + c * y
        if not turned:
            break
    return u[:, np.argsort(-(u * u).sum(0), kind="stable")]


def eigen(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of a positive semidefinite matrix, falling."""
    scale = float(np.abs(scatter).max(initial=0))
    if not scale:
        return np.empty(0), np.empty((len(scatter), 0))
    factor, order = pivoted_cholesky(scatter / scale)
    turned = one_sided_jacobi(factor)
    norms = np.sqrt((turned * turned).sum(0))
    vectors = np.empty_like(turned)
    vectors[order] = turned / norms
    return norms**2 * scale, vectors


def dimensions_of(sums: DataFrame) -> int | None:
    """The commonest length of usable vectors, of equally common ones the greatest; None without any."""
    most = sums.where("dimension = 0").groupBy("length").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    return most.length if most else None


def fit(vectors: DataFrame, components: int = 8) -> Whitening | None:
    """Mean, covariance and leading components of vectors (embedding); None where none can be used.

    Usable vectors hold no NULL and no entry that is infinite, not a number, or so large that
    1024 times it is 2**53 or more. They all have one length, the commonest; others lack entries
    or have more than the rest, and are left out, as are empty ones. Totals beyond 38 digits are an error.
    """
    own = vectors.select("embedding")
    per_length = map_batches(own, _sums, "length long, dimension long, n long, total decimal(38,0)")
    sums = per_length.groupBy("length", "dimension").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total")).persist()
    try:
        d = dimensions_of(sums)
        if not d:
            return None
        found = sums.where(F.col("length") == d).orderBy("dimension").collect()
    finally:
        sums.unpersist()
    n, totals = found[0].n, [int(r.total) for r in found]
    plain = Whitening(n, totals, np.empty((d, 0)), np.empty(0), 0.0)
    cells = map_batches(own, _scatter(plain.centre), "cell long, total decimal(38,0)")
    raw = np.zeros((d, d), object)
    for r in cells.groupBy("cell").agg(F.sum("total").cast("decimal(38,0)").alias("total")).collect():
        raw[r.cell // d, r.cell % d] = raw[r.cell % d, r.cell // d] = int(r.total)
    left = [s - n * int(c) for s, c in zip(totals, plain.centre)]
    # Exact: n times the centred scatter, which is n squared times the covariance.
    scatter = n * raw - np.outer(np.array(left, object), np.array(left, object))
    covariance = np.array([[float(Fraction(int(v), n * n)) for v in row] for row in scatter])
    values, vectors_ = eigen(covariance)
    trace = float(Fraction(sum(int(scatter[i, i]) for i in range(d)), n * n))
    return Whitening(n, totals, vectors_[:, :components], values[:components], trace)


def _deviations(t: np.ndarray) -> list[int]:
    """Exact sums of squares per row; 64-bit sums where they can't overflow."""
    real = t.astype(np.float64)
    fits = (real * real).sum(1) < 2.0**62
    out = np.zeros(len(t), object)
    out[fits] = (t[fits] * t[fits]).sum(1).astype(object)
    for i in np.flatnonzero(~fits):
        out[i] = sum(int(v) ** 2 for v in t[i])
    return out.tolist()


def _project(fitted: Whitening, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, n·x − S of each, its whitened coordinates)."""
    centre = fitted.centre
    left = np.array([s - fitted.n * int(c) for s, c in zip(fitted.sums, centre)], np.int64)
    own, x = _rows_of(batch, len(centre))
    y = x - centre
    if y.size and float(np.abs(y).max()) * fitted.n >= 2.0**62:
        t = fitted.n * y.astype(object) - left
    else:
        t = fitted.n * y - left
    centred = t.astype(np.float64) / fitted.n
    return own, t, centred @ fitted.components / np.sqrt(fitted.values)


def transform(vectors: DataFrame, fitted: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened) of every usable vector; whitened is an array by component.

    ``deviation`` is the sum over dimensions of (n·x − S)², exact, as a decimal; NULL where it has
    over 38 digits. Rows that repeat, or have no vec_id, all stay.
    """

    def run(batches: Batches) -> Batches:
        for batch in batches:
            own, t, white = _project(fitted, batch)
            k = white.shape[1]
            offsets = pa.array(np.arange(len(own) + 1, dtype=np.int32) * k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(own)),
                    pa.array([Decimal(v) if v < 10**38 else None for v in _deviations(t)], pa.decimal128(38, 0)),
                    pa.ListArray.from_arrays(offsets, pa.array(white.ravel())),
                ],
                ["vec_id", "deviation", "whitened"],
            )

    return map_batches(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), run, "vec_id long, deviation decimal(38,0), whitened array<double>")


def identity_error(whitened: DataFrame, components: int) -> float:
    """Largest absolute entry of the covariance of whitened (an array column) minus the identity.

    Measured on the rows themselves: means first, then products of what is left without them.
    """
    if not components:
        return 0.0
    w = [F.col("whitened")[i] for i in range(components)]
    means = whitened.agg(*(F.avg(c) for c in w)).first()
    centred: list[Column] = [c - F.lit(m) for c, m in zip(w, means)]
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    found = whitened.agg(*(F.avg(centred[i] * centred[j]) for i, j in pairs)).first()
    return max(abs(v - (i == j)) for (i, j), v in zip(pairs, found))


RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 8) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per usable vector and component.

    See fit for what is usable. ``component`` counts from 1, ``explained`` is its share of the
    trace. Where the vectors span fewer dimensions than components are asked for (equal vectors
    span none) there are only as many. No usable vector gives no rows. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    fitted = fit(vectors, components)
    if fitted is None or not len(fitted.values):
        return spark.createDataFrame([], RESULT)
    folder = shared_folder(spark, "whitened")
    transform(vectors, fitted).write.parquet(folder)
    stored = spark.read.parquet(folder)
    error = identity_error(stored, len(fitted.values))
    shares = F.array(*(F.lit(float(e / fitted.trace)) for e in fitted.values))
    return stored.select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened")).select(
        "vec_id",
        (F.col("_at") + 1).cast("int").alias("component"),
        F.lit(fitted.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("_at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
