"""Whitening of embeddings by FEAST contour integration.

Entries become integers, x = floor(scale * c) + offset. Three passes over the rows give
what is needed of them: the sums; the products of the centred rows (exact integers); and,
to check the result, the products of the whitened rows. Each task sends sums of its rows
only, ``dims`` rows of ``dims`` numbers, and they are added up by row in Spark. So the
driver holds one covariance of dims x dims numbers, however many vectors there are.

The largest eigenvalues are placed between the points of a grid by inertia counts: the
negative pivots of T - s, with T the tridiagonal form of the covariance, tell how many
eigenvalues lie below s. Contours are circles through the widest gaps. Each is a task of
its own: the complex shifted systems at Gauss-Legendre points of the half circle are
solved for a block of random vectors, their weighted sum projects the block onto the
eigenvectors inside (FEAST), and Rayleigh-Ritz extracts them, until the residuals are at
rounding level. A contour that yields another number of eigenvalues than the inertia
counts say is an error: none is missed.

Defined results: vectors that are null or hold a null, NaN or infinity are dropped; a null
``vec_id`` is an id like any other, repeated rows are whitened each; vectors of different
lengths are whitened apart, each length by its own covariance; an empty vector has no
components; a component without variance (constant entries, fewer vectors than dimensions)
has null ``whitened`` and ``explained`` 0 (null if nothing varies); among equal eigenvalues
the order is free; entries beyond 64 bits are an error; an empty table gives an empty
table; columns other than ``vec_id`` and ``embedding`` are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows whose products are added up at once.
SLICE = 4096
#: Eigenvalues inside one contour, unless they lie too close to be parted.
INSIDE = 8
#: Gauss-Legendre points of the upper half circle.
POINTS = 8

_EXACT = 2**53
_LOW = 2**32


def integer_vectors(embeddings: DataFrame, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """``vec_id``, ``dims`` and ``x`` (longs) of the vectors that take part."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("long") + offset)
    rows = embeddings.where(F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
    return rows.select("vec_id", F.size("embedding").alias("dims"), x.alias("x"))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``dims``, row numbers and the matrix of the rows of each length, at most ``SLICE`` at once."""
    dims = batch.column("dims").to_numpy()
    for d in np.unique(dims):
        rows = np.flatnonzero(dims == d)
        for at in range(0, len(rows), SLICE):
            part = rows[at : at + SLICE]
            flat = batch.column("x").take(pa.array(part)).flatten().to_numpy()
            yield int(d), part, flat.reshape(len(part), int(d))


def exact_product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``left.T @ right`` of integers, exact; Python integers."""
    most = int(np.abs(left).max(initial=0)) * int(np.abs(right).max(initial=0)) * len(left)
    if most < _EXACT:
        return (left.astype(float).T @ right.astype(float)).astype(np.int64).astype(object)
    return left.astype(object).T @ right.astype(object)


def _added(vectors: DataFrame, summed: Callable[[int, np.ndarray], np.ndarray]) -> dict[int, list]:
    """Per length: the number of vectors, and the sum over all blocks of ``summed(dims, block)``, a matrix of integers.

    A matrix travels as its rows, each entry as a high and a low part, whose sums stay
    within 64 bits.
    """
    schema = "dims int, row int, n long, high array<long>, low array<long>"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for batch in batches:
            for d, part, x in _blocks(batch):
                one = totals.setdefault(d, [0, 0])
                one[0] += len(part)
                one[1] = one[1] + summed(d, x)
        for d, (n, matrix) in totals.items():
            high, low = np.floor_divide(matrix, _LOW), np.mod(matrix, _LOW)
            columns = [[d] * len(matrix), list(range(len(matrix))), [n] * len(matrix), high.tolist(), low.tolist()]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["dims", "row", "n", "high", "low"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, parts = 0, [0, 0]
        for batch in batches:
            n += sum(batch.column("n").to_pylist())
            for i, name in enumerate(("high", "low")):
                flat = batch.column(name).flatten().to_numpy()
                parts[i] = parts[i] + flat.reshape(len(batch), -1).sum(axis=0)
        one = [pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([n], pa.int64())]
        yield pa.RecordBatch.from_arrays([*one, *[pa.array([p.tolist()], pa.list_(pa.int64())) for p in parts]], names=["dims", "row", "n", "high", "low"])

    sums = vectors.where("dims > 0").mapInArrow(partial, schema).groupBy("dims", "row").applyInArrow(add, schema)
    out: dict[int, list] = {}
    for r in sorted(sums.collect(), key=lambda r: (r["dims"], r["row"])):  # dims numbers for each of dims rows, of any table
        one = out.setdefault(r["dims"], [r["n"], []])
        one[1].append([h * _LOW + low for h, low in zip(r["high"], r["low"])])
    return out


class Fit:
    """What the vectors of one length have in common: ``n``, ``sums``, the covariance, and the components found."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.centre = np.array([s // n for s in sums], np.int64)
        self.covariance = np.zeros((len(sums), len(sums)))
        self.values, self.vectors = np.zeros(0), np.zeros((len(sums), 0))

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact (64-bit where they fit, else Python integers)."""
        rest = np.array([s - self.n * c for s, c in zip(self.sums, self.centre.tolist())], np.int64)  # below n
        near = x - self.centre
        if (int(np.abs(near).max(initial=0)) + 1) * self.n < 2**62:
            return near * self.n - rest
        return near.astype(object) * self.n - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n).astype(float) @ self.vectors / np.sqrt(self.values)


def fit_covariance(vectors: DataFrame) -> dict[int, Fit]:
    """The covariance of every length of vectors, from exact sums, centred before they are multiplied."""
    ones = lambda d, x: exact_product(np.ones((len(x), 1), np.int64), x)
    fits = {d: Fit(n, sums[0]) for d, (n, sums) in _added(vectors, ones).items()}
    centres = {d: f.centre for d, f in fits.items()}
    for d, (n, products) in _added(vectors, lambda d, x: exact_product(x - centres[d], x - centres[d])).items():
        fit = fits[d]
        rest = np.array([s - n * c for s, c in zip(fit.sums, fit.centre.tolist())], object)
        fit.covariance = ((np.array(products, object) * n - np.outer(rest, rest)) / (n * n)).astype(float)
    return fits


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix with the eigenvalues of a symmetric one (Householder)."""
    a = matrix.astype(float).copy()
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if length == 0:
            continue
        v[0] += np.copysign(length, v[0])
        v /= np.linalg.norm(v)
        p = a[k + 1 :, k + 1 :] @ v
        w = p - (v @ p) * v
        a[k + 1 :, k + 1 :] -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
    return np.diag(a).copy(), np.diag(a, -1).copy()


def inertia(tri: tuple[np.ndarray, np.ndarray], shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each shift: the negative pivots of the shifted matrix."""
    diagonal, off = tri
    tiny = np.finfo(float).tiny
    below, pivot = np.zeros(len(shifts), int), np.inf
    for d, b in zip(diagonal, np.concatenate([[0.0], off])):
        pivot = d - shifts - b * b / pivot
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)  # a zero pivot counts as a negative one
        below += pivot < 0
    return below


def contours(covariance: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """Intervals (low, high, count) that hold the ``wanted`` largest eigenvalues with variance, by inertia counts."""
    tri = tridiagonal(covariance)
    size = len(covariance)
    reach = np.abs(tri[0]) + np.concatenate([np.abs(tri[1]), [0]]) + np.concatenate([[0], np.abs(tri[1])])
    bound = float(reach.max(initial=0))
    if bound == 0:
        return []
    noise = 4 * size * np.finfo(float).eps * bound
    # Bisection for all places from the top at once.
    place = size - np.arange(size)
    low, high = np.full(size, -bound - noise), np.full(size, bound + noise)
    while (high - low).max() > noise / 8:
        middle = (low + high) / 2
        under = inertia(tri, middle) >= place
        low, high = np.where(under, low, middle), np.where(under, middle, high)
        if not ((low < (low + high) / 2) & ((low + high) / 2 < high)).any():
            break
    values = (low + high) / 2
    varied = int((values > noise).sum())
    edges = np.concatenate([[bound + bound / 8 + noise], values, [-bound]])
    gaps = edges[:-1] - edges[1:]  # gap k lies above eigenvalue k
    gaps[varied] = max(gaps[varied], values[varied - 1] if varied else 0)
    out, at = [], 0
    while at < min(wanted, varied):
        # The widest gap within reach; eigenvalues too close to part stay together.
        ends = np.arange(at + 1, min(at + INSIDE, varied) + 1)
        if ends[-1] >= wanted:
            ends = ends[ends >= wanted]
        end = int(ends[np.argmax(gaps[ends])])
        while gaps[end] <= 8 * noise and end < varied:
            end += 1
        cut = [values[0] + gaps[0] / 2 if at == 0 else (values[at - 1] + values[at]) / 2]
        cut.append(values[end - 1] / 2 if end == varied else (values[end - 1] + values[end]) / 2)
        counts = inertia(tri, np.array(cut))
        out.append((float(cut[1]), float(cut[0]), int(counts[0] - counts[1])))
        at = end
    return out


def feast(covariance: np.ndarray, low: float, high: float, count: int, seed: int = 0, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues between ``low`` and ``high``, and their unit eigenvectors as columns."""
    size = len(covariance)
    norm = np.abs(covariance).sum(axis=0).max()
    block = np.random.default_rng(seed).standard_normal((size, min(size, 2 * count + 4)))
    points, weights = np.polynomial.legendre.leggauss(POINTS)
    centre, radius = (low + high) / 2, (high - low) / 2
    turn = np.exp(-0.5j * np.pi * (points - 1))
    best = np.inf
    for _ in range(rounds):
        projected = np.zeros_like(block)
        for z, w in zip(turn, weights):
            shifted = (centre + radius * z) * np.eye(size) - covariance
            projected += w / 2 * np.real(radius * z * np.linalg.solve(shifted, block.astype(complex)))
        basis, _ = np.linalg.qr(projected)
        ritz, turned = np.linalg.eigh(basis.T @ covariance @ basis)
        block = basis @ turned
        residual = np.linalg.norm(covariance @ block - block * ritz, axis=0)
        inside = np.flatnonzero((ritz > low) & (ritz < high))
        if len(inside) >= count:
            inside = np.sort(inside[np.argsort(residual[inside])[:count]])
            now = residual[inside].max(initial=0)
            if now <= 1e-12 * norm and now >= best / 4:  # at rounding level, and no better than before
                return ritz[inside], block[:, inside]
            best = min(best, now)
    raise ArithmeticError(f"{count} eigenvalues between {low} and {high}: {len(inside)} found, residual {best}")


def fit_components(vectors: DataFrame, wanted: int = 32) -> dict[int, Fit]:
    """The fits of every length with their largest components; each contour is a task."""
    fits = fit_covariance(vectors)
    matrices = {d: f.covariance for d, f in fits.items()}
    circles = [(d, i, *c) for d, m in matrices.items() for i, c in enumerate(contours(m, wanted))]
    if not circles:
        return fits

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, i, low, high, count in batch.itertuples(index=False):
                values, found = feast(matrices[d], low, high, count, seed=i)
                yield pd.DataFrame({"dims": d, "value": values, "vector": list(found.T)})

    spark = vectors.sparkSession
    table = spark.createDataFrame(circles, "dims int, circle int, low double, high double, count int")
    found = table.repartition(len(circles), "dims", "circle").mapInPandas(solve, "dims int, value double, vector array<double>").collect()
    for d, fit in fits.items():
        mine = sorted((r for r in found if r["dims"] == d), key=lambda r: -r["value"])[:wanted]
        fit.values = np.array([r["value"] for r in mine])
        fit.vectors = np.array([r["vector"] for r in mine]).reshape(len(mine), d).T
        if np.abs(fit.vectors.T @ fit.vectors - np.eye(len(mine))).max(initial=0) > 1e-8:
            raise ArithmeticError(f"components of length {d} are not orthogonal")
    return fits


def identity_error(vectors: DataFrame, fits: dict[int, Fit]) -> float | None:
    """The largest absolute entry of (covariance of the whitened vectors - identity), measured on the vectors.

    Products are rounded to multiples of 2^-40 to be added up exactly, in any order.
    """
    fixed = 2.0**40

    def moments(d: int, x: np.ndarray) -> np.ndarray:
        w = fits[d].whitened(x)
        both = np.concatenate([w.T @ w, w.sum(axis=0)[None, :]]) if w.shape[1] else np.zeros((0, 0))
        return np.vectorize(int, otypes=[object])(np.rint(both * fixed))

    worst = None
    for d, (n, rows) in _added(vectors, moments).items():
        both = np.array(rows, object) / (fixed * n)
        mean = both[-1].astype(float)
        covariance = both[:-1].astype(float) - np.outer(mean, mean)
        worst = max(worst or 0.0, float(np.abs(covariance - np.eye(len(mean))).max()))
    return worst


def whiten(embeddings: DataFrame, components: int = 32, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """Per vector and component: ``vec_id``, ``component``, ``n``, ``deviation`` (a decimal), ``whitened``, ``explained``, ``identity_error``."""
    vectors = integer_vectors(embeddings, scale, offset)
    fits = fit_components(vectors, components)
    error = identity_error(vectors, fits)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, part, x in _blocks(batch):
                fit, count = fits[d], min(components, d)
                off = fit.deviations(x)
                exact = off.dtype != object and int(np.abs(off).max(initial=0)) ** 2 * d < 2**63
                squares = (off * off).sum(axis=1) if exact else (off.astype(object) ** 2).sum(axis=1)
                deviation = pa.array(squares).cast(pa.decimal128(38, 0)) if exact else pa.array([Decimal(v) for v in squares], pa.decimal128(38, 0))
                values = np.full((len(part), count), np.nan)
                values[:, : len(fit.values)] = fit.whitened(x)
                trace = np.trace(fit.covariance)
                shares = np.zeros(count)
                shares[: len(fit.values)] = fit.values / trace if trace else 0
                again = pa.array(np.repeat(np.arange(len(part)), count))
                flat = values.ravel()
                explained = pa.array(np.tile(shares, len(part)), mask=np.full(len(flat), not trace))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(part)).take(again),
                        pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(part))),
                        pa.array(np.full(len(flat), fit.n)),
                        deviation.take(again),
                        pa.array(flat, mask=np.isnan(flat)),
                        explained,
                        pa.array([error] * len(flat), pa.float64()),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    return vectors.where("dims > 0").mapInArrow(rows, schema)
