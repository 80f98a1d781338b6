"""Whitened embeddings by a randomised range finder (operator 11).

A random basis somewhat wider than the wanted components is multiplied by the covariance in passes
over all centred rows. After each pass a Rayleigh-Ritz step gives components, and the same pass
their residuals. A basis whose residuals don't fall far enough within its passes is doubled, up to
full dimension, where the step is exact.

Each pass reads the stored fit list; a task adds up a matrix of dimensions x basis, Spark sums the
tasks' entries, so the driver sees matrices of the dimension alone, whatever the number of rows.

Cases: rows whose vector is null, empty, or holds null or non-finite entries are left out. Repeated
vectors count once in the fit and each get their own rows. If vectors differ in length, those of the
length that most distinct vectors have count (of several the greater one); others are left out.
Integers beyond +-2^25 are cut to it. Components without variance (below 1e-10 of the largest) don't
exist, so a table of one distinct vector, like an empty one, gives no rows. A deviation beyond 64
bits is null. Row ids are kept as they are, null and repeated ones too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise
from .texts import id_first, working
from .vectors import integers, matrix

COMPONENTS = 16
#: Columns of the first basis beyond the components.
OVERSAMPLE = 8
#: Passes of one basis before it is doubled.
PASSES = 4
#: Largest error of a component: its residual as a share of the gap to the next eigenvalue.
TOLERANCE = 1e-12
#: What rounding leaves of a residual anyway, as a share of the largest eigenvalue.
ROUNDING = 1e-15
#: Components with a smaller share of the largest eigenvalue have no direction of their own.
NO_VARIANCE = 1e-10
#: What the contract adds to each integer; differences from the mean don't see it.
OFFSET = 1_000_000


def fit_list(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Each distinct integer vector once. Tasks drop their own repeats before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, good = integers(batch.column(0))
            yield pa.RecordBatch.from_arrays([x.filter(pa.array(good & (np.diff(x.offsets.to_numpy()) > 0)))], names=["x"])

    return vectors.select(vectors[vector_col].alias("v")).mapInArrow(working("whitening", run), "x array<int>").distinct()


@dataclass(frozen=True)
class Centre:
    """Size of the fit list and the exact sums of its dimensions."""

    n: int
    sums: np.ndarray

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly; Python integers where 64 bits may not hold it."""
        most = int(np.abs(x).max(initial=0))
        if 2 * self.n * most < 1 << 62:
            return self.n * x - self.sums
        return self.n * x.astype(object) - self.sums.astype(object)

    def rows(self, x: np.ndarray) -> np.ndarray:
        """x - S/n."""
        return self.scaled(x).astype(np.float64) / self.n


def _summed(fit: DataFrame, dimensions: int, task: Callable[[np.ndarray], np.ndarray], size: int, kind: str) -> np.ndarray:
    """The sum over all rows of what ``task`` makes of each block of rows: ``size`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            part = task(matrix(batch.column(0), dimensions))
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["k", "v"])

    found = fit.mapInArrow(working("whitening", run), f"k long, v {kind}").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size, np.int64 if kind == "long" else np.float64)
    for k, v in found:
        out[k] = v
    return out


def _basis(columns: np.ndarray) -> np.ndarray:
    return np.linalg.qr(columns)[0]


def _ritz(basis: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, vectors and residual norms of the covariance in a basis, largest first."""
    small = basis.T @ image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors = basis @ turn
    return values, vectors, np.linalg.norm(image @ turn - vectors * values, axis=0)


def range_finder(multiply: Callable[[np.ndarray], np.ndarray], dimensions: int, components: int, *, oversample: int = OVERSAMPLE, passes: int = PASSES, tolerance: float = TOLERANCE, seed: int = 11) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Largest eigenvalues and vectors of a covariance that is known by its products alone, and
    the width of the basis at each pass."""
    random, k = np.random.default_rng(seed), min(components, dimensions)
    basis = _basis(random.standard_normal((dimensions, min(dimensions, components + oversample))))
    widths: list[int] = []
    while True:
        width, before = basis.shape[1], None
        for left in reversed(range(passes)):
            image = multiply(basis)
            widths.append(width)
            values, vectors, residuals = _ritz(basis, image)
            apart = -np.diff(values, append=0.0)
            gaps = np.minimum(apart, np.insert(apart[:-1], 0, np.inf))[:k]
            worst = float((residuals[:k] / (tolerance * gaps + ROUNDING * values[0] + np.finfo(float).tiny)).max())
            if width == dimensions or worst <= 1:
                return values[:k], vectors[:, :k], widths
            basis = _basis(image)
            if before and worst * min(1.0, worst / before) ** left > 1:
                break  # the passes that are left won't do
            before = worst
        more = random.standard_normal((dimensions, min(dimensions, 2 * width) - width))
        basis = _basis(np.hstack([basis, more]))


@dataclass(frozen=True)
class Whitener:
    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float
    widths: tuple[int, ...]

    @property
    def weights(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def fit_whitener(vectors: DataFrame, *, vector_col: str = "embedding", components: int = COMPONENTS, **options) -> Whitener | None:
    """Components of the distinct vectors; None where there is no variance. options: those of
    ``range_finder``."""
    fit = materialise(fit_list(vectors, vector_col), "whitening-fit")
    sizes = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not sizes:
        return None
    d, n = sizes[0]
    fit = fit.where(F.size("x") == d)
    centre = Centre(n, _summed(fit, d, lambda x: x.sum(axis=0), d, "long"))
    trace = float(_summed(fit, d, lambda x: np.array([np.square(centre.rows(x)).sum()]), 1, "double")[0]) / n

    def multiply(basis: np.ndarray) -> np.ndarray:
        def task(x: np.ndarray) -> np.ndarray:
            rows = centre.rows(x)
            return (rows.T @ (rows @ basis)).reshape(-1)

        return _summed(fit, d, task, basis.size, "double").reshape(basis.shape) / n

    if trace <= 0:
        return None
    values, found, widths = range_finder(multiply, d, components, **options)
    real = values > NO_VARIANCE * values[0]
    values, found = values[real], found[:, real]
    k, weights = len(values), found / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        white = centre.rows(x) @ weights
        return np.append(white.sum(axis=0), (white.T @ white).reshape(-1))

    sums = _summed(fit, d, moments, k + k * k, "double") / n
    covariance = sums[k:].reshape(k, k) - np.outer(sums[:k], sums[:k])
    return Whitener(centre, values, found, values / trace, float(np.abs(covariance - np.eye(k)).max()), tuple(widths))


def _deviation(scaled: np.ndarray) -> pa.Array:
    most = int(np.abs(scaled).max(initial=0))
    if most * most * scaled.shape[1] < 1 << 63:
        return pa.array(np.square(scaled.astype(np.int64)).sum(axis=1), pa.int64())
    exact = [sum(int(v) ** 2 for v in row) for row in scaled]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, **options) -> DataFrame:
    """A row per vector and component, with what the fit says about itself."""
    spark = vectors.sparkSession
    schema = id_first(vectors, id_col, id_col, "component int, n long, deviation long, whitened double, explained double, identity_error double")
    fitted = fit_whitener(vectors, vector_col=vector_col, components=components, **options)
    if fitted is None:
        return spark.createDataFrame([], schema)
    d, k = fitted.vectors.shape
    centre, weights, explained = fitted.centre, fitted.weights, fitted.explained

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, good = integers(batch.column(1))
            kept = pa.array(good & (np.diff(x.offsets.to_numpy()) == d))
            rows, ids = matrix(x.filter(kept), d), batch.column(0).filter(kept)
            m, scaled = len(rows), centre.scaled(rows)
            again = pa.array(np.repeat(np.arange(m), k))
            white = (scaled.astype(np.float64) / centre.n) @ weights
            columns = [ids.take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, centre.n)), _deviation(scaled).take(again), pa.array(white.reshape(-1)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, fitted.identity_error))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return vectors.select(vectors[id_col].alias("id"), vectors[vector_col].alias("v")).mapInArrow(working("whitening", run), schema)
