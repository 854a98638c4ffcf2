"""Operator 11 - embedding whitening by merged moments.

Entries are quantised to whole numbers far from zero, where sums of squares would lose the variance in a double. So each
partition computes its count, local mean and centred scatter, and Chan's formula merges pairs of them in a treeReduce; sums
are whole numbers of any size besides. The covariance is decomposed on the driver, and every vector is projected on the
components and scaled to variance one. A second pass merges the moments of the whitened vectors the same way and gives their
covariance's distance from the identity.

Vectors of different numbers of components can't share a covariance: those of each number are a fit list of their own, with
a matrix of its own on the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components of the result; a whole number is floor(SCALE * entry) + SHIFT; vectors of a slice; the share of the trace that an eigenvalue must exceed to be scaled to one.
COMPONENTS, SCALE, SHIFT, SLICE, FLAT = 32, 64, 1_000_000, 2048, 1e-12
#: Entries beyond this size, scaled, count as this size, so that whole numbers and their sums over a slice fit 64 bits.
LARGEST = 1 << 50


@dataclass
class Moments:
    """Count, mean and centred scatter of rows; ``total``: exact sums of whole numbers, if there are any."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray
    total: list[int] | None = None

    @staticmethod
    def of(x: np.ndarray) -> Moments:
        n = len(x)
        total = [int(t) for t in x.sum(axis=0)] if x.dtype.kind == "i" else None
        mean = np.array([t / n for t in total]) if total is not None else x.mean(axis=0)
        centred = x - mean
        return Moments(n, mean, centred.T @ centred, total)

    def merge(self, other: Moments) -> Moments:
        """Chan's pairwise formula; with exact sums, the mean comes from them."""
        n, apart = self.n + other.n, other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(apart, apart) * (self.n * (other.n / n))
        if self.total is None or other.total is None:
            return Moments(n, self.mean + apart * (other.n / n), scatter)
        total = [a + b for a, b in zip(self.total, other.total, strict=True)]
        return Moments(n, np.array([t / n for t in total]), scatter, total)

    @property
    def covariance(self) -> np.ndarray:
        return self.scatter / self.n


@dataclass
class Whitening:
    """What whitens vectors of one number of components: exact sums, eigenvalues (falling), unit eigenvectors as columns."""

    n: int
    total: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def scaled(self) -> np.ndarray:
        """Which components vary, and so can be scaled to variance one."""
        return self.values > FLAT * self.trace

    @property
    def explained(self) -> np.ndarray:
        return np.maximum(self.values, 0) / self.trace if self.trace > 0 else np.zeros(len(self.values))

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """(n * x - total) as doubles, and the exact sums of its squares; None where one doesn't fit 64 bits."""
        top = max([0, *map(abs, self.total)])
        if self.n * (int(np.abs(x).max(initial=0)) + 1) + top < 1 << 62:
            y = self.n * x - np.array(self.total, np.int64)
            if int(np.abs(y).max(initial=0)) ** 2 * max(1, x.shape[1]) < 1 << 63:
                return y.astype(np.float64), (y * y).sum(axis=1).tolist()
        big = [[self.n * v - t for v, t in zip(row, self.total, strict=True)] for row in x.tolist()]
        sums = [sum(v * v for v in row) for row in big]
        return np.array(big, np.float64), [s if s < 1 << 63 else None for s in sums]

    def apply(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """Whitened rows, NaN in components that don't vary, and the exact deviations."""
        y, sums = self.deviations(x)
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.scaled, 1 / np.sqrt(np.maximum(self.values, 0)), np.nan)
        return (y / self.n) @ self.vectors * scale, sums

    @staticmethod
    def of(m: Moments, components: int) -> Whitening:
        values, vectors = np.linalg.eigh(m.covariance)
        values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        # Either sign will do; the largest entry of each is made positive, so that reruns agree.
        lead = np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None, :], 0)
        return Whitening(m.n, m.total, values, vectors * np.where(lead < 0, -1.0, 1.0), float(np.trace(m.covariance)))


def usable(x: Column) -> Column:
    """Neither null nor with null, infinite or NaN entries. Zero vectors are usable."""
    return x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf"))))


def kept(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the usable rows of ``vectors`` (vec_id, embedding), entries as doubles."""
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).where(usable(F.col("x")))


def _slices(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, whole numbers) of the vectors of a batch, a number of components and a slice at a time."""
    column = b.column("x")
    size, flat = column.value_lengths().to_numpy(), column.flatten().to_numpy()
    first = np.cumsum(size) - size
    for dim in np.unique(size[size > 0]):
        own = np.flatnonzero(size == dim)
        for at in range(0, len(own), SLICE):
            places = own[at : at + SLICE]
            scaled = np.floor(SCALE * flat[first[places][:, None] + np.arange(dim)])
            yield places, np.clip(scaled, -LARGEST, LARGEST).astype(np.int64) + SHIFT


def _moments(measured: Callable[[np.ndarray], np.ndarray]):
    """A partition's moments of ``measured`` (whole numbers of vectors): dim, n, mean, scatter, total."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Moments] = {}
        for b in batches:
            for _, x in _slices(b):
                own, dim = Moments.of(measured(x)), x.shape[1]
                found[dim] = found[dim].merge(own) if dim in found else own
        rows = [(k, m.n, m.mean.astype("<f8").tobytes(), m.scatter.astype("<f8").tobytes(), json.dumps(m.total)) for k, m in found.items()]
        types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["dim", "n", "mean", "scatter", "total"])

    return run


def _state(r) -> dict[int, Moments]:
    mean = np.frombuffer(bytes(r["mean"]), "<f8")
    return {r["dim"]: Moments(r["n"], mean, np.frombuffer(bytes(r["scatter"]), "<f8").reshape(len(mean), len(mean)), json.loads(r["total"]))}


def _merged(a: dict[int, Moments], b: dict[int, Moments]) -> dict[int, Moments]:
    return {k: a[k].merge(b[k]) if k in a and k in b else a.get(k) or b[k] for k in a.keys() | b.keys()}


def reduced(rows: DataFrame, measured: Callable[[np.ndarray], np.ndarray]) -> dict[int, Moments]:
    """Moments over all of ``rows`` (x) by number of components: partitions' own, merged pair by pair in a tree."""
    parts = rows.select("x").mapInArrow(_moments(measured), "dim int, n long, mean binary, scatter binary, total string")
    none = rows.sparkSession.sparkContext.parallelize([{}], 1)  # an empty table has nothing to reduce
    return none.union(parts.rdd.map(_state)).treeReduce(_merged)


def fit(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """The whitening of each number of components among ``rows`` (x)."""
    return {k: Whitening.of(m, components) for k, m in reduced(rows, lambda x: x).items()}


def identity_errors(rows: DataFrame, models: dict[int, Whitening]) -> dict[int, float]:
    """Second pass: the largest entry of the whitened vectors' covariance minus the identity; 0 where nothing varies."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def measured(x: np.ndarray) -> np.ndarray:
        m = shared.value[x.shape[1]]
        return m.apply(x)[0][:, m.scaled]

    found = reduced(rows, measured)
    return {k: float(np.abs(m.covariance - np.eye(len(m.mean))).max(initial=0)) for k, m in found.items()}


def transform(rows: DataFrame, models: dict[int, Whitening]) -> DataFrame:
    """vec_id, dim, n, deviation, whitened (an array, NaN in components that don't vary) of each row of ``rows`` (vec_id, x).

    deviation is null where it doesn't fit 64 bits. Rows of a number of components without a model, or without components,
    have no row.
    """
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for places, x in _slices(b):
                if (m := shared.value.get(x.shape[1])) is None:
                    continue
                w, sums = m.apply(x)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
                columns = [b.column("vec_id").take(pa.array(places)), pa.array(np.full(len(w), x.shape[1]), pa.int32()), pa.array(np.full(len(w), m.n), pa.int64()), pa.array(sums, pa.int64()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "dim", "n", "deviation", "whitened"])

    return rows.mapInArrow(run, "vec_id long, dim int, n long, deviation long, whitened array<double>")


def digest(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each vector and component.

    Null vectors and vectors with null or non-finite entries are dropped, vectors without components give no row; null ids,
    repeated rows and zero vectors are rows like any other; an empty table gives an empty result; other columns are ignored.
    Vectors with another number of components are whitened among themselves. A component that doesn't vary (one vector,
    equal vectors) has null in whitened and no part in identity_error; deviation is null where it doesn't fit 64 bits;
    entries over 2 ** 50 / 64 in size count as that.
    """
    rows = kept(vectors)
    models = fit(rows, components)
    errors = identity_errors(rows, models)
    # A row for each number of components there is, and component.
    table = [(k, i + 1, float(share), errors[k]) for k, m in models.items() for i, share in enumerate(m.explained)]
    known = vectors.sparkSession.createDataFrame(table, "dim int, component int, explained double, identity_error double")
    each = transform(rows, models).select("vec_id", "dim", "n", "deviation", F.posexplode("whitened").alias("at", "w"))
    met = each.withColumn("component", F.col("at") + 1).join(F.broadcast(known), ["dim", "component"])
    return met.select("vec_id", "component", "n", "deviation", F.when(~F.isnan("w"), F.col("w")).alias("whitened"), "explained", "identity_error")
