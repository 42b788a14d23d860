"""Embedding whitening by a covariance of two passes over whole-number vectors.

An entry c becomes x = floor(64 * c) + 1000000. Rows whose vector is null, or has a null or non-finite entry or one
beyond 64 bits, are dropped, and so are vectors of another length than most distinct ones have (the longer of two
lengths that are as frequent). The model is fitted on each distinct x vector once: a first pass sums x exactly, a second
multiplies what is left after the mean (split into its whole part and the rest, so that nothing is rounded before the
centring), a matrix product for each batch; partial sums meet in a tree, and the driver holds two of them, dimension
squared in size whatever the number of rows. A third pass measures the covariance of what the projection gives.

Repeated rows weigh once in the fit and are all returned. Components without variance (fewer distinct vectors than
dimensions, or constant ones) have null coordinates and are left out of the measured error. A deviation of more than
38 digits is null. An empty table gives an empty model and no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, stored, unused

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Entries times SCALE below this fit 64 bits, also once they are shifted.
_LIMIT = float(1 << 62)


@dataclass
class Model:
    """``sums`` are exact; ``projection`` has a column for each component, of zeros where there is no variance."""

    n: int
    sums: list[int]
    values: list[float]
    trace: float
    projection: np.ndarray
    identity_error: float

    @property
    def explained(self) -> list[float | None]:
        return [v / self.trace if self.trace > 0 else None for v in self.values]


def usable(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double") * SCALE) < _LIMIT)), F.lit(False))


def whole(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long"))


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a batch, one a row."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Centre:
    """Takes the mean from vectors: first its whole part, in whole numbers, then the rest."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.floor = np.array([s // n for s in sums], dtype=np.int64)
        self.rest = [s % n for s in sums]
        self.fraction = np.array([r / n for r in self.rest])
        self.n = n

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.floor).astype(np.float64) - self.fraction

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sums of (n x - S) squared, exact: in 64 bits where they fit, else in whole numbers of any size."""
        off = x - self.floor
        most = self.n * (int(np.abs(off).max(initial=0)) + 1)
        if most * most * max(1, x.shape[1]) < 1 << 63:
            return pa.array(((self.n * off - np.array(self.rest, dtype=np.int64)) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
        totals = ((off.astype(object) * self.n - np.array(self.rest, dtype=object)) ** 2).sum(axis=1).tolist()
        return pa.array([Decimal(v) if v < 10**38 else None for v in totals], pa.decimal128(38, 0))


def _depth(rows: RDD) -> int:
    """Levels of the tree: some 32 partial sums meet in one task."""
    return max(2, int(np.ceil(np.log(max(2, rows.getNumPartitions())) / np.log(32))))


def exact_sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """How many vectors there are, and their sum; upper and lower halves are added apart, so 64 bits hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for batch in batches:
            x = matrix(batch.column(0))
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([high.tolist()], pa.list_(pa.int64())), pa.array([low.tolist()], pa.list_(pa.int64()))], names=["n", "high", "low"])

    def add(total: tuple[int, list[int]], row: Row) -> tuple[int, list[int]]:
        return total[0] + row["n"], [s + (h << 32) + v for s, h, v in zip(total[1], row["high"], row["low"], strict=True)]

    def merge(a: tuple[int, list[int]], b: tuple[int, list[int]]) -> tuple[int, list[int]]:
        return a[0] + b[0], [x + y for x, y in zip(a[1], b[1], strict=True)]

    rows = fit.mapInArrow(run, "n long, high array<long>, low array<long>").rdd
    return rows.treeAggregate((0, [0] * dim), add, merge, _depth(rows))


def outer_products(fit: DataFrame, centre: Centre, projection: np.ndarray | None = None) -> np.ndarray:
    """The sum of outer products of the centred vectors, or of what the projection makes of them."""
    width = len(centre.floor) if projection is None else projection.shape[1]
    shared = fit.sparkSession.sparkContext.broadcast((centre, projection))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, projection = shared.value
        total = np.zeros((width, width))
        for batch in batches:
            c = centre.centred(matrix(batch.column(0)))
            c = c if projection is None else c @ projection
            total += c.T @ c
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    def add(total: np.ndarray, row: Row) -> np.ndarray:
        return total + np.frombuffer(row["total"]).reshape(width, width)

    rows = fit.mapInArrow(run, "total binary").rdd
    out = rows.treeAggregate(np.zeros((width, width)), add, np.add, _depth(rows))
    shared.destroy()
    return out


def fit(df: DataFrame, vector: str, components: int = COMPONENTS) -> Model:
    """Mean, eigenvectors and eigenvalues of the distinct vectors of ``df``."""
    rows = df.select(F.col(vector).alias("v")).where(usable(F.col("v"))).select(whole(F.col("v")).alias("x"))
    distinct = stored(rows.distinct().select("x", F.size("x").alias("dim")), "vectors")
    lengths = distinct.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = lengths["dim"] if lengths else 0
    if not dim:
        forget(distinct)
        return Model(0, [], [], 0.0, np.zeros((0, 0)), 0.0)
    used = distinct.where(F.col("dim") == dim).select("x")
    n, sums = exact_sums(used, dim)
    centre = Centre(n, sums)
    covariance = outer_products(used, centre) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    live = values > max(float(values[0]), 0.0) * dim * 4 * np.finfo(float).eps
    projection = np.where(live, vectors / np.sqrt(np.where(live, values, 1.0)), 0.0)
    error = 0.0
    if live.any():
        error = float(np.abs(outer_products(used, centre, projection[:, live]) / n - np.eye(int(live.sum()))).max())
    forget(distinct)
    return Model(n, sums, [float(v) if ok else 0.0 for v, ok in zip(values, live, strict=True)], float(np.trace(covariance)), projection, error)


def transform(df: DataFrame, vector: str, model: Model) -> DataFrame:
    """The rows that the model holds for, with ``deviation`` (sum of (n x - S) squared, whole) and ``whitened``.

    Input columns with these names are replaced, after the vector has been read; all others stay.
    """
    x = unused(df, "whole_vector")
    added = [T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))]
    rows = df.where(usable(F.col(vector)) & (F.size(vector) == len(model.sums)) & F.lit(model.n > 0)).withColumn(x, whole(F.col(vector)))
    rows = rows.drop("deviation", "whitened")
    names = [c for c in rows.columns if c != x]
    schema = T.StructType([*rows.drop(x).schema.fields, *added])
    shared = df.sparkSession.sparkContext.broadcast((Centre(model.n, model.sums) if model.n else None, model.projection, [v > 0 for v in model.values]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, projection, live = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            at = matrix(batch.column(x))
            w = centre.centred(at) @ projection
            dead = np.broadcast_to(~np.array(live, dtype=bool), w.shape)
            flat = pa.array(w.ravel(), mask=dead.ravel())
            whitened = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * w.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), centre.deviations(at), whitened], names=schema.names)

    return rows.mapInArrow(run, schema)
