"""Embedding whitening: vectors centred, turned to their main directions and scaled to unit variance.

The directions come from singular values that are merged up a tree. A task keeps of
its vectors their number, their exact sums and R = diag(singular values) x directions of the
centred vectors, all dimensions of it; two of these are merged by the singular values
of both R, one under the other, and one row more for the distance of the two means.
Nothing is lost by that: R'R is the scatter of all vectors about their common mean.
No vector is squared before it is centred, so a mean far from zero costs no digits,
and what travels is d x d numbers a task, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import column, materialize, ready, with_columns

#: Summaries that one task merges, at every level of the tree.
FAN_IN = 16
#: An entry becomes floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Vectors with an entry of this size or more take no part: their integers would leave what sums are exact in.
LARGEST = float(1 << 31)
_SUMMARY = "dim int, part long, n long, sums array<decimal(38,0)>, r array<double>"


def as_integers(vector_col: str) -> Column:
    """The vector as integers; null where it is null or holds an entry that is null, not finite or too large."""
    x = column(vector_col)
    fit = ~F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) >= LARGEST))
    return F.when(fit, F.transform(x, lambda v: F.floor(F.lit(float(SCALE)) * v.cast("double")) + F.lit(SHIFT).cast("long")))


@dataclass
class Summary:
    """n vectors: their exact sums, and R of their differences from their own mean."""

    n: int
    sums: list[int]
    r: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Summary:
        n, sums = len(x), [int(s) for s in x.sum(axis=0)]
        # the mean's whole part is taken away in whole numbers, so that only small differences are rounded
        centred = (x - np.array([s // n for s in sums])).astype(np.float64) - np.array([s % n / n for s in sums])
        return cls(n, sums, _kept(centred))

    def merged(self, other: Summary) -> Summary:
        n = self.n + other.n
        # the difference of the means in whole numbers, so that large sums cost no digits
        apart = np.array([float(other.n * a - self.n * b) / (self.n * other.n) for a, b in zip(self.sums, other.sums, strict=True)])
        row = apart * np.sqrt(self.n * other.n / n)
        return Summary(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], _kept(np.vstack([self.r, other.r, row])))


def _kept(rows: np.ndarray) -> np.ndarray:
    """diag(s) V' of rows = U diag(s) V': at most as many rows as dimensions."""
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * v


def _rows(held: dict[int, Summary], part: int) -> pd.DataFrame:
    out = [(dim, part, s.n, [Decimal(v) for v in s.sums], s.r.ravel().tolist()) for dim, s in held.items()]
    return pd.DataFrame(out, columns=["dim", "part", "n", "sums", "r"])


def _matrix(array: pa.ListArray) -> np.ndarray:
    """Vectors of one length as a matrix; null entries become nan."""
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), -1)


def _by_length(batch: pa.RecordBatch, vectors: pa.ListArray) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    sizes = np.diff(vectors.offsets.to_numpy())
    for dim in np.unique(sizes):
        if dim:
            at = pa.array(np.flatnonzero(sizes == dim))
            yield batch.take(at), _matrix(vectors.take(at))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, Summary] = {}
    for batch in batches:
        for _, x in _by_length(batch, batch.column(0)):
            one = Summary.of(x)
            held[x.shape[1]] = held[x.shape[1]].merged(one) if x.shape[1] in held else one
    schema = pa.schema([("dim", pa.int32()), ("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("r", pa.list_(pa.float64()))])
    yield from pa.Table.from_pandas(_rows(held, TaskContext.get().partitionId()), schema, preserve_index=False).to_batches()


def _merge_group(pdf: pd.DataFrame) -> pd.DataFrame:
    dim, out = int(pdf["dim"].iloc[0]), None
    for n, sums, r in zip(pdf["n"], pdf["sums"], pdf["r"], strict=True):
        one = Summary(int(n), [int(v) for v in sums], np.array(r, np.float64).reshape(-1, dim))
        out = one if out is None else out.merged(one)
    return _rows({dim: out}, int(pdf["part"].iloc[0]))


@dataclass
class Model:
    """What whitening needs for vectors of one length."""

    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues of the covariance, falling
    vectors: np.ndarray  # unit eigenvectors as rows
    explained: np.ndarray

    @property
    def rank(self) -> int:
        """Components whose variance is more than what rounding leaves."""
        s = np.sqrt(self.values)
        return int((s > s[:1].max(initial=0.0) * len(s) * 1e-14).sum()) if self.values.any() else 0

    def whitened(self, x: np.ndarray, components: int) -> np.ndarray:
        """x - S/n on each component, over its deviation; nan where a component has no variance."""
        k = min(components, len(self.values))
        high = np.array([s // self.n for s in self.sums])
        low = np.array([(s % self.n) / self.n for s in self.sums])
        centred = (x - high).astype(np.float64) - low
        e = np.where(np.arange(k) < self.rank, self.values[:k], np.nan)
        return centred @ self.vectors[:k].T / np.sqrt(e)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n * x - S)^2, exact; null where it is beyond a long."""
        s = np.array(self.sums, object)
        apart = self.n * x.astype(object) - s if self.n * int(np.abs(x).max(initial=0)) >= 1 << 62 or max(map(abs, self.sums)) >= 1 << 62 else self.n * x - s.astype(np.int64)
        if int(np.abs(apart).max(initial=0)) ** 2 * x.shape[1] >= 1 << 62:
            apart = apart.astype(object)
        return [v if v < 1 << 63 else None for v in (int(v) for v in (apart * apart).sum(axis=1))]


def fit(vectors: DataFrame, vector_col: str = "embedding") -> dict[int, Model]:
    """The model of all vectors that take part, for each length of vectors on its own.

    Every level of the tree merges FAN_IN summaries a task; the first one is stored, so
    that a lost executor costs no further read of the vectors. What comes to the driver
    is one summary for each length: d x d numbers. An empty table gives no model.
    """
    ready(vectors.sparkSession)
    rows = vectors.select(as_integers(vector_col).alias("x")).where("x IS NOT NULL")
    parts = materialize(rows.mapInArrow(_summaries, _SUMMARY), "summaries")
    while (parts.groupBy("dim").count().agg(F.max("count")).first()[0] or 0) > 1:
        # tasks that stand together: FAN_IN of them at most, whatever their vectors
        dealt = parts.withColumn("part", F.floor(F.col("part") / FAN_IN))
        parts = materialize(dealt.groupBy("dim", "part").applyInPandas(_merge_group, _SUMMARY), "merged")
    models = {}
    for r in parts.collect():  # one row a length
        found = np.array(r["r"]).reshape(-1, r["dim"])
        _, s, v = np.linalg.svd(np.vstack([found, np.zeros((max(0, r["dim"] - len(found)), r["dim"]))]), full_matrices=False)
        v *= np.where(v[np.arange(len(v)), np.abs(v).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
        values = s * s / r["n"]
        models[r["dim"]] = Model(r["n"], [int(x) for x in r["sums"]], values, v, values / values.sum() if values.any() else np.zeros(len(values)))
    return models


def whiten(vectors: DataFrame, models: dict[int, Model], components: int = 32, vector_col: str = "embedding") -> DataFrame:
    """``vectors`` with whitened (the first ``components``), explained (their shares of all variance), n, and deviation.

    ``deviation`` is the sum of (n * x - S)^2, exact, or null where that is beyond a long.

    Rows that take no part (see as_integers), and those of a length without a model, are
    left out. A component without variance gives null. All columns stay; the new ones take
    the place of columns of their names. Repeated rows give repeated results. Map-only.
    """
    ready(vectors.sparkSession)
    whole = F.struct(F.lit(None).cast("int").alias("none"), *(column(c) for c in vectors.columns))
    rows = vectors.select(whole.alias("row"), as_integers(vector_col).alias("x")).where("x IS NOT NULL")

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for part, x in _by_length(batch, batch.column(1)):
                if model := models.get(x.shape[1]):
                    w = model.whitened(x, components)
                    flat = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
                    white = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1]), pa.int32()), flat)
                    share = pa.ListArray.from_arrays(white.offsets, pa.array(np.tile(model.explained[: w.shape[1]], len(w))))
                    n, deviation = pa.array(np.full(len(w), model.n)), pa.array(model.deviation(x), pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column(0), white, share, n, deviation], names=["row", *new])

    new = {"whitened": ArrayType(DoubleType()), "explained": ArrayType(DoubleType()), "n": LongType(), "deviation": LongType()}
    schema = StructType([rows.schema["row"], *(StructField(c, kind) for c, kind in new.items())])
    return with_columns(rows.mapInArrow(batches, schema), vectors, {c: F.col(c) for c in new})


def identity_error(whitened: DataFrame) -> float:
    """The largest entry, in absolute value, of the whitened vectors' covariance minus the identity.

    Measured on the whitened vectors, not derived from the model: each task sums their
    products, the tasks' sums are added by place. Components without variance count as
    left out. 0 for an empty table; vectors of several lengths are judged each for itself.
    """

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for part, w in _by_length(batch, batch.column(0)):
                w = np.nan_to_num(w.astype(np.float64))
                n, sums, cross = held.get(w.shape[1], (0, 0.0, 0.0))
                held[w.shape[1]] = (n + len(w), sums + w.sum(axis=0), cross + w.T @ w)
        out = [(dim, i, j, n, sums[i], sums[j], cross[i, j]) for dim, (n, sums, cross) in held.items() for i in range(dim) for j in range(i + 1)]
        yield from pa.Table.from_pandas(pd.DataFrame(out, columns=names), schema, preserve_index=False).to_batches()

    names = ["dim", "i", "j", "n", "si", "sj", "c"]
    schema = pa.schema([("dim", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("n", pa.int64()), ("si", pa.float64()), ("sj", pa.float64()), ("c", pa.float64())])
    parts = whitened.select("whitened").mapInArrow(products, "dim int, i int, j int, n long, si double, sj double, c double")
    sums = parts.groupBy("dim", "i", "j").agg(F.sum("n").alias("n"), F.sum("si").alias("si"), F.sum("sj").alias("sj"), F.sum("c").alias("c"))
    entry = F.col("c") / F.col("n") - (F.col("si") / F.col("n")) * (F.col("sj") / F.col("n"))
    there = (F.col("i") != F.col("j")) | (entry != 0)
    return sums.where(there).agg(F.max(F.abs(entry - (F.col("i") == F.col("j")).cast("double")))).first()[0] or 0.0
