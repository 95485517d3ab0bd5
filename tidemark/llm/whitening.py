"""Embedding whitening with multiplicities: equal vectors are one row with a weight, fitted and whitened once.

Vectors are taken on a grid of whole numbers, x = floor(scale * c) + shift, so
that equal ones meet exactly and sums are exact.  The covariance is a weighted
centred product over the distinct vectors, with counts or one as weights; every
distinct vector is projected once and joined back to its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.llm import common as c

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Scaled entries beyond it are taken as it: doubles there are no finer than whole numbers.
LIMIT = float(1 << 52)
#: Rows of one product.
BLOCK = 4096
#: An eigenvalue of less than this share of the largest is none.
RANK = 1e-13


def whole(vector: Column, scale: int, shift: int) -> Column:
    grid = lambda v: F.greatest(F.least(F.lit(float(scale)) * v.cast("double"), F.lit(LIMIT)), F.lit(-LIMIT))
    return F.transform(vector, lambda v: F.floor(grid(v)) + F.lit(shift).cast("bigint"))


def usable(vector: Column) -> Column:
    """Neither null nor with an entry that is null or not finite."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda v: F.coalesce(finite(v.cast("double")), F.lit(False))), F.lit(False))


def matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    column = batch.column(name)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, BLOCK):
            yield b.slice(k, BLOCK)


@dataclass
class Model:
    """Exact sums of the fit list, and unit components by falling eigenvalue."""
    n: int                   # weight of the fit list
    sums: list[int]          # weighted sum of each dimension
    components: np.ndarray   # (dimension x components), columns
    eigenvalues: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) if self.trace > 0 else 0.0 for e in self.eigenvalues]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n: the whole part is subtracted exactly, so large shifts cost no digits."""
        whole_part = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole_part).astype(np.float64) - rest

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Projections over the root of the eigenvalue; 0 for a component without variance."""
        root = np.sqrt(self.eigenvalues)
        return self.centred(x) @ self.components / np.where(root > 0, root, np.inf)

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n x - sums)^2, exact."""
        if not x.size:
            return [0] * len(x)
        largest = max(max(abs(self.n * int(m) - s) for m, s in zip(side, self.sums)) for side in (x.min(axis=0), x.max(axis=0)))
        kind = np.int64 if largest ** 2 * x.shape[1] < 1 << 63 and max(abs(int(x.max())), abs(int(x.min()))) * self.n < 1 << 62 else object
        d = x.astype(kind) * self.n - np.array(self.sums, kind)
        return [int(v) for v in (d * d).sum(axis=1)]


def summed(parts: DataFrame, kind: str) -> list:
    """The position-wise sums of an array column ``v``, a row per task; as many numbers as positions reach the driver."""
    rows = parts.select(F.posexplode("v").alias("k", "v")).groupBy("k").agg(F.sum(F.col("v").cast(kind)).alias("v")).collect()
    return [r["v"] for r in sorted(rows, key=lambda r: r["k"])]


def second_moments(weighted: DataFrame, width: int, centre, column: str) -> np.ndarray:
    """Sum over the rows of w v v', v being ``centre`` of a column."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in blocks(batches):
            v = centre(matrix(b, column))
            w = b.column("w").to_numpy(zero_copy_only=False).astype(np.float64)
            total += (v * w[:, None]).T @ v
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["v"])
    got = summed(weighted.select(column, "w").mapInArrow(task, c.struct(("v", T.ArrayType(c.DOUBLE)))), "double")
    return np.array(got).reshape(width, width) if got else np.zeros((width, width))


def distinct_vectors(rows: DataFrame, weight: str) -> DataFrame:
    """(x, w): each distinct x once, with its count or one; counted before the exchange, so a hot vector costs a row per task."""
    if weight not in ("count", "one"):
        raise ValueError("the weight is 'count' or 'one'")
    return rows.groupBy("x").agg(F.count("*").alias("w") if weight == "count" else F.lit(1).cast("bigint").alias("w"))


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Model | None:
    """The model of a table (x, w); None for an empty one.  The driver gets d sums and d x d products."""
    width = distinct.select(F.size("x").alias("d")).limit(1).collect()
    if not width:
        return None
    d = width[0]["d"]

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * d, 0
        for b in blocks(batches):
            x, w = matrix(b), b.column("w").to_numpy(zero_copy_only=False).astype(np.int64)
            n += int(w.sum())
            bound = int(np.abs(x).max(initial=0)) * int(w.sum())
            part = (x * w[:, None]).sum(axis=0) if bound < 1 << 62 else (x.astype(object) * w[:, None].astype(object)).sum(axis=0)
            total = [a + int(p) for a, p in zip(total, part)]
        yield pa.RecordBatch.from_arrays([pa.array([[str(v) for v in (n, *total)]], pa.list_(pa.string()))], ["v"])
    got = [int(v) for v in summed(distinct.mapInArrow(totals, c.struct(("v", T.ArrayType(c.STRING)))), "decimal(38,0)")]
    model = Model(got[0], got[1:], np.zeros((d, 0)), np.zeros(0), 0.0)
    v = second_moments(distinct, d, model.centred, "x") / model.n
    values, vectors = np.linalg.eigh((v + v.T) / 2) if d else (np.zeros(0), np.zeros((0, 0)))
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = values[order], vectors[:, order]
    values = np.where(values > RANK * max(values[0], 0) if len(values) else values, values, 0.0)
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]) if d else np.ones(0)
    return Model(model.n, model.sums, vectors * np.where(sign == 0, 1, sign), values, float(np.trace(v)))


def project(distinct: DataFrame, model: Model) -> DataFrame:
    """(x, w, z, deviation): every distinct vector whitened once; the deviation is a whole number as text."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            x = matrix(b)
            cols = [b.column("x"), b.column("w"), pa.array(model.whiten(x).tolist(), pa.list_(pa.float64())), pa.array([str(v) for v in model.deviation(x)], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["x", "w", "z", "deviation"])
    return distinct.mapInArrow(task, c.struct(("x", T.ArrayType(c.LONG)), ("w", c.LONG), ("z", T.ArrayType(c.DOUBLE)), ("deviation", c.STRING)))


def identity_error(projected: DataFrame, model: Model) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, over components with variance."""
    keep = np.flatnonzero(model.eigenvalues > 0)
    if not len(keep):
        return 0.0
    k = len(model.eigenvalues)
    mean = np.array(summed(projected.select(F.transform("z", lambda z: z * F.col("w")).alias("v")), "double")) / model.n
    got = second_moments(projected, k, lambda z: z - mean, "z") / model.n
    return float(np.abs(got[np.ix_(keep, keep)] - np.eye(len(keep))).max())


RESULT = (("component", c.INT), ("n", c.LONG), ("deviation", T.DecimalType(38, 0)), ("whitened", c.DOUBLE), ("explained", c.DOUBLE), ("identity_error", c.DOUBLE))


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, weight: str = "count", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row per usable vector and component.

    Rows whose vector is null or holds a null or a number that is not finite
    are left out; so are vectors of another length than the most frequent one
    (of equally frequent ones the longest).  ``n`` is the weight of the fit
    list and ``deviation`` the exact sum of (n x - sums)^2, null beyond 38
    digits.  Scaled entries beyond 2^52 count as 2^52.  A component
    without variance has whitened 0; vectors of length 0 have no component.
    Components are numbered from 1 by falling eigenvalue; the entry of largest
    size is positive.  Repeated rows and null ids give a result each; an empty
    table an empty one; other columns are not read.
    """
    rows = c.only(df, id=id_col, v=vector_col).filter(usable(F.col("v")))
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), F.desc("d")).limit(1).collect()
    rows = rows.filter(F.size("v") == (common[0]["d"] if common else 0)).select("id", whole(F.col("v"), scale, shift).alias("x"))
    distinct = c.written(distinct_vectors(rows, weight))
    model = fit(distinct, components)
    kind = c.struct(("id", c.column_type(rows, "id")), *RESULT)
    if model is None or not len(model.eigenvalues):
        return df.sparkSession.createDataFrame([], kind)
    projected = c.written(project(distinct, model))
    error = identity_error(projected, model)
    share = F.array(*[F.lit(e) for e in model.explained])
    joined = rows.join(projected.select("x", "z", "deviation"), "x")
    out = joined.select("id", F.col("deviation").try_cast("decimal(38,0)").alias("deviation"), F.posexplode("z").alias("k", "whitened"))
    return out.select("id", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", F.get(share, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))
