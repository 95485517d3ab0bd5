"""Linear algebra on sparse rows: truncated SVD and ridge regression.

A matrix is a DataFrame with one row per document, ``idx`` the sorted column
numbers and ``val`` the values.  The only step over the rows is
``x -> AᵀA x`` for a block of vectors: a task adds up the product of its own
rows and sends the columns it touched.  Vectors as long as the vocabulary lie
on the driver; the vocabulary is bounded by a parameter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage

EXTRA = 10  # vectors beyond the components asked for
DEPTH = 8   # blocks of the subspace before it is restarted
CHUNK = 256      # columns summed as one vector between tasks
RANGE = 1 << 16  # entries multiplied at a time


def sparse_rows(long: DataFrame, keys: DataFrame, key: str, term: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(rows, vocabulary) of a long table of at most one value per (key, term).

    The vocabulary numbers the terms in their order.  Every key of ``keys``
    has a row, empty when it has no term; a row is at most as long as the
    vocabulary.
    """
    terms = sorted(r[0] for r in long.select(term).distinct().collect())  # bounded by the vocabulary parameter
    spark = long.sparkSession
    vocab = spark.createDataFrame([(t, i) for i, t in enumerate(terms)], f"{term} string, i int")
    entry = F.array_sort(F.collect_list(F.struct("i", F.col(value).cast("double").alias("v"))))
    packed = long.join(vocab, term).groupBy(key).agg(entry.alias("_e"))
    none = F.array().cast("array<struct<i:int,v:double>>")
    rows = keys.select(key).join(packed, key, "left").withColumn("_e", F.coalesce("_e", none))
    return cut_lineage(rows.select(key, F.col("_e.i").alias("idx"), F.col("_e.v").alias("val"))), vocab


def batch_matrix(batch: pa.RecordBatch, name_i: str = "idx", name_v: str = "val") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the entries of an Arrow batch."""
    idx = batch.column(batch.schema.get_field_index(name_i))
    size = np.diff(idx.offsets.to_numpy())
    values = batch.column(batch.schema.get_field_index(name_v)).flatten().to_numpy()
    return np.repeat(np.arange(len(size)), size), idx.flatten().to_numpy(), values


def added(out: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """Adds rows of values to ``out`` at sorted places."""
    if len(at):
        start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        out[at[start]] += np.add.reduceat(values, start, axis=0)


def times(row: np.ndarray, col: np.ndarray, val: np.ndarray, n: int, x: np.ndarray) -> np.ndarray:
    """A x for the n rows of a batch, entry ranges at a time."""
    out = np.zeros((n, x.shape[1]))
    for lo in range(0, len(row), RANGE):
        part = slice(lo, lo + RANGE)
        added(out, row[part], val[part, None] * x[col[part]])
    return out


def back(row: np.ndarray, col: np.ndarray, val: np.ndarray, y: np.ndarray, out: np.ndarray) -> None:
    """Adds Aᵀ y of a batch to ``out``."""
    for lo in range(0, len(row), RANGE):
        part = lo + np.argsort(col[lo:lo + RANGE], kind="stable")
        added(out, col[part], val[part, None] * y[row[part]])


def blocks(total: np.ndarray) -> pa.RecordBatch:
    """(i, y): the blocks of CHUNK columns that a task touched."""
    padded = np.vstack([total, np.zeros((-len(total) % CHUNK, total.shape[1]))]).reshape(-1, CHUNK * total.shape[1])
    at = np.flatnonzero(padded.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(list(padded[at]), pa.list_(pa.float64()))], ["i", "y"])


def gathered(parts: DataFrame, width: int, size: int) -> np.ndarray:
    """Sum of the tasks' blocks as a size x width array."""
    total = np.zeros((-(-size // CHUNK), CHUNK * width))
    t = parts.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("y"))).alias("y")).toArrow()  # one row per block of terms
    if t.num_rows:
        total[t["i"].to_numpy()] = t["y"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
    return total.reshape(-1, width)[:size]


def normal_product(rows: DataFrame, x: np.ndarray) -> np.ndarray:
    """AᵀA x."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(x)
        for batch in batches:
            row, col, val = batch_matrix(batch)
            back(row, col, val, times(row, col, val, batch.num_rows, x), total)
        yield blocks(total)

    tasks = rows.coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism).select("idx", "val")
    return gathered(tasks.mapInArrow(partial, "i int, y array<double>"), x.shape[1], x.shape[0])


def target_sums(rows: DataFrame, size: int, y: str) -> np.ndarray:
    """Aᵀ1 and Aᵀy as a size x 2 block."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, 2))
        for batch in batches:
            row, col, val = batch_matrix(batch)
            t = batch.column(2).to_numpy(zero_copy_only=False)
            back(row, col, val, np.column_stack([np.ones(len(t)), t]), total)
        yield blocks(total)

    return gathered(rows.select("idx", "val", F.col(y).cast("double")).mapInArrow(partial, "i int, y array<double>"), 2, size)


def dense_products(rows: DataFrame, folds: int, stride: int, first: int) -> np.ndarray:
    """(folds x width x width): AᵀA of the columns from ``first`` on of every fold, width = stride - first."""
    width = stride - first

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((folds, width, width))
        for batch in batches:
            row, col, val = batch_matrix(batch)
            dense = np.flatnonzero(col % stride >= first)
            row, col, val = row[dense], col[dense], val[dense]
            for f in np.unique(col // stride):
                here = col // stride == f
                at, r = np.unique(row[here], return_inverse=True)
                for lo in range(0, len(at), CHUNK):
                    part = slice(*np.searchsorted(r, [lo, lo + CHUNK]))  # entries of a row are together
                    x = np.zeros((min(CHUNK, len(at) - lo), width))
                    x[r[part] - lo, col[here][part] % stride - first] = val[here][part]
                    total[f] += x.T @ x
        yield blocks(total.reshape(folds * width, width))

    tasks = rows.coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism).select("idx", "val")
    return gathered(tasks.mapInArrow(partial, "i int, y array<double>"), width, folds * width).reshape(folds, width, width)


class SparseRidge:
    """Ridge regressions of many folds and sets of columns by conjugate gradients.

    Column c of fold f is number f * stride + c, so the folds' train rows form
    one matrix and a step of every system is one pass over it.  ``masks`` has
    a row per column of a fold and a column per set: the columns of the set.
    The intercept is free: products are those of centred columns, by
    AᵀA x - n mean (mean . x).  Every system ends with a residual of at most
    ``tol`` of its right side.  Columns of a fold from ``dense`` on are few and
    correlated: their own system, of as many rows as columns, is solved exactly
    in each step, which leaves the steps to what lies between them and the
    other columns.
    """

    def __init__(self, alpha: float, tol: float = 1e-9, max_steps: int = 2000):
        self.alpha, self.tol, self.max_steps = alpha, tol, max_steps

    def fit(self, rows: DataFrame, y: str, folds: list[int], stride: int, masks: np.ndarray, dense: int | None = None) -> "SparseRidge":
        """``rows``: (fold, idx, val, y) of train rows; a fold without rows predicts null."""
        sizes = {r["fold"]: (r["n"], r["s"]) for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum(F.col(y).cast("double")).alias("s")).collect()}  # one row per fold
        n_folds, sets = max(folds) + 1, masks.shape[1]
        n, total = (np.array([sizes.get(f, (0, 0.0))[j] for f in range(n_folds)], dtype=float) for j in (0, 1))
        shape = (n_folds, stride, sets)
        per = lambda a, b: np.einsum("fcs,fcs->fs", a, b)
        sums = target_sums(rows, n_folds * stride, y).reshape(n_folds, stride, 2)
        with np.errstate(invalid="ignore"):
            mean, mean_y = sums[:, :, :1] / np.maximum(n, 1)[:, None, None], total / n
        right = (sums[:, :, 1:] - mean * total[:, None, None]) * masks
        near = self.solver(rows, n, mean, masks, dense)
        w, rest = np.zeros(shape), right.copy()
        way, size, goal = near(rest), per(rest, rest), self.tol ** 2 * per(right, right)
        gain = per(rest, way)
        self.steps = 0
        while (live := size > goal).any():
            if self.steps == self.max_steps:
                raise RuntimeError("the regression did not settle")
            self.steps += 1
            way = way * live[:, None, :]
            image = normal_product(rows, way.reshape(-1, sets)).reshape(shape)
            image = (image - mean * (n[:, None] * per(np.broadcast_to(mean, shape), way))[:, None, :] + self.alpha * way) * masks
            step = np.where(live, gain / np.where(live, per(way, image), 1.0), 0.0)
            w += step[:, None, :] * way
            rest -= step[:, None, :] * image
            ahead = near(rest)
            new = per(rest, ahead)
            way = ahead + np.where(live, new / np.where(live, gain, 1.0), 0.0)[:, None, :] * way
            gain, size = np.where(live, new, gain), np.where(live, per(rest, rest), size)
        self.stride, self.coef = stride, w
        self.intercept = mean_y[:, None] - per(np.broadcast_to(mean, shape), w)
        self.residual = np.sqrt(size / np.maximum(per(right, right), 1e-300))
        return self

    def solver(self, rows: DataFrame, n: np.ndarray, mean: np.ndarray, masks: np.ndarray, dense: int | None) -> Callable[[np.ndarray], np.ndarray]:
        """The map that solves each fold's dense columns, by fold and set, and leaves the others but for the penalty."""
        folds, stride = mean.shape[:2]
        width = 0 if dense is None else stride - dense
        if not width:
            return lambda rest: rest
        products = dense_products(rows, folds, stride, dense)
        m = mean[:, dense:, 0]
        products -= n[:, None, None] * m[:, :, None] * m[:, None, :]
        inverse = np.zeros((folds, masks.shape[1], width, width))
        for s in range(masks.shape[1]):
            on = np.flatnonzero(masks[dense:, s])
            for f in range(folds):
                inverse[f, s][np.ix_(on, on)] = np.linalg.inv(products[f][np.ix_(on, on)] + self.alpha * np.eye(len(on)))

        def near(rest: np.ndarray) -> np.ndarray:
            return np.concatenate([rest[:, :dense] / self.alpha, np.einsum("fsab,fbs->fas", inverse, rest[:, dense:])], axis=1)
        return near

    def transform(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """(keep, fold, p): the predictions of every set for each row's fold."""
        w, b = self.coef.reshape(-1, self.coef.shape[2]), self.intercept

        def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, col, val = batch_matrix(batch)
                fold = batch.column(len(keep)).to_numpy(zero_copy_only=False)
                p = times(row, col, val, batch.num_rows, w) + b[fold]
                yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep) + 1], pa.array(list(p), pa.list_(pa.float64()))], [*keep, "fold", "p"])

        schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [*keep, "fold"])
        return rows.select(*keep, "fold", "idx", "val").mapInArrow(predict, schema + ", p array<double>")


def orthonormal(w: np.ndarray, basis: np.ndarray | None, floor: float) -> np.ndarray:
    """Directions of ``w`` outside ``basis``, those longer than ``floor``."""
    for _ in range(2):  # the second pass removes what rounding left
        if basis is not None:
            w = w - basis @ (basis.T @ w)
    u, s, _v = np.linalg.svd(w, full_matrices=False)
    return u[:, s > floor]


class SparseSVD:
    """Leading singular values and right vectors of sparse rows.

    At most ``k`` components, fewer when the vocabulary has fewer than k + 1
    terms, at least one.  A block Krylov subspace of AᵀA: each step multiplies
    the newest block, removes the directions already there and solves the
    small projected problem; after DEPTH blocks the subspace starts again from
    its best vectors.  It ends when every wanted pair is exact to ``tol`` of
    the largest eigenvalue, or the subspace cannot grow.  Components beyond
    the rank have singular value 0; without any term the only one is 0.
    """

    def __init__(self, k: int = 24, tol: float = 1e-7, max_steps: int = 200, seed: int = 0):
        self.k, self.tol, self.max_steps, self.seed = k, tol, max_steps, seed

    def fit(self, rows: DataFrame, n_terms: int) -> "SparseSVD":
        k = max(1, min(self.k, n_terms - 1))
        self.steps, block = 0, min(n_terms, k + EXTRA)
        values, vectors = np.zeros(0), np.zeros((n_terms, 0))
        start = np.random.default_rng(self.seed).normal(size=(n_terms, block))
        basis = newest = orthonormal(start, None, 0.0)
        image = np.zeros((n_terms, 0))
        while newest.shape[1] and self.steps < self.max_steps:
            image = np.hstack([image, normal_product(rows, newest)])
            self.steps += 1
            small = basis.T @ image
            values, turn = np.linalg.eigh((small + small.T) / 2)
            values, turn = values[::-1], turn[:, ::-1]
            vectors = basis @ turn
            rest = image @ turn[:, :k] - vectors[:, :k] * values[:k]
            scale = max(values[0], 0.0)
            if np.linalg.norm(rest, axis=0).max() <= self.tol * scale:
                break
            grown = image[:, -newest.shape[1]:]
            if basis.shape[1] >= DEPTH * block:
                basis, image = vectors[:, :block], image @ turn[:, :block]
                grown = image - basis * values[:block]
            newest = orthonormal(grown, basis, 1e-12 * max(scale, 1e-300))
            basis = np.hstack([basis, newest])
        else:
            if newest.shape[1]:
                raise RuntimeError("the singular vectors did not settle")
        self.singular, self.components = np.zeros(k), np.zeros((n_terms, k))
        n = min(k, len(values))
        self.singular[:n] = np.sqrt(np.maximum(values[:n], 0.0))
        self.components[:, :n] = vectors[:, :n]
        sign = np.sign(self.components[np.abs(self.components).argmax(axis=0), np.arange(k)]) if n_terms else np.ones(k)
        self.components *= np.where(sign == 0, 1.0, sign)  # the largest entry is positive
        return self

    def transform(self, rows: DataFrame, key: str, out: str = "svd") -> DataFrame:
        """(key, out): the components of every row; a row without terms is 0."""
        comps = self.components

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, col, val = batch_matrix(batch)
                y = times(row, col, val, batch.num_rows, comps)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(y), pa.list_(pa.float64()))], [key, out])

        kind = rows.schema[key].dataType.simpleString()
        return rows.select(key, "idx", "val").mapInArrow(project, f"`{key}` {kind}, {out} array<double>")
