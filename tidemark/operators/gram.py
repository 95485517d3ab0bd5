"""Ridge regression on walk-forward folds from additive blocks of cross-products.

The folds cut the ordered rows into at most 3 * folds + 1 blocks.  One scan
sums the cross-products of each block; the products of any fold's train or
validation rows are sums of blocks, so every fold, penalty and set of columns
is solved without reading the rows again.

A missing value is filled with the train median, which differs by fold.  The
products are therefore those of (1, value or 0, missing or not, target): with
a fold's medians m the filled value is value + m * missing, a linear map of
that row, and the map is applied to the products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .evaluation import fold_roles, group_quantiles, regression_metrics

FLAT = 1e-12  # a variance below this share of the overall one counts as none
MODEL = "fold int, features string, alpha double, n_train long, n_valid long, intercept double, coef array<double>, fill array<double>, sse double, sum_y double, sum_yy double"


def number(c: str) -> Column:
    """A finite double or null."""
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def fold_roles_of(panel: DataFrame, order: list[str], cols: list[str], n_splits: int, gap: int) -> DataFrame:
    """``fold_roles`` of the labelled rows, with the columns a model reads and no others."""
    return fold_roles(panel.filter(number("target").isNotNull()).select(*order, "target", *cols), order, n_splits, gap)


def units(rows: DataFrame, cols: list[str]) -> list[tuple[float, float]]:
    """(mean, deviation) of the known values of each column: units of the products only, each fold scales again."""
    row = rows.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in cols]).first()
    return [(r["m"] or 0.0, r["s"] or 1.0) for r in row]


def block_products(rows: DataFrame, cols: list[str], target: str, scale: list[tuple[float, float]]) -> DataFrame:
    """(roles, i, g): row i of the cross-products of every block of rows with equal roles.

    A partition sends one matrix per block it touches, 2 * columns + 2 wide;
    partitions of ordered rows touch one or two.
    """
    p = len(cols)
    shift, spread = (np.array(v) for v in zip(*scale))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            x = np.column_stack([batch.column(j).to_numpy(zero_copy_only=False) for j in range(p + 1)]).astype(float)
            v, y = (x[:, :p] - shift) / spread, x[:, p:]
            z = np.hstack([np.ones((len(x), 1)), np.nan_to_num(v, nan=0.0), np.isnan(v), y])
            blocks = np.array(batch.column(p + 1).to_pylist())
            for b in np.unique(blocks):
                part = z[blocks == b]
                sums[b] = sums.get(b, 0.0) + part.T @ part
        for b, g in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([b] * len(g)), pa.array(range(len(g)), pa.int32()), pa.array(list(g), pa.list_(pa.float64()))], ["block", "i", "g"])

    block = F.array_join("roles", ",", "-").alias("block")
    parts = rows.select(*cols, F.col(target).alias("_y"), block).mapInArrow(partial, "block string, i int, g array<double>")
    total = parts.groupBy("block", "i").agg(Summarizer.sum(array_to_vector("g")).alias("g"))
    return total.select(F.split("block", ",").alias("roles"), "i", "g")


def train_medians(rows: DataFrame, cols: list[str]) -> DataFrame:
    """(fold, feature, median) over each fold's train rows, exact."""
    long = rows.select(*cols, F.filter(F.transform("roles", lambda r, k: F.when(r == "train", k)), lambda k: k.isNotNull()).alias("_f")).unpivot(["_f"], cols, "feature", "v")
    counted = long.filter(F.col("v").isNotNull()).select(F.explode("_f").alias("fold"), "feature", "v")
    return group_quantiles(counted, ["fold", "feature"], "v", {"median": 0.5}).select("fold", "feature", "median")


def filled_folds(rows: DataFrame, cols: list[str], target: str, keys: list[str]) -> DataFrame:
    """(keys, fold, role, target, features): rows of every fold with its train medians filled in, 0 where it has none."""
    rows = rows.select(*keys, "roles", F.col(target).cast("double").alias("target"), *[number(c).alias(c) for c in cols])
    fill = train_medians(rows, cols).groupBy("fold").agg(F.map_from_entries(F.collect_list(F.struct("feature", "median"))).alias("_m"))  # one entry per column
    fill = fill.select("fold", F.transform(F.array(*[F.lit(c) for c in cols]), lambda c: F.coalesce(F.element_at("_m", c), F.lit(0.0))).alias("_m"))
    long = rows.select(*keys, "target", F.array(*cols).alias("_x"), F.posexplode("roles").alias("fold", "role")).filter(F.col("role").isNotNull())
    return long.join(fill, "fold").select(*keys, "fold", "role", "target", array_to_vector(F.zip_with("_x", "_m", lambda x, m: F.coalesce(x, m))).alias("features"))


def solve(train: np.ndarray, valid: np.ndarray, fill: np.ndarray, pick: np.ndarray, alphas: list[float]) -> Iterator[tuple]:
    """(alpha, intercept, coefficients, squared validation error) per penalty.

    One eigendecomposition of the correlations serves all penalties.  A column
    without a train value or without spread gets coefficient 0.
    """
    p = len(fill)
    lift = np.zeros((len(pick) + 2, len(train)))
    lift[0, 0] = lift[-1, -1] = 1.0
    at = np.arange(len(pick)) + 1
    lift[at, 1 + pick] = 1.0
    lift[at, 1 + p + pick] = fill[pick]
    a, v = lift @ train @ lift.T, lift @ valid @ lift.T
    n = a[0, 0]
    mean, mean_y = a[0, 1:-1] / n, a[0, -1] / n
    cov = a[1:-1, 1:-1] / n - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov), 0.0))
    flat = spread ** 2 <= FLAT
    scale = np.where(flat, 1.0, spread)
    cor = cov / np.outer(scale, scale)
    cor[flat], cor[:, flat] = 0.0, 0.0
    with_y = np.where(flat, 0.0, (a[1:-1, -1] / n - mean * mean_y) / scale)
    values, vectors = np.linalg.eigh(cor)
    along = vectors.T @ with_y
    for alpha in alphas:
        w = vectors @ (along * n / (np.maximum(values, 0.0) * n + alpha)) / scale
        b = mean_y - w @ mean
        e = np.concatenate([[-b], -w, [1.0]])  # error = e . (1, x, y)
        yield alpha, b, w, max(float(e @ v @ e), 0.0)


def ridge_folds(rows: DataFrame, cols: list[str], target: str, alphas: list[float], subsets: dict[str, list[str]] | None = None) -> DataFrame:
    """One ridge model per (fold, set of columns, penalty), with its validation error.

    ``rows`` come from ``fold_roles``; their target is not null.  Columns are
    filled with the train median and scaled to unit deviation, the intercept
    is free.  ``coef`` and ``fill`` are in the columns' own units and in the
    order of ``cols``; a column outside the set, without a train value or
    without spread has coefficient 0.  A fold without train or validation rows
    gives no model.  The largest object of a task is one fold's products,
    bounded by the number of columns.
    """
    rows = rows.select("roles", F.col(target).cast("double").alias("_target"), *[number(c).alias(c) for c in cols])
    scale = units(rows, cols)
    blocks = cut_lineage(block_products(rows, cols, "_target", scale))
    per = blocks.select(F.posexplode("roles").alias("fold", "role"), "i", "g").filter(F.col("role") != "-")
    per = per.groupBy("fold", "role", "i").agg(Summarizer.sum(F.col("g")).alias("g")).select("fold", "role", "i", vector_to_array("g").alias("g"))
    place = F.array_position(F.array(*[F.lit(c) for c in cols]), F.col("feature")).cast("int") - 1
    medians = train_medians(rows, cols).select("fold", F.lit("fill").alias("role"), place.alias("i"), F.array("median").alias("g"))
    sets = {name: np.array([cols.index(c) for c in names]) for name, names in (subsets or {"all": cols}).items()}
    shift, spread = (np.array(v) for v in zip(*scale))

    def fit(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        part = {r: g.sort_values("i") for r, g in t.groupby("role")}
        if "train" not in part or "valid" not in part:
            return pd.DataFrame(columns=[c.split()[0] for c in MODEL.split(", ")])
        train, valid = np.stack(part["train"]["g"].to_list()), np.stack(part["valid"]["g"].to_list())
        own = np.full(len(cols), np.nan)
        if "fill" in part:
            own[part["fill"]["i"].to_numpy()] = [g[0] for g in part["fill"]["g"]]
        known = ~np.isnan(own)
        fill = np.where(known, (own - shift) / spread, 0.0)
        out = []
        for name, pick in sets.items():
            pick = pick[known[pick]]
            for alpha, b, w, sse in solve(train, valid, fill, pick, alphas):
                coef = np.zeros(len(cols))
                coef[pick] = w / spread[pick]
                out.append((key[0], name, alpha, int(round(train[0, 0])), int(round(valid[0, 0])), b - coef @ shift, coef, np.where(known, own, 0.0), sse, valid[0, -1], valid[-1, -1]))
        return pd.DataFrame(out, columns=[c.split()[0] for c in MODEL.split(", ")])

    return cut_lineage(per.unionByName(medians).groupBy("fold").applyInPandas(fit, MODEL))


def pooled_scores(models: DataFrame) -> DataFrame:
    """R2 and RMSE over all folds' validation rows, from the products alone."""
    s = models.groupBy("features", "alpha").agg(F.sum("n_valid").alias("n"), F.sum("sse").alias("_e"), F.sum("sum_y").alias("_y"), F.sum("sum_yy").alias("_q"))
    spread = F.col("_q") - F.col("_y") * F.col("_y") / F.col("n")
    return s.select("features", "alpha", "n", F.when(spread > 0, 1 - F.col("_e") / spread).alias("r2"), F.sqrt(F.col("_e") / F.col("n")).alias("rmse"))


def ridge_predictions(rows: DataFrame, models: DataFrame, cols: list[str], target: str, keys: list[str]) -> DataFrame:
    """Validation rows with the prediction of every model of their fold."""
    valid = rows.select(*keys, F.col(target).cast("double").alias("y"), F.array(*[number(c) for c in cols]).alias("_x"), F.posexplode("roles").alias("fold", "_r")).filter(F.col("_r") == "valid")
    j = valid.join(models.select("fold", "features", "alpha", "intercept", "coef", "fill"), "fold")
    filled = F.zip_with("_x", "fill", lambda x, m: F.coalesce(x, m))
    dot = F.aggregate(F.zip_with(filled, "coef", lambda x, w: x * w), F.col("intercept"), lambda s, v: s + v)
    return j.select(*keys, "fold", "features", "alpha", "y", dot.alias("p"))


def ridge_scores(rows: DataFrame, cols: list[str], target: str, keys: list[str], alphas: list[float]) -> DataFrame:
    """(candidate, n, r2, rmse, mae) of every penalty, pooled over the folds."""
    pred = ridge_predictions(rows, ridge_folds(rows, cols, target, alphas), cols, target, keys)
    named = pred.withColumn("candidate", F.concat(F.lit("ridge_"), F.col("alpha").cast("string")))
    return regression_metrics(named, by="candidate").filter(F.col("candidate").isNotNull()).select("candidate", "n", "r2", "rmse", "mae")
