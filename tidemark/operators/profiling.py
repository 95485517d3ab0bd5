"""Everyday table jobs: profiling, imputing, encoding, neighbours."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .evaluation import group_quantiles
from .ranking import with_row


def null_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return counts.unpivot([], cols, "column_name", "n_null")


def impute(df: DataFrame, cols: list[str], how: str = "median") -> DataFrame:
    """Fill nulls with the column's exact median, mean or most frequent value."""
    long = df.select(*cols).unpivot([], cols, "_c", "_v").filter(F.col("_v").isNotNull())
    if how == "median":
        fill = group_quantiles(long, ["_c"], "_v", {"_fill": 0.5})
    elif how == "mean":
        fill = long.groupBy("_c").agg(F.avg("_v").alias("_fill"))
    elif how == "mode":
        counts = long.groupBy("_c", "_v").agg(F.count("*").alias("_n"))
        fill = counts.groupBy("_c").agg(F.max_by("_v", F.struct("_n", -F.col("_v"))).alias("_fill"))
    else:
        raise ValueError(f"unknown strategy {how}")
    row = fill.agg(*[F.max(F.when(F.col("_c") == c, F.col("_fill"))).alias(f"_f_{c}") for c in cols])
    filled = with_row(df, row)
    return filled.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_f_{c}")) for c in cols}).drop(*[f"_f_{c}" for c in cols])


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairwise Pearson correlations, all from one pass over the table."""
    pairs = [(a, b) for a in cols for b in cols]
    wide = df.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{i}`").alias("corr")) for i, (a, b) in enumerate(pairs)])
    return wide.select(F.inline(rows))


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles per column."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "column_name", "v")
    basic = long.groupBy("column_name").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    q = group_quantiles(long, ["column_name"], "v", {"q25": 0.25, "q50": 0.5, "q75": 0.75}).drop("n")
    return basic.join(q, "column_name")


def class_balance(df: DataFrame, klass: str) -> DataFrame:
    g = df.groupBy(klass).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))))  # one row per class


def one_hot(df: DataFrame, key: list[str], column: str, values: list[str]) -> DataFrame:
    """0/1 column per known value; an unknown value is all zeros."""
    return df.select(*key, *[F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in values])


def document_frequency(docs: DataFrame, tokens: Column, min_df: int = 1, max_share: float = 1.0) -> DataFrame:
    """Terms with document frequency and total count inside the bounds."""
    t = docs.select(F.explode(tokens).alias("term"), "doc_id")
    per = t.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    df = per.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    if max_share < 1.0:
        df = with_row(df, docs.agg(F.count("*").alias("_n"))).filter(F.col("df") <= F.col("_n") * max_share).drop("_n")
    return df.filter(F.col("df") >= min_df)


def pca_project(df: DataFrame, key: list[str], column: str, k: int = 2) -> DataFrame:
    """First principal components of centred vectors."""
    v = df.select(*key, array_to_vector(F.col(column).cast("array<double>")).alias("_v"))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(v)
    mean = v.select(F.posexplode(vector_to_array("_v")).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
    centre = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("_m"))
    centred = with_row(v, centre)
    centred = centred.select(*key, array_to_vector(F.zip_with(vector_to_array("_v"), "_m", lambda a, b: a - b)).alias("_v"))
    out = model.transform(centred).select(*key, vector_to_array("_p").alias("_p"))
    return out.select(*key, *[F.get("_p", F.lit(i)).alias(f"pc{i + 1}") for i in range(k)])
