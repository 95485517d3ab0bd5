"""Picking one row per key.

``row_number() == 1`` is written as a window on purpose: Spark limits each map
task to one row per key before the exchange, so a key that holds a third of
all rows still sends only one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def first_per_key(df: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def top_per_key(df: DataFrame, keys: list[Column | str], order: list[Column | str], n: int, rank: str | None = None) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    name = rank or "_rn"
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def first_source(df: DataFrame, keys: list[str], source: str, preference: list[str]) -> DataFrame:
    """Per key, the row of the first source in preference order that has one."""
    order = F.array_position(F.array(*[F.lit(p) for p in preference]), F.col(source))
    return first_per_key(df.filter(F.col(source).isin(*preference)), keys, [order])


def union_by_query(results: list[DataFrame], path: str, order: list[str]) -> DataFrame:
    """Union of search results; the first query that found a path keeps it."""
    tagged = [r.withColumn("query_no", F.lit(i)) for i, r in enumerate(results)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return first_per_key(out, [path], ["query_no", *order])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same primary key."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    return first_per_key(both, keys, [F.desc("_v")]).drop("_v")
