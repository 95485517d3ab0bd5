"""Exact positions over whole tables without a one-task window.

``sorted_positions`` numbers rows after a distributed sort: the sort keys end
in a unique column, so the range partitions are even even when one key holds a
third of the rows.  The sorted rows are written to the shared checkpoint
folder first, because positions need every reader to see the same partitions.

``hash_positions`` numbers rows in md5 order in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage

_LOW = (1 << 33) - 1


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Adds the columns of a one-row table as a scalar subquery."""
    value = row.select(F.struct("*").alias("_row_")).scalar()
    return df.withColumn("_row_", value).select("*", "_row_.*").drop("_row_")


def _numbered(df: DataFrame, order: list) -> DataFrame:
    s = cut_lineage(df.orderBy(*order))
    s = s.withColumn("_id", F.monotonically_increasing_id())
    return s.select("*", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(F.lit(_LOW)).alias("_row")).drop("_id")


def _before(sizes: DataFrame, value: str, out: str) -> DataFrame:
    """Exclusive running total over partitions: one row per sort partition."""
    w = W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    return sizes.select("_part", F.coalesce(F.sum(value).over(w), F.lit(0)).alias(out))


def sorted_positions(df: DataFrame, groups: list[str], order: list, position: str = "pos", size: str = "n") -> DataFrame:
    """0-based position of every row inside its group, and the group size.

    ``order`` must end in a unique column.
    """
    s = _numbered(df, [*groups, *order])
    offsets = _before(s.groupBy("_part").agg(F.count("*").alias("_c")), "_c", "__off")
    placed = s.join(offsets, "_part").withColumn("__at", F.col("__off") + F.col("_row")).drop("_part", "_row", "__off")
    extent = placed.groupBy(*groups).agg(F.min("__at").alias("__start"), F.count("*").alias(size))
    joined = placed.join(extent, groups) if groups else with_row(placed, extent)
    return joined.withColumn(position, F.col("__at") - F.col("__start")).drop("__at", "__start")


def running_total(df: DataFrame, order: list, values: dict[str, str]) -> DataFrame:
    """Exclusive running totals of columns over a whole table in ``order``."""
    s = _numbered(df, order)
    sizes = s.groupBy("_part").agg(*[F.sum(v).alias(v) for v in values])
    w = W.partitionBy("_part").orderBy("_row").rowsBetween(W.unboundedPreceding, -1)
    out = s.select("*", *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(name) for v, name in values.items()])
    for v, name in values.items():
        out = out.join(_before(sizes, v, "_off"), "_part").withColumn(name, F.col(name) + F.col("_off")).drop("_off")
    return out.drop("_part", "_row")


def with_previous(df: DataFrame, groups: list[str], order: list, cols: list[str], out: str = "prev") -> DataFrame:
    """Each row with the row before it in its group, as a struct.

    The lag runs inside the sorted partitions; the first row of a partition
    takes the last row of the nearest earlier one, from a table with one row
    per partition.  A group that holds most rows is spread like any other.
    """
    s = _numbered(df, [*groups, *order])
    packed = F.struct(*[F.col(c) for c in dict.fromkeys([*groups, *cols])])
    s = s.withColumn("__in", F.lag(packed).over(W.partitionBy("_part").orderBy("_row")))
    last = s.groupBy("_part").agg(F.max_by(packed, "_row").alias("__last"))
    carry = last.select("_part", F.lag("__last").over(W.partitionBy(F.lit(0)).orderBy("_part")).alias("__edge"))
    j = s.join(carry, "_part").withColumn("__p", F.coalesce("__in", F.when(F.col("_row") == 0, F.col("__edge"))))
    same = F.lit(True)
    for g in groups:
        same = same & F.col(f"__p.{g}").eqNullSafe(F.col(g))
    return j.withColumn(out, F.when(same, F.col("__p"))).drop("_part", "_row", "__in", "__edge", "__p")


def hash_order(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def hash_positions(df: DataFrame, groups: list[str], key: str, seed: int, position: str = "pos", size: str = "n") -> DataFrame:
    """0-based position in md5 order of a unique key, inside each group."""
    h = df.withColumn("_h", hash_order(F.col(key), seed))
    return sorted_positions(h, groups, ["_h", key], position, size).drop("_h")


def strided_sample(df: DataFrame, groups: list[str], order: list[str], limit: int) -> DataFrame:
    """At most ``limit`` rows per group spread evenly over the order."""
    p = sorted_positions(df, groups, order)
    i = F.ceil(F.col("pos") * limit / F.col("n"))
    i = F.when(F.floor((i - 1) * F.col("n") / limit) == F.col("pos"), i - 1).otherwise(i)
    hit = (i < limit) & (F.floor(i * F.col("n") / limit) == F.col("pos"))
    return p.filter((F.col("n") <= limit) | hit).drop("pos", "n")


def average_ranks(df: DataFrame, value: str, out: str = "rank") -> DataFrame:
    """value -> average rank (ties share it).  One row per distinct value."""
    counts = df.groupBy(value).agg(F.count("*").alias("_c"))
    return running_total(counts, [value], {"_c": "_less"}).select(
        value, (F.col("_less") + (F.col("_c") + 1) / 2).alias(out))
