"""Dated series as landed: text values, gaps and percent units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.finance import CONSTANT_RISK_FREE

OHLCV = ("open", "high", "low", "close", "adj_close", "volume")


def number(c: Column) -> Column:
    """Numeric value of a text field; anything unreadable is null."""
    v = c.try_cast("double")
    return F.when(~F.isnan(v), v)


def ohlcv(df: DataFrame, mapping: dict[str, str], key: str = "symbol", date_col: str = "date") -> DataFrame:
    """A vendor table in the six canonical columns."""
    have = {c: number(F.col(v)) for c, v in mapping.items() if v in df.columns}
    if "adj_close" not in have and "close" in have:
        have["adj_close"] = have["close"]
    cols = [have.get(c, F.lit(None).cast("double")).alias(c) for c in OHLCV]
    return df.select(F.col(key), F.to_date(date_col).alias("date"), *cols)


def forward_filled(series: DataFrame, by: str = "series_id", percent: bool = False) -> DataFrame:
    """Text series to numbers, '.' as missing, the last value carried forward.

    A series has one row per day, so its window is bounded by the calendar.
    """
    v = number(F.nullif(F.col("value"), F.lit(".")))
    if percent:
        v = v / 100
    w = W.partitionBy(by).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    return series.select(by, "date", F.last(v, ignorenulls=True).over(w).alias("value"))


def panel(series: DataFrame, ids: list[str], by: str = "series_id") -> DataFrame:
    """Several series side by side on their dates, each carried forward."""
    v = number(F.nullif(F.col("value"), F.lit(".")))
    wide = series.groupBy("date").agg(*[F.first(F.when(F.col(by) == i, v), ignorenulls=True).alias(i) for i in ids])
    w = W.partitionBy(F.lit(0)).orderBy("date").rowsBetween(W.unboundedPreceding, 0)  # one row per day
    return wide.select("date", *[F.last(i, ignorenulls=True).over(w).alias(i) for i in ids])


def constant_rate(spark: SparkSession, start: str, end: str, annual: float = CONSTANT_RISK_FREE) -> DataFrame:
    """A constant annual rate on the business days of [start, end)."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.date_sub(F.lit(end).cast("date"), 1))).alias("date"))
    return days.filter(F.weekday("date") < 5).select("date", F.lit(annual).alias("rate"))
