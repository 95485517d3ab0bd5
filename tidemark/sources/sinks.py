"""Writing results and reading them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def export_csv(df: DataFrame, folder: str, order: str = "ts") -> None:
    """All rows in order, every field quoted, quotes doubled, null as empty.

    The sort is a range exchange: files are ordered among themselves, so the
    export is as parallel as the table is large.
    """
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]
    (df.orderBy(order).select(*text).write.mode("overwrite").option("header", True).option("quoteAll", True)
     .option("escape", '"').option("emptyValue", "").csv(folder))


def read_csv(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).schema(schema).csv(folder)


def write_panel(panel: DataFrame, folder: str, by: str = "symbol") -> None:
    panel.write.mode("overwrite").partitionBy(by).parquet(folder)


def write_documents(docs: DataFrame, folder: str) -> None:
    docs.write.mode("overwrite").json(folder)


def read_documents(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(folder)
