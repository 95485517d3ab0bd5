"""Reading the landed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table; projection and filters reach the scan."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals a table out when its scan has fewer splits than there are cores.

    Only where the rows lie changes; a table of at least one split per core is read as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def text_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The wanted columns of a table whose rows are long texts."""
    df = table(spark, folder, name)
    return spread(df.select(*columns) if columns else df)
