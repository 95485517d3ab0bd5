"""Helpers shared by the operators: reading tables, bounded label samples, passing rows through Python tasks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its plain name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def only(df: DataFrame, **named: str) -> DataFrame:
    """The columns an operator works on, under its own names, so that extra columns cannot clash."""
    return df.select(*[col(source).alias(own) for own, source in named.items()])


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, read again."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(batches: Iterator[pa.RecordBatch], name: str | int = "text", size: int = 4_000_000, rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``size`` bytes of a text column, or one longer row: only a slice becomes Python objects."""
    for b in batches:
        column = b.column(name).cast(pa.large_string())
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        at = 0
        while at < b.num_rows:
            to = max(at + 1, min(at + rows, int(np.searchsorted(ends, ends[at] + size, "right")) - 1))
            yield b.slice(at, to - at)
            at = to


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column of an Arrow batch, null as the empty text."""
    return [t if t is not None else "" for t in batch.column(name).to_pylist()]


def map_rows(df: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``mapInArrow`` to the same columns, whatever their names: the task sees them by position."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(task, plain.schema).toDF(*df.columns)


_held: dict = {}


def held(key: tuple, make: Callable[[], object]) -> object:
    """One large object per Python worker: workers are reused by later stages, which then free it."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def filter_rows(df: DataFrame, text_col: str, keep: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    """The rows whose text ``keep`` accepts, all columns unchanged."""
    at = df.columns.index(text_col)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, at):
            yield batch.filter(pa.array(keep(batch.column(at).to_pylist()), pa.bool_()))
    return map_rows(df, task)


def label_sample(labelled: DataFrame, limit: int, by: str | None = None) -> DataFrame:
    """At most ``limit`` rows in the order of a hash of the id; with ``by`` about as many of each of its values, 50,000 in all.

    Used only to fit classifiers on (id, label) rows; the choice does not
    depend on partitioning, and every row is in the sample while the table is
    smaller than the limit.  Values of ``by`` are weighed through a table of at
    most 10,000 counts, so a value that holds most rows is never gathered.
    """
    mixed = labelled.withColumn("_h", F.xxhash64(F.lit(7), "id"))
    if by:
        counts = mixed.groupBy(by).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), by).limit(10_000)
        share = (F.col("_h").cast("double") + float(1 << 63)) / float(1 << 64)
        mixed, limit = mixed.join(F.broadcast(counts), by).filter(share * F.col("_n") <= limit).drop("_n"), 50_000
    return mixed.orderBy("_h", "id").limit(limit).drop("_h")


def struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


LONG, INT, DOUBLE, STRING, BINARY, BOOL = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BinaryType(), T.BooleanType()


def column_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType
