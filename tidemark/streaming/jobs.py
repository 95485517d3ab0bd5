"""Incremental forms of the ingest, health and dashboard jobs.

State is kept in keyed tables (``discovery.Store``): micro-batch ``n`` reads the
rows of its own keys from the batches before it and overwrites folder ``n`` with
the rows it changed, so a retried batch gives the same result and a lost
executor costs one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import lifecycle as lc
from ..operators import postings as po
from ..operators.joins import applied_flag
from ..session import cut_lineage
from . import discovery


def file_stream(spark: SparkSession, folder: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Files as they land; without a limit a micro-batch takes all that are there."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Process everything that has landed, one micro-batch at a time."""
    q = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    q.awaitTermination()


def health_store(spark: SparkSession, folder: str, source: str, kind: str, batch: int = (1 << 31) - 1) -> discovery.Store:
    return discovery.Store(spark, folder, batch, tables={"health": f"{source} {kind}, retry_count bigint, status string"}, looked_up_by={"health": source})


def source_health(stream: DataFrame, source: str, ok: str, order: list[str], state: str, checkpoint: str) -> None:
    """Consecutive failures per source.

    A batch is summed per source before it meets the state, so a busy source
    costs one row; it reads the state of its own sources and writes only
    theirs.  ``health_store(...).newest("health")`` is the state after all batches.
    """
    kind = stream.schema[source].dataType.simpleString()

    def each(batch: DataFrame, n: int) -> None:
        store = health_store(batch.sparkSession, state, source, kind, n)
        delta = cut_lineage(lc.health_delta(batch, source, ok, order))
        store.write("health", lc.health_state(delta, store.newest("health", delta), source).select(source, F.col("retry_count").cast("bigint"), "status"))
    run_available(stream, checkpoint, each)


def windowed_counts(stream: DataFrame, ts: str, delay: str = "10 minutes") -> tuple[DataFrame, DataFrame]:
    """Tumbling daily counts and sliding seven-day means behind a watermark."""
    w = stream.withWatermark(ts, delay)
    daily = w.groupBy(F.window(ts, "1 day")).agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "n")
    weekly = w.groupBy(F.window(ts, "7 days", "1 day")).agg((F.count("*") / 7).alias("rolling")).select(F.date_sub(F.to_date("window.end"), 1).alias("day"), "rolling")
    return daily, weekly


def append_to(stream: DataFrame, folder: str, checkpoint: str) -> None:
    q = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def ingest_stream(stream: DataFrame, applied: DataFrame, prefs: po.Preferences, now: Column, store: str, checkpoint: str) -> None:
    """Continuous discovery: gate, drop applied, file what is kept under its duplicates.

    A batch reads the index entries of its own keys and writes only its own
    folders, so a retry replaces them.  ``discovery.canonical`` gives the result.
    """
    def each(batch: DataFrame, n: int) -> None:
        g = applied_flag(po.gated(batch, prefs, now), applied, "id")
        discovery.add_batch(batch.sparkSession, g.filter(F.col("reason").isNull() & ~F.col("applied")), store, n)
    run_available(stream, checkpoint, each)
