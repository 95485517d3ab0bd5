"""Session helper and lineage cutting."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "tidemark", master: str | None = None,
                shuffle_partitions: int | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings the library relies on.

    A cluster's own settings win: only values that decide results (time zone)
    or that Spark would otherwise leave off are written here.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return (
        builder
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for reliable checkpoints.

    ``spark.checkpoint.dir`` is the cluster's shared folder and always wins.
    Only a local master, where every task shares one disk, may fall back to a
    fresh temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-ckpt-")
    sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read on from there.

    Used where a plan would otherwise be evaluated twice with a different
    physical layout (positions after a global sort) or grow in a loop.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
