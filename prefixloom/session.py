"""Session settings this package relies on."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.tables import shared_folder


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings that can be changed on a running session."""
    for key, value in {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # a small row here starts much work (one prefix, many comparisons)
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16KB",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }.items():
        spark.conf.set(key, value)
    return spark


def local(cores: int = 8, memory: str = "8g", name: str = "prefixloom") -> SparkSession:
    """A local session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of writes inside go as soon as they have ended; else they stay until the driver collects its garbage.

    Spark does not do this for checkpoints.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and go on from the files.

    The folder is the session's spark.checkpoint.dir (see shared_folder).
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def broadcast_up_to(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; beyond, the plain join stands."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
