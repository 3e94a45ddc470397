"""Session settings the operators count on, and how to size a cluster run."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Re-planning at run time: joins turn to broadcasts by measured size, hot join keys and
# rebalanced partitions are split, small shuffle partitions are merged.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.exchange.reuse": "true",
}
# Dates must not depend on where a task runs.
FIXED = {"spark.sql.session.timeZone": "UTC"}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

PARTITION_BYTES = 256 * 1024 * 1024
CELL_BYTES = 200  # of a row of sums in a shuffle
MOST_SCANS = 100_000  # tasks of a scan, as the driver keeps the shuffle's map for each


def cluster_settings(input_bytes: int, cells: int) -> dict[str, str]:
    """Settings for a run over `input_bytes` of source data with so many distinct cells.

    Tasks combine their own rows, so the first shuffle moves sums per cell and its partitions
    go by their number, not by the input. Scans are cut so that there are MOST_SCANS tasks at
    most. Adaptive execution merges what turns out small.
    """
    partitions = max(200, -(-cells * CELL_BYTES // PARTITION_BYTES))
    return {
        **ADAPTIVE,
        **FIXED,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(PARTITION_BYTES),
        "spark.sql.files.maxPartitionBytes": str(
            max(PARTITION_BYTES, -(-input_bytes // MOST_SCANS))
        ),
    }


def cluster_session(input_bytes: int, cells: int, name: str = "marginflow") -> SparkSession:
    """A session on the cluster that the launcher names, sized for the input."""
    builder = SparkSession.builder.appName(name)
    for key, value in cluster_settings(input_bytes, cells).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is planned and run in here leaves no shuffle files (from Spark 4.1 on)."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g"):
    """A session for tests and measurements on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
    )
    for key, value in {**ADAPTIVE, **FIXED}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
