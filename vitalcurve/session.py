"""A Spark session with the settings the operators are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(
    app: str = "vitalcurve",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    initial_partitions: int | None = None,
    **conf: str,
) -> SparkSession:
    """Adaptive execution with skew splitting, UTC, Arrow; ANSI mode stays on.

    ``master`` and ``shuffle_partitions`` are left to the cluster unless given.
    ``initial_partitions``: partitions that a shuffle starts from; adaptive
    execution merges small ones but never cuts one, so set it for the largest
    shuffle (some 128 MB each: 800,000 for 100 TB in one).
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if initial_partitions:
        builder = builder.config("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(initial_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
