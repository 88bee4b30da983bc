"""A session for this engine."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(master: str | None = None, shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """UTC, adaptive execution, Arrow; the cluster's own settings otherwise."""
    builder = SparkSession.builder.appName("catalume").config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    builder = builder.config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
