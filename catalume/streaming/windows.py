"""Event-time windows over a stream of events; beyond what the batch engine needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) per window of event time; works on streams and tables."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = marked.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(user_id, start, n) of runs of a user's events without a gap of ``gap``."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = marked.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("start"), "n")
