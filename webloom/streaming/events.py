"""Event streams: windows, late data, distinct events, and the keyed folds of operators.state in micro-batches.

The functions take batch and streaming DataFrames alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, event_type, n, total of events(ts, event_type, value) in windows; a stream drops what comes later than `late`."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return w.agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """user_id, start, stop, n: runs of a user's events with no gap as long."""
    w = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap))
    return w.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def distinct(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event_id once; a stream forgets ids older than `late`."""
    w = events.withWatermark("ts", late)
    return w.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else w.dropDuplicates(["event_id"])
