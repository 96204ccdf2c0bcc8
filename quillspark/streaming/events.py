"""Event-time windows over an event table, the same for batch and streaming input. An extension, for incremental corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events and sum of values for each window and event type; a stream forgets windows that end `late` before the newest event."""
    df = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        df = df.withWatermark("ts", late)
    grouped = df.groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: events less than `gap` apart."""
    df = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        df = df.withWatermark("ts", late)
    grouped = df.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("session_window.start").alias("session_start"), "n")


def latest_revisions(events: DataFrame, target: str, checkpoint: str):
    """A stream of rows (key, revision, value) kept as an append-only log in `target`; read it with operators.groups.latest."""
    return events.writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
