"""Event-time forms over the events table, as batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame) -> DataFrame:
    """``ts`` as a timestamp with a zone, which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events and their value by window and type; the watermark only acts on streams."""
    source = timed(events)
    if events.isStreaming:
        source = source.withWatermark("ts", late)
    return (
        source.groupBy(F.window("ts", size).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
    )


def session_windows(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    source = timed(events)
    if events.isStreaming:
        source = source.withWatermark("ts", late)
    return source.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("started"), "user_id", "n"
    )


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events without repeats of an event_id; on streams within the watermark."""
    if events.isStreaming:
        return timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return timed(events).dropDuplicates(["event_id"])
