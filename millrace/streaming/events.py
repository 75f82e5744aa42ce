"""Windowed streams over the events table: an extra of this library, on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet", files_per_batch: int = 1) -> DataFrame:
    """The events of a folder as a stream; new files that match are picked up."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/{pattern}")


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """start, event_type, n, total of each window; late: how long a stream waits for late events."""
    if late:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "6 hours", step: str = "2 hours", late: str | None = None) -> DataFrame:
    if late:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.window("ts", width, step)).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "12 hours", late: str | None = None) -> DataFrame:
    """user_id, start, stop, n of runs of a user's events without a longer gap."""
    if late:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def first_of_key(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Each key's first event, once; state older than the watermark is dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
