"""Event-time counts, the same on a table and on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, length: str = "1 hour", late: str | None = None) -> DataFrame:
    """Counts and sums by window and event type; ``late`` bounds a stream's state."""
    rows = events if late is None else events.withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Sessions of a user, which end after a gap without events."""
    rows = events if late is None else events.withWatermark("ts", late)
    out = rows.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), "n")


def window_stream(spark: SparkSession, source: str, schema, target: str, checkpoint: str, length: str = "1 hour", late: str = "10 minutes"):
    """Appends each window's counts once its watermark has passed; runs what is there."""
    counted = windowed(spark.readStream.schema(schema).parquet(source), length, late)
    return counted.writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
