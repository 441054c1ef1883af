"""Windowed latency of a stream of trace events (an extension: the batch engine has no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_latency(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Rows (window_start, stage, n, avg_ms, max_ms) of events (started_at, stage, elapsed_ms); those later than ``late`` don't count."""
    timed = events.withColumn("at", F.col("started_at").cast("timestamp")).withWatermark("at", late)
    by = timed.groupBy(F.window("at", window).alias("w"), "stage").agg(F.count("*").alias("n"), F.avg("elapsed_ms").alias("avg_ms"), F.max("elapsed_ms").alias("max_ms"))
    return by.select(F.col("w.start").alias("window_start"), "stage", "n", "avg_ms", "max_ms")
