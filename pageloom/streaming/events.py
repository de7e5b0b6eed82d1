"""Streaming forms: windows with watermarks on events, and crawl records from a stream of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(rows: DataFrame, late: str) -> DataFrame:
    """A stream with its watermark, which needs an instant; a table as it is."""
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if rows.isStreaming else rows


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums by window and event type; works on a stream (with a watermark) and on a table."""
    rows = _timed(events, late)
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return rows.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.count("value").alias("n_values")).select(F.col("w.start").alias("window_start"), "event_type", "n", "n_values")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = _timed(events, late)
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def first_urls(pages: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Each key once: within the watermark on a stream, overall on a table."""
    return _timed(pages, late).dropDuplicatesWithinWatermark([key]) if pages.isStreaming else pages.dropDuplicates([key])
