"""Windowed aggregates that mean the same over a table and over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _watermarked(rows: DataFrame, late: str) -> DataFrame:
    return rows.withWatermark("ts", late) if rows.isStreaming else rows


def tumbling(events: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of value by window and event_type. On a stream, rows later than ``late`` are dropped."""
    told = _watermarked(events, late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return told.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Runs of a user's events with less than ``gap`` between neighbours."""
    told = _watermarked(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return told.select("user_id", F.col("w.start").alias("session_start"), "n")
