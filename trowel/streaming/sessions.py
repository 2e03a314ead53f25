"""Islands and totals over an event stream: session windows and windowed counts with watermarks.

An extension: the batch queries are islands and signal_totals. State is bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, at: str, gap: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(key, session_start, session_end, n): events of a key less than gap apart, merged."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    grouped = timed.groupBy(key, F.session_window("_at", gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def windowed_totals(events: DataFrame, kind: str, at: str, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(window_start, kind, n): counts of each kind in tumbling windows."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    grouped = timed.groupBy(F.window("_at", width).alias("w"), kind).agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("window_start"), kind, "n")
