"""Windows of a stream, under a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def events_by_window(events: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by tumbling window and type of a stream (or table) of events; rows later than `late` are dropped by the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"))


def sessions_of(events: DataFrame, by: list[str], on: str, gap_seconds: int, sums: dict[str, Column] | None = None, late: str = "1 hour") -> DataFrame:
    """The rows of `operators.sessions.sessions` of a stream: a session comes when the watermark has passed its end, and its state goes.

    Cases as there; rows later than `late` are dropped by the watermark.
    """
    sums = sums or {}
    timed = events.where(F.col(on).isNotNull()).select(*by, F.col(on).cast("timestamp").alias("_at"), *[c.alias(new) for new, c in sums.items()])
    window = F.session_window("_at", f"{gap_seconds} seconds").alias("_window")
    found = timed.withWatermark("_at", late).groupBy(*by, window).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums])
    return found.select(*by, F.col("_window.start").alias("session_start"), F.col("_window.end").alias("session_end"), "n", *sums)
