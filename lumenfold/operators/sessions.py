"""Session windows: a key's rows that follow each other within a gap.

Two rows in one stretch of time no longer than the gap are in one session, so rows are first combined by key and stretch, before the
shuffle: a key sends its stretches, not its rows, and a key with a third of all rows has as many as the time has. Stretches are then
merged in order of time. `streaming.sessions_of` gives the same rows of a stream.

Cases: a session ends one gap after its last row, and a row at just that time still belongs to it; rows without a key are a
key of their own, rows without a time belong to no session; rows that repeat count each; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessions(events: DataFrame, by: list[str], on: str, gap_seconds: int, sums: dict[str, Column] | None = None) -> DataFrame:
    """by, session_start, session_end (a gap after the last row), n and `sums` (new name to a number that is added up) of each session."""
    sums = sums or {}
    at = F.unix_micros(F.col(on).cast("timestamp"))
    gap = gap_seconds * 1_000_000
    rows = events.where(F.col(on).isNotNull()).select(*by, at.alias("_at"), *[c.alias(new) for new, c in sums.items()])
    added = lambda n: [F.sum(n).alias("n"), *[F.sum(c).alias(c) for c in sums]]
    stretches = rows.groupBy(*by, (F.col("_at") - F.pmod(F.col("_at"), F.lit(gap))).alias("_stretch")).agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"), *added(F.lit(1)))
    order = Window.partitionBy(*by).orderBy("_stretch")
    starts = F.coalesce(F.col("_first") - F.lag("_last").over(order) > gap, F.lit(True)).cast("int")
    numbered = stretches.withColumn("_starts", starts).withColumn("_session", F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = numbered.groupBy(*by, "_session").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"), *added(F.col("n")))
    return found.select(*by, F.timestamp_micros("_first").alias("session_start"), F.timestamp_micros(F.col("_last") + gap).alias("session_end"), "n", *sums)
