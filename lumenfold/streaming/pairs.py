"""Two streams joined within a time: each left row with the right rows of its key that follow within a bound.

Both sides have a watermark, and the bound tells how long a row can still find a partner: a left row's state goes when the
right side's watermark has passed its time and the bound, a right row's when the left side's has passed its time. So state holds what
came within the bound and the lateness, not the stream.

Cases: a right row at the same time doesn't follow; rows that repeat are pairs of their own; a null key or time has no partner; rows later
than `late` behind their side's watermark are dropped. With how="left_outer" a left row without a partner comes once its time is over.
On tables instead of streams it is the plain join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def followed_by(left: DataFrame, right: DataFrame, by: list[str], times: tuple[str, str], within: str, late: str = "1 hour", how: str = "inner") -> DataFrame:
    """Columns of both sides (named apart, but for the keys `by`, which are the left side's) where right follows within `within`, an interval."""
    if clash := (set(left.columns) & set(right.columns)) - set(by):
        raise ValueError(f"names that are in both streams: {sorted(clash)}")
    before, after = times
    lefts = left.withColumn(before, F.col(before).cast("timestamp")).withWatermark(before, late)
    rights = right.withColumn(after, F.col(after).cast("timestamp")).withColumnsRenamed({b: f"_right_{b}" for b in by}).withWatermark(after, late)
    follows = (F.col(after) > F.col(before)) & (F.col(after) <= F.col(before) + F.expr(f"INTERVAL {within}"))
    for b in by:
        follows = follows & (F.col(b) == F.col(f"_right_{b}"))
    return lefts.join(rights, follows, how).drop(*[f"_right_{b}" for b in by])
