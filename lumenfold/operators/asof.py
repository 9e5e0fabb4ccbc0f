"""As-of join: for each left row the last earlier (or first later) right row of its key.

Both sides become one table, which is merged in order of time: a running last value gives each left row the right row before it.
One shuffle brings a key's rows together; no pair of rows is made. A hot key is cut into parts of ascending time (`parts`), which are
merged each on its own, and the last right row of all parts before is carried over to a part: a row a part, broadcast.

Cases: times may be timestamps, dates or numbers, of one type on both sides; of right rows at one time the one with the largest (first
later: smallest) `tie` counts, and without ties any; a null in a key or time matches nothing, but the left row stays; left rows that repeat
stay; empty tables give no match, or no row. All rows of one key at one time are one task, as time can't part them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators.parts import HOT_ROWS, place, with_parts


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: str | tuple[str, str],
    by: list[str],
    take: dict[str, str],
    *,
    tie: tuple[str, ...] = (),
    strict: bool = False,
    later: bool = False,
    within: Column | None = None,
    limit: int = HOT_ROWS,
) -> DataFrame:
    """`left` with columns of the matching right row. take: new name to right column.

    on: the time, or its names left and right. strict: a right row at the same time doesn't match. later: the first later row instead of the last
    earlier one. within: how far away a match may be, as an interval or number.
    """
    at_left, at_right = (on, on) if isinstance(on, str) else on
    if clash := set(take) & set(left.columns):
        raise ValueError(f"names that are in the left table: {sorted(clash)}")
    kind = left.schema[at_left].dataType
    if kind != right.schema[at_right].dataType:
        raise TypeError(f"times of one type are needed, not {kind.simpleString()} and {right.schema[at_right].dataType.simpleString()}")
    keys = [f"_k{n}" for n in range(len(by))]
    keyed = lambda df: [F.col(b).alias(k) for b, k in zip(by, keys, strict=True)]
    seen = right.where(F.col(at_right).isNotNull())
    for b in by:
        seen = seen.where(F.col(b).isNotNull())
    value = F.struct(F.col(at_right).alias("at"), F.struct(F.lit(0), *tie).alias("tie"), F.struct(F.lit(True).alias("_"), *[F.col(c).alias(new) for new, c in take.items()]).alias("row"))
    rights = seen.select(*keyed(right), F.col(at_right).alias("_at"), F.lit(1 if strict != later else 0).alias("_seq"), value.alias("_right"))
    lefts = left.select(*keyed(left), F.col(at_left).alias("_at"), F.lit(0 if strict != later else 1).alias("_seq"), F.struct("*").alias("_left"))
    both, hot = with_parts(lefts.unionByName(rights, allowMissingColumns=True).withColumn("_place", place(F.col("_at"), kind)), keys, "_place", limit)
    group = ["_part", *(keys or ["_all"])]
    turn = (lambda c: F.col(c).desc()) if later else (lambda c: F.col(c).asc())
    order = Window.partitionBy(*group).orderBy(turn("_at"), turn("_seq"), turn("_right.tie")).rowsBetween(Window.unboundedPreceding, 0)
    merged = both.withColumn("_found", F.last("_right", ignorenulls=True).over(order)).where("_left is not null")
    if hot:
        by_place = F.struct("_right.at", "_right.tie")
        last = both.groupBy(*group).agg((F.min_by if later else F.max_by)("_right", F.when(F.col("_right").isNotNull(), by_place)).alias("_last"))
        before = Window.partitionBy(*[k for k in group if k != "_part"]).orderBy(turn("_part")).rowsBetween(Window.unboundedPreceding, -1)  # a row a part
        carried = last.select(*group, F.last("_last", ignorenulls=True).over(before).alias("_carried")).where("_carried is not null")
        merged = merged.join(F.broadcast(carried), group, "left").withColumn("_found", F.coalesce("_found", "_carried"))
    matches = F.col("_at").isNotNull()
    if within is not None:
        matches = matches & ((F.col("_found.at") <= F.col("_at") + within) if later else (F.col("_found.at") >= F.col("_at") - within))
    return merged.select("_left.*", *[F.when(matches, F.col(f"_found.row.`{new}`")).alias(new) for new in take])
