"""Sums over a range of time before each row, and numbers along an order, for keys of any size.

A window function holds all rows of a key in one task. Here a hot key is cut into parts along the order (`parts`):
a range of time takes the rows of the parts before that it reaches into along as helpers; numbers start from the counts of the parts before.

Cases: rows at one time are in each other's range (bounds included); a null time has no range, and its row no result; rows without a key are a
key of their own; rows that repeat count each; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators.parts import HOT_ROWS, place, with_parts


def _cut(df: DataFrame, by: list[str], on: str, limit: int, values: tuple[Column, ...] = ()) -> tuple[DataFrame, list[str], bool]:
    """_row, the keys, _at, _place, _part and the values (_v0, ...) of the rows with a time, the grouping columns, and whether a key is hot."""
    keys = [f"_k{n}" for n in range(len(by))]
    rows = df.where(F.col(on).isNotNull()).select(F.struct("*").alias("_row"), *[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.col(on).alias("_at"), *[v.alias(f"_v{n}") for n, v in enumerate(values)])
    cut, hot = with_parts(rows.withColumn("_place", place(F.col("_at"), df.schema[on].dataType)), keys, "_place", limit, null_is_key=True)
    return cut, keys or ["_all"], hot


def rolling(df: DataFrame, by: list[str], on: str, seconds: int, sums: dict[str, Column], limit: int = HOT_ROWS) -> DataFrame:
    """`df` with n_rolling and `sums` (new name to a number) over the rows of the key in the `seconds` up to each row's time `on`."""
    rows, keys, hot = _cut(df, by, on, limit, tuple(sums.values()))
    rows = rows.withColumn("_micros", F.unix_micros(F.col("_at").cast("timestamp")))
    own = rows.withColumn("_helps", F.lit(False))
    if hot:
        low = rows.groupBy(*keys, "_part").agg(F.min("_place").alias("low"))
        listed = low.groupBy(*keys).agg(F.collect_list(F.struct(F.col("_part").alias("part"), "low")).alias("_parts"))  # a row a part of each hot key, one of others
        reached = F.filter("_parts", lambda x: (x["part"] > F.col("_part")) & (x["low"] <= F.col("_place") + seconds + 1))
        several = F.broadcast(listed.where(F.size("_parts") > 1))
        match = [F.col(k).eqNullSafe(F.col(f"h{k}")) for k in keys]
        joined = rows.join(several.withColumnsRenamed({k: f"h{k}" for k in keys}), match)
        helpers = joined.withColumn("_to", F.explode(F.transform(reached, lambda x: x["part"]))).drop("_part").withColumnRenamed("_to", "_part").withColumn("_helps", F.lit(True))
        own = own.unionByName(helpers.select(own.columns))
    frame = Window.partitionBy(*keys, "_part").orderBy("_micros").rangeBetween(-seconds * 1_000_000, 0)
    added = own.withColumns({"_n": F.count(F.lit(1)).over(frame), **{f"_s{n}": F.sum(f"_v{n}").over(frame) for n in range(len(sums))}}).where("not _helps")
    return added.select("_row.*", F.col("_n").alias("n_rolling"), *[F.col(f"_s{n}").alias(new) for n, new in enumerate(sums)])


def numbered(df: DataFrame, by: list[str], on: str, ties: list[str] | None = None, limit: int = HOT_ROWS) -> DataFrame:
    """`df` with row_number and dense_rank along `on` (equal values: row_number by `ties`, one dense_rank)."""
    rows, keys, hot = _cut(df, by, on, limit)
    group = [*keys, "_part"]
    along = Window.partitionBy(*group).orderBy("_at")
    local = rows.withColumns({"_number": F.row_number().over(Window.partitionBy(*group).orderBy("_at", *[f"_row.{t}" for t in ties or []])), "_rank": F.dense_rank().over(along)})
    if hot:
        before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
        sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("_at").alias("values"))
        offsets = sizes.select(*[F.col(c).alias(f"h{c}") for c in group], F.sum("rows").over(before).alias("_rows"), F.sum("values").over(before).alias("_values")).where("_rows is not null")
        local = local.join(F.broadcast(offsets), [F.col(c).eqNullSafe(F.col(f"h{c}")) for c in group], "left")
        local = local.withColumns({"_number": F.col("_number") + F.coalesce("_rows", F.lit(0)), "_rank": F.col("_rank") + F.coalesce("_values", F.lit(0))})
    return local.select("_row.*", F.col("_number").cast("long").alias("row_number"), F.col("_rank").cast("long").alias("dense_rank"))
