"""Joins of many rows with one value a key, in which a key with many rows is not one task.

Keys with more than an even share of the rows are hot. Their rows are dealt over parts, and their value is
copied to each part. There are fewer than HOT_KEYS hot keys, whatever the input, and each stands in more rows
than the mean share, so they take fewer bytes than HOT_KEYS mean keys; they are broadcast.

Cases: rows with a null key find no value; a key without a value is kept by a left join alone; rows that repeat
in all columns of `spread` stay together; the names _part and _parts are taken; empty tables give no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS, HOT_KEYS = 10_000, 50_000


def hot_keys(counted: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """The hot keys and their _parts. counted: keys and n, their number of rows, `rows` in sum at most."""
    limit = max(HOT_ROWS, -(-rows // HOT_KEYS))
    return counted.where(F.col("n") > limit).select(*keys, F.ceil(F.col("n") / limit).cast("int").alias("_parts"))


def join_split(rows: DataFrame, values: DataFrame, keys: list[str], hot: DataFrame | None, spread: list[str], how: str = "inner") -> DataFrame:
    """`rows` joined with `values` (one row a key), the rows of a hot key dealt by the hash of `spread`; hot: None if no key is."""
    if hot is None:
        return rows.join(values, keys, how)
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_part", F.pmod(F.xxhash64(*spread), parts).cast("int")).drop("_parts")
    copies = values.join(F.broadcast(hot), keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copies, [*keys, "_part"], how).drop("_part")
