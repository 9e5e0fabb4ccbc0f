"""Keys with very many rows, cut into parts: by place (along a time or number) or by a hash.

A key is hot if it has more than an even share of the rows: `limit`, or a MAX_HOT-th of all if that is more. So there are
fewer than MAX_HOT hot keys whatever the input, and about two times as many parts; only they come to the driver.
Rows are counted by key with a partial aggregation, so finding hot keys costs a row a key and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT_ROWS, MAX_HOT, QUANTILES = 1_000_000, 2_000, 100
#: The largest place.
FARTHEST = 1 << 61
#: Parts of the rows without a key.
NULL_PARTS = 256


def place(column: Column, kind: T.DataType) -> Column:
    """A whole number that ascends with a time, date or number (not strictly: fractions of a second and of one are cut off)."""
    if isinstance(kind, T.TimestampNTZType):  # by its fields: a cast to an instant would depend on the time zone, and go back in spring
        return F.unix_date(column.cast("date")).cast("long") * 86_400 + F.hour(column) * 3_600 + F.minute(column) * 60 + F.second(column)
    if isinstance(kind, T.TimestampType):
        return F.unix_seconds(column)
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("long")
    if isinstance(kind, T.IntegralType):  # far ones share a place, so that differences of places fit a long
        return F.greatest(F.least(column.cast("long"), F.lit(FARTHEST)), F.lit(-FARTHEST))
    if isinstance(kind, T.NumericType):
        number = column.cast("double")
        return F.when(F.isnan(number), float(FARTHEST)).otherwise(F.greatest(F.least(F.floor(number).cast("double"), F.lit(float(FARTHEST))), F.lit(-float(FARTHEST)))).cast("long")
    raise TypeError(f"a time, date or number is needed, not {kind.simpleString()}")


def hot_keys(rows: DataFrame, keys: list[str], limit: int = HOT_ROWS, null_is_key: bool = False) -> tuple[list, int]:
    """Rows of the keys and n of each hot key, and the even share."""
    share = max(limit, rows.count() // MAX_HOT)
    known = rows if null_is_key else rows.where(" and ".join(f"`{k}` is not null" for k in keys))
    counted = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") > share).collect(), share


def _same(keys: list[str]) -> list[Column]:
    """Equal keys of a table and of one whose keys are named with h before them; null is equal to null."""
    return [F.col(k).eqNullSafe(F.col(f"h{k}")) for k in keys]


def _bounds(rows: DataFrame, keys: list[str], at: str, hot: list, limit: int) -> DataFrame:
    """keys, and the quantiles (edges) and steps between two of them by which the places of a hot key are cut."""
    spark, types = rows.sparkSession, [T.StructField(f"h{k}", rows.schema[k].dataType) for k in keys]
    named = spark.createDataFrame([tuple(r) for r in hot], T.StructType([*types, T.StructField("n", T.LongType())]))
    spread = rows.where(F.col(at).isNotNull()).join(F.broadcast(named), _same(keys)).groupBy(*keys, "n")
    found = spread.agg(F.percentile_approx(at, [k / QUANTILES for k in range(QUANTILES + 1)], 20 * QUANTILES).alias("edges")).collect()  # MAX_HOT rows at most
    cut = []
    for r in found:
        parts = -(-r.n // limit)
        edges = sorted(set(r.edges[:: max(1, QUANTILES // parts)]) | {r.edges[-1]})
        cut.append((*[r[k] for k in keys], edges, -(-parts // QUANTILES)))
    return spark.createDataFrame(cut, T.StructType([*types, T.StructField("_edges", T.ArrayType(T.LongType())), T.StructField("_steps", T.IntegerType())]))


def with_parts(rows: DataFrame, keys: list[str], at: str, limit: int = HOT_ROWS, null_is_key: bool = False) -> tuple[DataFrame, bool]:
    """`rows` with _part, and whether a key is hot. A hot key's parts ascend with the place `at` (a long); others are one part, 0.

    Rows of one key and place are in one part. Rows without a key are dealt over NULL_PARTS parts below 0, if null isn't a key of its own.
    """
    none = F.lit(False)
    for k in keys if not null_is_key else []:
        none = none | F.col(k).isNull()
    if not keys:
        rows, keys = rows.withColumn("_all", F.lit(0)), ["_all"]
    keyless = F.when(none, -1 - F.pmod(F.xxhash64(at), F.lit(NULL_PARTS)).cast("int"))
    hot, limit = hot_keys(rows, keys, limit, null_is_key)
    if not hot:
        return rows.withColumn("_part", keyless.otherwise(0)), False
    joined = rows.join(F.broadcast(_bounds(rows, keys, at, hot, limit)), _same(keys), "left").drop(*[f"h{k}" for k in keys])
    edge = F.greatest(F.size(F.filter("_edges", lambda x: x <= F.col(at))), F.lit(1))
    low, high = F.element_at("_edges", edge).cast("double"), F.coalesce(F.try_element_at("_edges", edge + 1), F.element_at("_edges", edge)).cast("double")
    step = F.floor((F.col(at).cast("double") - low) * F.col("_steps") / F.greatest(high - low, F.lit(1.0)))
    part = (edge - 1) * F.col("_steps") + F.greatest(F.lit(0), F.least(step, F.col("_steps") - 1))
    return joined.withColumn("_part", keyless.otherwise(F.coalesce(F.when(F.col("_edges").isNotNull(), part), F.lit(0)).cast("int"))).drop("_edges", "_steps"), True


def join_dealt(left: DataFrame, right: DataFrame, keys: list[str], limit: int = HOT_ROWS) -> DataFrame:
    """Inner join on `keys`; the left rows of a hot key are dealt over parts, to each of which its right rows are copied."""
    hot, limit = hot_keys(left, keys, limit)
    if not hot:
        return left.join(right, keys)
    parts = [(*tuple(r)[:-1], -(-r.n // limit)) for r in hot]
    named = F.broadcast(left.sparkSession.createDataFrame(parts, T.StructType([*[left.schema[k] for k in keys], T.StructField("_parts", T.LongType())])))
    several = F.coalesce("_parts", F.lit(1).cast("long"))
    dealt = left.join(named, keys, "left").withColumn("_deal", F.pmod(F.xxhash64(F.struct(*[c for c in left.columns])), several)).drop("_parts")
    copied = right.join(named, keys, "left").withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), several - 1))).drop("_parts")
    return dealt.join(copied, [*keys, "_deal"]).drop("_deal")
