"""Rows that have, or don't have, a partner in another table: semi and anti joins for keys of any size.

Only the different keys of the right table matter; they are combined before the shuffle. If their number is at most BROADCAST_KEYS they are
broadcast, and left rows aren't shuffled. Beyond that, left rows of a hot key are dealt over parts, to each of which the key is
copied (`parts`). Left rows with a null in a key have no partner and take no part in the join, so they aren't one task either.

Cases: null matches nothing; left rows that repeat stay, right rows that repeat count once; an empty right table matches nothing;
extra columns of the right table aren't looked at, so their names may be those of the left one; left names that the join uses are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.operators.parts import HOT_ROWS, hot_keys
from lumenfold.sources.shared import checkpointed

BROADCAST_KEYS = 500_000


def _names(on: list[str | tuple[str, str]]) -> tuple[list[str], list[str]]:
    pairs = [(x, x) if isinstance(x, str) else x for x in on]
    if not pairs:
        raise ValueError("a key is needed")
    return [a for a, _ in pairs], [b for _, b in pairs]


def _known(df: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        df = df.where(F.col(c).isNotNull())
    return df


def _hashed(left: DataFrame) -> list[str]:
    """The columns that have a hash. With the number of the task they deal rows, also ones that repeat, and alike if a task runs again."""
    return [f.name for f in left.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]


def _joined(left: DataFrame, right: DataFrame, on: list[str | tuple[str, str]], how: str, limit: int, few: int) -> DataFrame:
    """`left`, of which no key is null, by `how`."""
    mine, theirs = _names(on)
    names = [f"_k{n}" for n in range(len(mine))]
    if taken := {*names, *[f"h{k}" for k in names], "_parts", "_part", "_deal"} & set(left.columns):
        raise ValueError(f"names that the join uses: {sorted(taken)}")
    keys = checkpointed(_known(right, theirs).select(*[F.col(c).alias(k) for c, k in zip(theirs, names, strict=True)]).distinct())
    same = [F.col(c) == F.col(k) for c, k in zip(mine, names, strict=True)]
    if keys.count() <= few:
        return left.join(F.broadcast(keys), same, how)
    hot, share = hot_keys(left, mine, limit)
    if not hot:
        return left.join(keys, same, how)
    types = [T.StructField(f"h{k}", left.schema[c].dataType) for c, k in zip(mine, names, strict=True)]
    named = F.broadcast(left.sparkSession.createDataFrame([(*tuple(r)[:-1], -(-r.n // share)) for r in hot], T.StructType([*types, T.StructField("_parts", T.LongType())])))  # fewer than MAX_HOT rows
    several = F.coalesce("_parts", F.lit(1).cast("long"))
    spare = [f"h{k}" for k in names]
    dealt = left.join(named, [F.col(c) == F.col(f"h{k}") for c, k in zip(mine, names, strict=True)], "left").withColumn("_deal", F.pmod(F.xxhash64(*_hashed(left), F.spark_partition_id()), several))
    copied = keys.join(named, [F.col(k) == F.col(f"h{k}") for k in names], "left").select(*names, F.explode(F.sequence(F.lit(0).cast("long"), several - 1)).alias("_part"))
    return dealt.drop("_parts", *spare).join(copied, [*same, F.col("_deal") == F.col("_part")], how).drop("_deal")


def having(left: DataFrame, right: DataFrame, on: list[str | tuple[str, str]], limit: int = HOT_ROWS, few: int = BROADCAST_KEYS) -> DataFrame:
    """Rows of `left` with a partner in `right` (EXISTS). on: names of the keys, or their names left and right."""
    return _joined(_known(left, _names(on)[0]), right, on, "left_semi", limit, few)


def lacking(left: DataFrame, right: DataFrame, on: list[str | tuple[str, str]], limit: int = HOT_ROWS, few: int = BROADCAST_KEYS) -> DataFrame:
    """Rows of `left` without a partner in `right` (NOT EXISTS), those with a null key among them."""
    mine = _names(on)[0]
    unknown = F.lit(False)
    for c in mine:
        unknown = unknown | F.col(c).isNull()
    return _joined(_known(left, mine), right, on, "left_anti", limit, few).unionByName(left.where(unknown))


def not_among(left: DataFrame, right: DataFrame, on: str | tuple[str, str], limit: int = HOT_ROWS, few: int = BROADCAST_KEYS) -> DataFrame:
    """Rows of `left` whose key is known not to be in `right` (NOT IN): none if `right` has a null; if `right` is empty, all."""
    mine, theirs = (on, on) if isinstance(on, str) else on
    counts = right.agg(F.count(F.lit(1)).alias("n"), F.count(theirs).alias("known")).first()
    if counts.n == 0:
        return left
    if counts.known < counts.n:
        return left.where("false")
    return _joined(_known(left, [mine]), right, [(mine, theirs)], "left_anti", limit, few)
