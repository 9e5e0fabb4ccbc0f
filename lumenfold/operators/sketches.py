"""Sets of items as Theta sketches: sizes of their unions, intersections and differences, which HyperLogLog sketches can't give.

Sketches of one scan, combined before the shuffle; sketches of parts (days, say) merge to those of the whole without reading rows
again. Up to 2 ** LG items of a set all sizes are exact, beyond they are estimates with a standard error of about 1 / sqrt(2 ** LG) of the union.

Cases: null items don't count; an empty set has size 0; without groups an empty table gives one row of zeros, with groups none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG = 14


def set_sketches(df: DataFrame, by: list[str], item: str, sets: dict[str, Column], lg: int = LG) -> DataFrame:
    """by and one sketch a set (name to a condition): the items of the rows that meet it."""
    return df.groupBy(*by).agg(*[F.theta_sketch_agg(F.when(condition, F.col(item)), lg).alias(name) for name, condition in sets.items()])


def merged_sets(sketches: DataFrame, by: list[str], sets: list[str], lg: int = LG) -> DataFrame:
    """Sketches of coarser groups from those of finer ones."""
    return sketches.groupBy(*by).agg(*[F.theta_union_agg(s, lg).alias(s) for s in sets])


def size_of(sketch: Column) -> Column:
    return F.theta_sketch_estimate(sketch)


def both(a: str, b: str) -> Column:
    return size_of(F.theta_intersection(F.col(a), F.col(b)))


def either(a: str, b: str, lg: int = LG) -> Column:
    return size_of(F.theta_union(F.col(a), F.col(b), lg))


def only(a: str, b: str) -> Column:
    """Items of a that aren't in b."""
    return size_of(F.theta_difference(F.col(a), F.col(b)))
