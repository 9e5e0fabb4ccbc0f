"""Intersection and difference of tables with multiplicity: how often a row stands in both, or more often in one.

Both tables are counted by row in one aggregation, combined before the shuffle, so a row that a third of a table consists of is one row a
task. Results are counts of copies; `repeated` makes rows of them.

Cases: null is equal to null; tables must have the same columns, of the same types; a name n_left or n_right is refused; empty tables count for nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def copies(left: DataFrame, right: DataFrame) -> DataFrame:
    """The different rows of both tables with n_left and n_right, how often each has them."""
    if left.dtypes != right.dtypes:
        raise ValueError(f"tables of the same columns are needed, not {left.dtypes} and {right.dtypes}")
    if taken := {"n_left", "n_right"} & set(left.columns):
        raise ValueError(f"names of the counts: {sorted(taken)}")
    side = lambda df, a, b: df.withColumns({"n_left": F.lit(a).cast("long"), "n_right": F.lit(b).cast("long")})
    return side(left, 1, 0).unionByName(side(right, 0, 1)).groupBy(*left.columns).agg(F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right"))


def in_both(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of INTERSECT ALL, each once with n, its copies."""
    n = F.least("n_left", "n_right")
    return copies(left, right).where(n > 0).select(*left.columns, n.alias("n"))


def more_in_left(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of EXCEPT ALL, each once with n, its copies."""
    n = F.col("n_left") - F.col("n_right")
    return copies(left, right).where(n > 0).select(*left.columns, n.alias("n"))


def repeated(rows: DataFrame, n: str = "n") -> DataFrame:
    """Each row as often as its `n` says."""
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).drop("_copy", n)
