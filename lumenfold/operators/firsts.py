"""The first k rows of each key along an order.

The filter on a rank makes Spark keep the first k rows of each key in every task before the shuffle (its window group limit), so a key with
a third of all rows sends k rows a task, and the rows that are tied with the k-th where ties are kept.

Cases: rows without a key are a key of their own; nulls come last in either direction; with `ties` all rows tied with the k-th are kept
and have one rank, without it equal rows are told apart by nothing, so give a unique last column for results that repeat; rows that
repeat count each; an empty table, or k of 0, gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, by: list[str], order: list[str], k: int, ties: bool = False, rank: str = "rank") -> DataFrame:
    """`df` with `rank` (from 1), the rows of rank k or less. order: names of columns, descending with a minus before."""
    if rank in df.columns:
        raise ValueError(f"a name that is in the table: {rank}")
    if k < 0:
        raise ValueError("k can't be negative")
    turned = [F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last() for c in order]
    number = F.rank() if ties else F.row_number()
    found = df.withColumn(rank, number.over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*turned)))
    return found.where(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("long"))
