"""Several groupings of one scan: grouping sets, rollup and cube.

Rows are first grouped by all columns, and only these groups are expanded to the sets, so a row isn't sent, or even
combined, once a set. That holds for counts, sums, smallest and largest values, which is what is given; means are sums by counts.

Cases: a null in a column is a value of its own, told from a column that is left out by grouping_id (the first column is the
highest bit, 1 if it is left out); the empty set gives one row of totals, none for an empty table, as a grouping by columns does; a set that is named
twice is given once.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_AGAIN = {"sum": F.sum, "min": F.min, "max": F.max}


def rollup(columns: list[str]) -> list[list[str]]:
    return [columns[:k] for k in range(len(columns), -1, -1)]


def cube(columns: list[str]) -> list[list[str]]:
    return [list(s) for k in range(len(columns), -1, -1) for s in combinations(columns, k)]


def grouping_sets(df: DataFrame, columns: list[str], sets: list[list[str]], measures: dict[str, tuple[str, Column]]) -> DataFrame:
    """columns, grouping_id, n and the measures (new name to sum, min or max and of what) of each group of each set."""
    if unknown := {c for s in sets for c in s} - set(columns):
        raise ValueError(f"sets of columns that aren't grouped by: {sorted(unknown)}")
    if wrong := {how for how, _ in measures.values()} - set(_AGAIN):
        raise ValueError(f"measures that can't be combined from groups: {sorted(wrong)}")
    finest = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"), *[_AGAIN[how](c).alias(new) for new, (how, c) in measures.items()])
    wanted = list(dict.fromkeys(tuple(c for c in columns if c in s) for s in sets))
    again = [F.sum("n").alias("n"), *[_AGAIN[how](new).alias(new) for new, (how, _) in measures.items()]]
    found = finest.groupingSets([[F.col(c) for c in s] for s in wanted], *columns).agg(F.grouping_id(*columns).cast("long").alias("grouping_id"), *again)
    return found.where("n is not null").select(*columns, "grouping_id", "n", *measures)
