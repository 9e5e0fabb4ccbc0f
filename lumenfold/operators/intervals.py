"""Interval join: the pairs of rows whose intervals overlap, of equal keys if any are given.

Intervals are covered by bins of ascending width. An interval's own level is that of the smallest bins that are wider than it, of which it
touches two at most; on every higher level it touches two at most as well. Two intervals meet on the higher of their own
levels, so each row is sent to its own bins and to those of the higher levels that the other side has: 2 rows a level, however
long an interval is. Rows of equal key, level and bin are joined by an equi-join; of the bins that a pair shares the last of
both first bins keeps it, so each pair comes once. What overlaps is decided by the bounds themselves. Bins with very many left rows
are dealt over parts (`parts`).

Cases: bounds may be timestamps, dates or numbers, of one type; an interval that ends before it starts, or has a null bound or key, overlaps
nothing; one of length nought is a point if its end belongs to it, else it holds nothing; rows that repeat are pairs of their own; empty
tables give no row. All overlapping pairs are results, so their number is what the data say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.parts import HOT_ROWS, join_dealt, place


def _level(length: Column) -> Column:
    """The smallest k with length < 2 ** k."""
    return F.when(length == 0, 0).otherwise(F.length(F.bin(length)))


def _levelled(df: DataFrame, bounds: tuple[str, str], by: list[str], end_belongs: bool, side: str) -> DataFrame:
    """row, keys, start and end, their places, and the own level of the intervals that hold something."""
    start, end = bounds
    kind = df.schema[start].dataType
    if kind != df.schema[end].dataType:
        raise TypeError(f"bounds of one type are needed, not {kind.simpleString()} and {df.schema[end].dataType.simpleString()}")
    holds = F.col(start) <= F.col(end) if end_belongs else F.col(start) < F.col(end)
    for b in by:
        holds = holds & F.col(b).isNotNull()
    rows = df.where(holds).select(
        F.struct("*").alias(f"{side}_row"),
        *[F.col(b).alias(f"_k{n}") for n, b in enumerate(by)],
        F.col(start).alias(f"{side}_start"),
        F.col(end).alias(f"{side}_end"),
        place(F.col(start), kind).alias(f"{side}_low"),
        place(F.col(end), kind).alias(f"{side}_high"),
    )
    return rows.withColumn(f"{side}_own", _level(F.col(f"{side}_high") - F.col(f"{side}_low")))


def _covered(rows: DataFrame, side: str, others: list[int]) -> DataFrame:
    """`rows` once for each of their bins (level, bin), on their own level and the higher ones among `others`."""
    own = F.col(f"{side}_own")
    higher = F.filter(F.array(*[F.lit(x) for x in others]).cast("array<int>"), lambda x: x > own)
    levels = rows.withColumn("_level", F.explode(F.concat(F.array(own), higher)))
    bin_of = lambda c: F.expr(f"shiftright({side}_{c}, _level)")
    return levels.withColumn(f"{side}_first", bin_of("low")).withColumn("_bin", F.explode(F.sequence(bin_of("low"), bin_of("high"))))


def interval_join(
    left: DataFrame,
    right: DataFrame,
    left_bounds: tuple[str, str],
    right_bounds: tuple[str, str],
    by: list[str] | None = None,
    *,
    left_end_belongs: bool = True,
    right_end_belongs: bool = True,
    limit: int = HOT_ROWS,
) -> DataFrame:
    """Columns of both tables (the keys `by` once) of the pairs that overlap. A point is an interval from it to itself."""
    by = list(by or [])
    if clash := (set(left.columns) & set(right.columns)) - set(by):
        raise ValueError(f"names that are in both tables: {sorted(clash)}")
    if (a := left.schema[left_bounds[0]].dataType) != (b := right.schema[right_bounds[0]].dataType):
        raise TypeError(f"bounds of one type are needed, not {a.simpleString()} and {b.simpleString()}")
    lefts, rights = _levelled(left, left_bounds, by, left_end_belongs, "l"), _levelled(right, right_bounds, by, right_end_belongs, "r")
    levels = lambda df, own: sorted(r[0] for r in df.select(own).distinct().collect())  # noqa: E731  64 at most
    on_left, on_right = levels(lefts, "l_own"), levels(rights, "r_own")
    keys = [*[f"_k{n}" for n in range(len(by))], "_level", "_bin"]
    met = join_dealt(_covered(lefts, "l", on_right), _covered(rights, "r", on_left), keys, limit)
    met = met.where((F.col("_level") == F.greatest("l_own", "r_own")) & (F.col("_bin") == F.greatest("l_first", "r_first")))
    reaches = lambda start, end, belongs: F.col(start) <= F.col(end) if belongs else F.col(start) < F.col(end)
    met = met.where(reaches("l_start", "r_end", right_end_belongs) & reaches("r_start", "l_end", left_end_belongs))
    return met.select("l_row.*", *[F.col(f"r_row.`{c}`") for c in right.columns if c not in by])
