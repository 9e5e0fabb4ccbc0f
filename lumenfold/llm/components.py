"""Connected components by alternating large-star and small-star steps, each a join and an aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.hot import hot_keys, join_split
from lumenfold.llm.scratch import forget, written


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h


#: Rows of minima (16 bytes each) up to which they are broadcast.
BROADCAST_NODES = 2_000_000


def _with_least(rows: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`rows` with m, the smallest v of the rows of `edges` with the same u (or u itself), and the table of m.

    The minima are a written table: a small one is broadcast, so that no hub's rows meet in a task; else both sides
    are shuffled, the rows of hubs dealt over parts (`hot`).
    """
    least = written(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("m", "u")))
    minima = least.select("u", "m")
    if least.count() <= BROADCAST_NODES:
        return rows.join(F.broadcast(minima), "u"), least
    return join_split(rows, minima, ["u"], hot_keys(least, ["u"], least.agg(F.sum("n")).first()[0]), ["v"]), least


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of `edges` (u, v: of one type that can be compared).

    Minima are combined before the shuffle, so a hub costs no more than its edges; each round's edges are
    written to the shared folder and the round's before go. The number of rounds grows with the logarithm of the
    longest path.

    Cases: an edge with a null end counts for nothing; an edge from a node to itself, and one that repeats or
    is turned round, adds nothing; other columns are ignored; without edges there is no row.
    """
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(edges)
    while state[0]:
        # large star: the larger neighbours of a node move to its smallest neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        moved, large = _with_least(both.where("v > u"), both)
        moved = written(moved.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: the smaller neighbours of a node, and itself, move to the smallest of them
        joined, small = _with_least(moved, moved)
        stars = joined.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("x"))
        after = written(stars.select(F.col("x.a").alias("u"), F.col("x.b").alias("v")).where("u <> v").distinct())
        forget(edges, large, moved, small)
        before, state, edges = state, _state(after), after
        if state == before:
            break
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
