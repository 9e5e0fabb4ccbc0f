"""Exact quantiles by mergeable rank sketches, without sorting a group.

A KLL sketch of a group tells between which two values a rank lies. The rows below are counted, the rows between are sketched
again, until few are left; their values are counted and added up. A sketch may err in a few cases of a hundred: then the rank isn't between
its values, which the counts show, and the next round goes on with the rows on the other side. A round reads the rows twice and keeps
about a thirtieth of those between, so there are about log(rows) / log(30) rounds; groups are combined before every shuffle.

The quantile for a share q of n values is the value at rank ceil(q * n), the first for q = 0. Cases: nulls and values that aren't numbers
(NaN) don't count; rows without a group are a group of their own; a group without values, and an empty table, give no row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.sources.shared import checkpointed

#: Values of a sketch, the steps of ranks that it is asked for (a rank is looked for one step to either side), and rows between
#: two values that are counted value by value.
SKETCH, STEPS, FEW = 400, 100, 100_000


def rank_sketches(df: DataFrame, by: list[str], value: str, size: int = SKETCH) -> DataFrame:
    """by and sketch: one rank sketch a group. Sketches of parts of a group are merged by `merged`."""
    return df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), size).alias("sketch"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of coarser groups from those of finer ones."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def _around(share: Column, sketch: str) -> tuple[Column, Column, Column]:
    """The values of a sketch by steps, and those a step or two below and above the rank `share` (0 to 1)."""
    grid = F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(k / STEPS) for k in range(STEPS + 1)]))
    value = lambda k: F.get(F.col("_grid"), F.greatest(F.lit(0), F.least(F.lit(STEPS), k)).cast("int"))
    return grid.alias("_grid"), value(F.floor(share * STEPS) - 1).alias("from"), value(F.ceil(share * STEPS) + 1).alias("to")


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], few: int = FEW, size: int = SKETCH) -> DataFrame:
    """by, n and the exact quantiles (new name to share) of each group."""
    keys = [f"_k{n}" for n in range(len(by))]
    number = F.col(value).cast("double")
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(number)).select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], number.alias("_v"))
    if not keys:
        rows, keys = rows.withColumn("_all", F.lit(0)), ["_all"]
    named = {f"h{k}": k for k in keys}
    groups = rows.groupBy(*[F.col(k).alias(h) for h, k in named.items()]).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(q)).alias("q")) for name, q in shares.items()]))
    state = groups.select(*named, "n", "low", "high", F.lit(0).cast("long").alias("base"), F.col("n").alias("inside"), wanted.alias("w"))
    state = checkpointed(state.select(*named, "n", "low", "high", "base", "inside", F.col("w.name").alias("name"), F.greatest(F.ceil(F.col("w.q") * F.col("n")), F.lit(1)).cast("long").alias("rank")))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(h)) for h, k in named.items()])
    within = lambda of: rows.join(of, same & F.col("_v").between(F.col("low"), F.col("high")))  # noqa: E731  bounds of values are values, so ranges never cut equal ones
    open_ = (F.col("inside") > few) & (F.col("low") < F.col("high"))
    while not state.where(open_).isEmpty():
        target = [*named, "name"]
        sketched = within(state.where(open_)).groupBy(*target).agg(F.kll_sketch_agg_double("_v", size).alias("sketch"))
        grid, below, above = _around((F.col("rank") - F.col("base")) / F.col("inside"), "sketch")
        joined = state.join(sketched.withColumnsRenamed({c: f"s{c}" for c in target}), [F.col(c).eqNullSafe(F.col(f"s{c}")) for c in target])
        again = checkpointed(joined.select(*state.columns, grid).select(*state.columns, below, above))
        v, low, high = F.col("_v"), F.col("from"), F.col("to")
        apart = {"under": v < low, "first": v == low, "middle": (v > low) & (v < high), "last": (v == high) & (high > low), "over": v > high}
        counts = [F.sum(x.cast("long")).alias(f"n_{name}") for name, x in apart.items()]
        ends = [how(F.when(apart[name], v)).alias(f"{word}_{name}") for name in ("under", "middle", "over") for word, how in (("least", F.min), ("most", F.max))]
        counted = within(again).groupBy(*target).agg(*counts, *ends).withColumnsRenamed({c: f"s{c}" for c in target})
        both = again.join(counted, [F.col(c).eqNullSafe(F.col(f"s{c}")) for c in target])
        # the rank lies in the first of the five that reaches it; both ends are left out of what goes on, so each round has less
        upto, cases = F.col("base"), []
        for name, (least, most) in {"under": ("low", "most_under"), "first": ("from", "from"), "middle": ("least_middle", "most_middle"), "last": ("to", "to"), "over": ("least_over", "high")}.items():
            cases.append((F.col("rank") <= upto + F.col(f"n_{name}"), F.struct(F.col(least).alias("low"), F.col(most).alias("high"), upto.alias("base"), F.col(f"n_{name}").alias("inside"))))
            upto = upto + F.col(f"n_{name}")
        after = both.select(*named, "n", "name", "rank", F.coalesce(*[F.when(condition, value) for condition, value in cases]).alias("w")).select(*named, "n", "w.low", "w.high", "w.base", "w.inside", "name", "rank")
        state = checkpointed(state.where(~open_).unionByName(after))
    values = within(state).groupBy(*named, "n", "name", "rank", "base", "_v").agg(F.count(F.lit(1)).alias("count"))
    upto = F.col("base") + F.sum("count").over(Window.partitionBy(*named, "name").orderBy("_v"))  # `few` values at most
    found = values.withColumn("upto", upto).where("upto >= rank and upto - count < rank")
    wide = found.groupBy(*named, "n").pivot("name", list(shares)).agg(F.first("_v"))
    return wide.select(*[F.col(h).alias(b) for h, b in zip(named, by, strict=False)], "n", *shares)
