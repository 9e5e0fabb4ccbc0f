"""Semi and anti joins and first rows against plain Python, with hot keys dealt over parts."""

import random

import pytest
from lumenfold.operators.firsts import first_rows
from lumenfold.operators.matching import having, lacking, not_among
from pyspark.sql import functions as F

LEFT, RIGHT = "k string, j int, n long", "a string, j int, n string"


def tables(spark, seed=1):
    r = random.Random(seed)
    key = lambda: (r.choice(["hot", "hot", "hot", None, *"abcdef"]), r.choice([1, 1, 1, 2, 3, None]))
    left = [(*key(), r.randrange(40)) for _ in range(600)]
    right = [(*key(), "x") for _ in range(12)] * 3
    return left, right, spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)


def listed(df):
    return sorted(map(str, df.collect()))


def rows_of(spark, wanted):
    return listed(spark.createDataFrame(wanted, LEFT))


@pytest.mark.parametrize(("limit", "few"), [(1_000_000, 500_000), (1_000_000, 0), (20, 0)])
def test_having_and_lacking(spark, limit, few):
    left, right, a, b = tables(spark)
    both = {(x, y) for x, y, _ in right if x is not None and y is not None}
    on = [("k", "a"), "j"]
    assert listed(having(a, b, on, limit, few)) == rows_of(spark, [x for x in left if x[:2] in both])
    assert listed(lacking(a, b, on, limit, few)) == rows_of(spark, [x for x in left if x[:2] not in both])
    one = {x for x, _, _ in right}
    assert listed(having(a, b, [("k", "a")], limit, few)) == rows_of(spark, [x for x in left if x[0] is not None and x[0] in one])
    none = b.where("false")
    assert having(a, none, on, limit, few).count() == 0 and listed(lacking(a, none, on, limit, few)) == listed(a)
    assert having(a.where("false"), b, on, limit, few).count() == 0 == lacking(a.where("false"), b, on, limit, few).count()


@pytest.mark.parametrize(("limit", "few"), [(1_000_000, 500_000), (20, 0)])
def test_not_among(spark, limit, few):
    left, right, a, b = tables(spark)
    known = {x for x, _, _ in right if x is not None}
    assert not_among(a, b, ("k", "a"), limit, few).count() == 0  # a null may be any key
    assert listed(not_among(a, b.where("a is not null"), ("k", "a"), limit, few)) == rows_of(spark, [x for x in left if x[0] is not None and x[0] not in known])
    assert listed(not_among(a, b.where("false"), ("k", "a"), limit, few)) == listed(a)
    a.createOrReplaceTempView("a"), b.where("a is not null").createOrReplaceTempView("b")
    assert listed(not_among(a, b.where("a is not null"), ("k", "a"), limit, few)) == listed(spark.sql("SELECT * FROM a WHERE k NOT IN (SELECT a FROM b)"))


def test_hot_rows_that_repeat_are_dealt(spark):
    """20,000 equal rows of one key aren't one task's."""
    left = spark.range(0, 20_000, 1, 16).select(F.lit("hot").alias("k"))
    right = spark.createDataFrame([("hot",), ("cold",)], "k string")
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in having(left, right, ["k"], limit=1_000, few=0).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set(name, before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 20_000 and len(sizes) > 1


def test_few_keys_shuffle_no_left_row(spark):
    _, _, a, b = tables(spark)
    plan = having(a, b, [("k", "a")])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_names_that_the_join_uses(spark):
    with pytest.raises(ValueError):
        having(spark.range(3).withColumn("_deal", F.lit(1)), spark.range(3), ["id"])
    with pytest.raises(ValueError):
        lacking(spark.range(3), spark.range(3), [])


@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("down", [False, True])
def test_first_rows(spark, ties, down):
    r = random.Random(4)
    listed_rows = [(r.choice(["hot", "hot", "a", "b", None]), r.choice([None, *range(12)]), n) for n in range(500)]
    df = spark.createDataFrame(listed_rows, "k string, x int, n long")
    order = [("-x" if down else "x"), *([] if ties else ["n"])]
    place = lambda x: (x[1] is None, 0 if x[1] is None else -x[1] if down else x[1])
    for by in (["k"], []):
        want = []
        for key in {x[0] for x in listed_rows} if by else {0}:
            own = sorted((x for x in listed_rows if not by or x[0] == key), key=lambda x: (place(x), x[2]))
            for at, x in enumerate(own, 1):
                rank = 1 + sum(place(y) < place(x) for y in own) if ties else at
                if rank <= 5:
                    want.append((*x, rank))
        found = first_rows(df, by, order, 5, ties)
        assert sorted(map(str, (tuple(x) for x in found.collect()))) == sorted(map(str, want))
        assert first_rows(df, by, order, 0, ties).count() == 0 == first_rows(df.where("false"), by, order, 5, ties).count()


def test_few_rows_of_a_key_are_shuffled(spark):
    df = spark.range(0, 40_000, 1, 4).select((F.col("id") % 3).alias("k"), F.col("id").alias("x"))
    found = first_rows(df, ["k"], ["-x"], 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")
    assert {(r.k, r.x) for r in found.collect()} == {(0, 39_999), (0, 39_996), (1, 39_997), (1, 39_994), (2, 39_998), (2, 39_995)}
    with pytest.raises(ValueError):
        first_rows(df, ["k"], ["x"], 2, rank="x")
