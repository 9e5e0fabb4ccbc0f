"""As-of and interval joins, sessions and grouping sets against plain Python, with hot keys cut into parts."""

import datetime as dt
import itertools
import random

import pytest
from lumenfold.operators.asof import asof_join
from lumenfold.operators.groupings import cube, grouping_sets, rollup
from lumenfold.operators.intervals import interval_join
from lumenfold.operators.sessions import sessions
from pyspark.sql import functions as F

DAY = dt.datetime(2024, 3, 30)


def time(minutes):
    return None if minutes is None else DAY + dt.timedelta(minutes=minutes)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(seed, n, keys, span):
    r = random.Random(seed)
    key = lambda: None if r.random() < 0.05 else "hot" if r.random() < 0.4 else r.choice(keys)
    return [(k, key(), None if r.random() < 0.05 else r.randrange(span)) for k in range(n)]


@pytest.mark.parametrize("limit", [1_000_000, 13])
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "bigint", "double"])
def test_asof(spark, limit, kind):
    lefts, rights = rows_of(1, 120, "abc", 400), rows_of(2, 150, "abd", 400)
    lefts += lefts[:5]
    value = (lambda m: m) if kind in ("bigint", "double") else (lambda m: time(m))
    cast = (lambda m: float(m) / 7 if m is not None else None) if kind == "double" else value
    of = lambda rows, name: spark.createDataFrame([(i, k, cast(m)) for i, k, m in rows], f"{name} long, k string, at {kind}")
    left, right = of(lefts, "id"), of(rights, "other")
    for strict, later in itertools.product([False, True], repeat=2):
        want = []
        for i, k, m in lefts:
            fits = [(n, j) for j, q, n in rights if None not in (k, m, n) and q == k and (n == m and not strict or (n > m if later else n < m))]
            want.append((i, (min if later else max)(fits)[1] if fits else None))
        got = asof_join(left, right, "at", ["k"], {"found": "other"}, tie=("other",), strict=strict, later=later, limit=limit)
        assert got.columns == ["id", "k", "at", "found"]
        assert sorted(map(str, want)) == sorted(str((r.id, r.found)) for r in got.collect()), (strict, later)
    if kind != "double":
        near = asof_join(left, right, "at", ["k"], {"found": "other"}, tie=("other",), within=F.lit(30) if kind == "bigint" else F.expr("INTERVAL 30 MINUTES"), limit=limit)
        want = [(i, max(fits)[1] if (fits := [(n, j) for j, q, n in rights if None not in (k, m, n) and q == k and m - 30 <= n <= m]) else None) for i, k, m in lefts]
        assert sorted(map(str, want)) == sorted(str((r.id, r.found)) for r in near.collect())


def test_asof_cases(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, None, 5), (3, "a", None)], "id long, k string, at long")
    right = spark.createDataFrame([("a", 3, None), ("a", 9, 1)], "k string, t long, v int")
    got = lambda a, b, **m: sorted(map(str, asof_join(a, b, ("at", "t"), m.pop("by", ["k"]), {"v": "v", "t": "t"}, **m).select("id", "v", "t").collect()))
    assert got(left, right) == ["Row(id=1, v=None, t=3)", "Row(id=2, v=None, t=None)", "Row(id=3, v=None, t=None)"]
    assert got(left, right.where("false")) == ["Row(id=1, v=None, t=None)", "Row(id=2, v=None, t=None)", "Row(id=3, v=None, t=None)"]
    assert got(left.where("false"), right) == []
    assert got(left, right, by=[], later=True) == ["Row(id=1, v=1, t=9)", "Row(id=2, v=1, t=9)", "Row(id=3, v=None, t=None)"]
    assert got(left, right, by=[], later=True, limit=1) == got(left, right, by=[], later=True)
    with pytest.raises(ValueError, match="names that are in the left table"):
        asof_join(left, right, ("at", "t"), ["k"], {"id": "v"})
    with pytest.raises(TypeError, match="times of one type"):
        asof_join(left, right.withColumn("t", F.lit(1.5)), ("at", "t"), ["k"], {"v": "v"})


def test_asof_ascends_over_a_change_of_clocks(spark):
    """Places of times without a zone don't depend on the session's zone, in which an hour of this day doesn't exist."""
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        left = spark.createDataFrame([(k, "hot", DAY + dt.timedelta(minutes=20 * k)) for k in range(150)], "id long, k string, at timestamp_ntz")
        right = left.where("id % 3 = 0").withColumnRenamed("id", "other")
        got = {r.id: r.found for r in asof_join(left, right, "at", ["k"], {"found": "other"}, limit=9).collect()}
        assert got == {k: k - k % 3 for k in range(150)}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_asof_makes_no_pairs(spark):
    left = spark.range(10).selectExpr("id", "id % 2 AS k", "id AS at")
    plan = plan_of(asof_join(left, left.withColumnRenamed("id", "other"), "at", ["k"], {"found": "other"}))
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("limit", [1_000_000, 20])
def test_intervals(spark, limit):
    r = random.Random(3)
    lengths = [-3, 0, 0, 1, 2, 7, 60, 500, 40_000, 1_000_000]
    of = lambda n, low: [(low + k, r.choice(["a", "b", None]), *((m := r.randrange(-500, 1500)), m + r.choice(lengths))) for k in range(n)]
    lefts, rights = of(90, 0), of(110, 1000)
    lefts += [(500, "a", None, 5), (501, "a", 5, None), lefts[3]]
    left, right = spark.createDataFrame(lefts, "l long, k string, a long, b long"), spark.createDataFrame(rights, "r long, k string, c long, d long")
    for le, re_, by in itertools.product([True, False], [True, False], [[], ["k"]]):
        inside = lambda x, y, belongs: x is not None and y is not None and (x <= y if belongs else x < y)
        want = sorted((x[0], y[0]) for x in lefts for y in rights if (not by or x[1] == y[1] is not None) and inside(x[2], x[3], le) and inside(y[2], y[3], re_) and inside(x[2], y[3], re_) and inside(y[2], x[3], le))
        found = interval_join(left if by else left.drop("k"), right if by else right.drop("k"), ("a", "b"), ("c", "d"), by, left_end_belongs=le, right_end_belongs=re_, limit=limit)
        assert sorted((x.l, x.r) for x in found.collect()) == want and want


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "double"])
def test_points_in_intervals_of_other_types(spark, kind):
    r = random.Random(4)
    make = {"date": lambda m: (DAY + dt.timedelta(days=m)).date(), "double": lambda m: m / 3}.get(kind, lambda m: DAY + dt.timedelta(seconds=m / 3))
    spans = [(k, make(m := r.randrange(1000)), make(m + r.choice([0, 1, 2, 50, 900]))) for k in range(60)]
    points = [(k, make(r.randrange(2000))) for k in range(80)]
    found = interval_join(spark.createDataFrame(spans, f"s long, a {kind}, b {kind}"), spark.createDataFrame(points, f"p long, t {kind}"), ("a", "b"), ("t", "t"), left_end_belongs=False)
    assert sorted((x.s, x.p) for x in found.collect()) == sorted((s, p) for s, a, b in spans for p, t in points if a <= t < b)


def test_interval_plan_and_cases(spark):
    left, right = spark.createDataFrame([(1, 0, 9)], "l long, a long, b long"), spark.createDataFrame([(2, 3, 3)], "r long, c long, d long")
    plan = plan_of(interval_join(left, right, ("a", "b"), ("c", "d")))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert interval_join(left, right.where("false"), ("a", "b"), ("c", "d")).count() == interval_join(left.where("false"), right, ("a", "b"), ("c", "d")).count() == 0
    long = spark.createDataFrame([(1, -(1 << 40), 1 << 40)], "l long, a long, b long")
    assert interval_join(long, right, ("a", "b"), ("c", "d")).count() == 1  # two bins, whatever its length
    ends = spark.createDataFrame([(1, -(1 << 63), (1 << 63) - 1), (2, (1 << 63) - 2, (1 << 63) - 1)], "l long, a long, b long")
    points = spark.createDataFrame([(5, -(1 << 63)), (6, (1 << 63) - 1), (7, 0)], "r long, t long")
    assert sorted((x.l, x.r) for x in interval_join(ends, points, ("a", "b"), ("t", "t")).collect()) == [(1, 5), (1, 6), (1, 7), (2, 6)]
    with pytest.raises(ValueError, match="names that are in both"):
        interval_join(left, left, ("a", "b"), ("a", "b"))
    with pytest.raises(TypeError, match="bounds of one type"):
        interval_join(left, right.withColumn("c", F.lit("x")).withColumn("d", F.lit("x")), ("a", "b"), ("c", "d"))


def plain_sessions(rows, gap):
    out = []
    for k in {r[0] for r in rows}:
        session = []
        for t, v in sorted((r[1], r[2]) for r in rows if r[0] == k and r[1] is not None):
            if session and t - session[-1][0] > gap:
                out.append((k, session))
                session = []
            session.append((t, v))
        out += [(k, session)] if session else []
    return sorted(((k, s[0][0], s[-1][0] + gap, len(s), sum(v for _, v in s)) for k, s in out), key=str)


def test_sessions(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "b", None, "hot", "hot"]), r.randrange(40_000), r.randrange(9)) for _ in range(600)]
    rows += [("gap", 100 * k, 1) for k in range(5)] + [("gap", 1000, 1), ("gap", 1101, 2), ("old", -150, 1), ("old", -50, 1), ("old", 50, 1), ("old", None, 7)] + rows[:4]
    seconds = lambda t: None if t is None else dt.datetime(1970, 1, 1) + dt.timedelta(seconds=t)
    df = spark.createDataFrame([(k, seconds(t), v) for k, t, v in rows], "k string, at timestamp, v long")
    found = sessions(df, ["k"], "at", 100, {"total": F.col("v")})
    want = sorted(((k, seconds(a), seconds(b), n, v) for k, a, b, n, v in plain_sessions(rows, 100)), key=str)
    assert sorted(map(tuple, found.collect()), key=str) == want
    built_in = df.where("at is not null").groupBy("k", F.session_window("at", "100 seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v")).select("k", "w.start", "w.end", "n", "v")
    assert sorted(map(tuple, built_in.collect()), key=str) == want
    assert sessions(df.where("false"), ["k"], "at", 100).count() == 0


def test_grouping_sets(spark):
    r = random.Random(6)
    rows = [(r.choice(["x", "y", None]), r.choice([1, 2, None]), r.choice("pq"), r.randrange(100)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a string, b int, c string, v long")
    sets = cube(["a", "b", "c"])
    assert len(sets) == 8 and rollup(["a", "b"]) == [["a", "b"], ["a"], []]
    found = grouping_sets(df, ["a", "b", "c"], [*sets, ["b", "a"]], {"total": ("sum", F.col("v")), "least": ("min", F.col("v")), "most": ("max", F.col("v"))})
    want = []
    for s in sets:
        groups = {}
        for row in rows:
            groups.setdefault(tuple(x if c in s else None for c, x in zip("abc", row, strict=False)), []).append(row[3])
        mark = sum((c not in s) << (2 - k) for k, c in enumerate("abc"))
        want += [(*k, mark, len(v), sum(v), min(v), max(v)) for k, v in groups.items()]
    assert sorted(map(str, want)) == sorted(str(tuple(x)) for x in found.collect())
    plan = plan_of(grouping_sets(df, ["a", "b", "c"], sets, {}))
    assert plan.count("Scan") == 1 and plan.index("Expand") < plan.rindex("HashAggregate")
    assert grouping_sets(df.where("false"), ["a"], [["a"], []], {}).count() == 0
    with pytest.raises(ValueError, match="can't be combined"):
        grouping_sets(df, ["a"], [["a"]], {"x": ("avg", F.col("v"))})
    with pytest.raises(ValueError, match="aren't grouped by"):
        grouping_sets(df, ["a"], [["b"]], {})
