"""Frames, quantiles, sets, multiplicities, JSON and funnels against plain Python, with hot keys cut into parts."""

import collections
import datetime as dt
import math
import random

import duckdb
import pytest
from lumenfold.functions.funnel import funnel
from lumenfold.operators.frames import numbered, rolling
from lumenfold.operators.json_columns import field_types, to_columns
from lumenfold.operators.multisets import copies, in_both, more_in_left, repeated
from lumenfold.operators.quantiles import SKETCH, merged, quantiles, rank_sketches
from lumenfold.operators.sketches import both, either, merged_sets, only, set_sketches
from lumenfold.plans import measures
from pyspark.sql import functions as F

START = dt.datetime(2024, 1, 1)


def keyed(seed, n, top):
    r = random.Random(seed)
    return [(r.choice(["a", "b", None, "hot", "hot", "hot"]), r.choice([None, *[r.randrange(top)] * 9])) for _ in range(n)]


@pytest.mark.parametrize("limit", [1_000_000, 37])
def test_rolling(spark, limit):
    listed = keyed(1, 900, 3_000)
    listed += listed[:5]
    df = spark.createDataFrame([(k, x, START + dt.timedelta(seconds=x) if x is not None else None) for k, x in listed], "k string, x long, ts timestamp_ntz")
    want = sorted((str(k), x, len(v := [y for q, y in listed if q == k and y is not None and x - 300 <= y <= x]), sum(v)) for k, x in listed if x is not None)
    found = rolling(df, ["k"], "ts", 300, {"total": F.col("x")}, limit=limit)
    assert found.columns == ["k", "x", "ts", "n_rolling", "total"]
    assert sorted((str(r.k), r.x, r.n_rolling, r.total) for r in found.collect()) == want
    assert rolling(df.where("false"), ["k"], "ts", 300, {}).count() == 0


@pytest.mark.parametrize("limit", [1_000_000, 37])
def test_numbered(spark, limit):
    listed = [(k, x, n) for n, (k, x) in enumerate(keyed(2, 900, 200))]
    df = spark.createDataFrame(listed, "k string, x long, n long")
    want = []
    for k in {k for k, _, _ in listed}:
        own = sorted((x, n) for q, x, n in listed if q == k and x is not None)
        ranks = {x: i for i, x in enumerate(sorted({x for x, _ in own}), 1)}
        want += [(str(k), x, n, i, ranks[x]) for i, (x, n) in enumerate(own, 1)]
    assert sorted((str(r.k), r.x, r.n, r.row_number, r.dense_rank) for r in numbered(df, ["k"], "x", ["n"], limit=limit).collect()) == sorted(want)
    if limit < 100:  # without keys, the whole table is one
        own = sorted(x for _, x, _ in listed if x is not None)
        assert sorted((r.x, r.row_number) for r in numbered(df, [], "x", limit=limit).collect()) == list(zip(own, range(1, len(own) + 1), strict=True))


@pytest.mark.parametrize(("few", "size"), [(100_000, SKETCH), (20, 200), (5, 8)])
def test_quantiles_are_exact(spark, few, size):
    r = random.Random(3)
    listed = [(r.choice(["a", "b", None, "hot", "hot"]), r.choice([None, math.nan, r.gauss(0, 1), r.gauss(0, 100), float(r.randrange(5)), -math.inf])) for _ in range(4_000)]
    shares = {"p0": 0.0, "p10": 0.1, "median": 0.5, "p99": 0.99, "top": 1.0}
    want = []
    for k in {k for k, _ in listed}:
        own = sorted(v for q, v in listed if q == k and v is not None and not math.isnan(v))
        want.append((k, len(own), *[own[max(1, math.ceil(q * len(own))) - 1] for q in shares.values()]))
    df = spark.createDataFrame(listed, "k string, v double")
    assert sorted(map(str, want)) == sorted(str(tuple(x)) for x in quantiles(df, ["k"], "v", shares, few, size).collect())
    if few == 5:
        assert quantiles(df.where("false"), ["k"], "v", shares).count() == 0
        own = sorted(v for _, v in listed if v is not None and not math.isnan(v))
        assert tuple(quantiles(df, [], "v", {"median": 0.5}, few, size).first()) == (len(own), own[math.ceil(len(own) / 2) - 1])


def test_merged_rank_sketches_stay_within_their_error(spark):
    df = spark.range(60_000).selectExpr("id % 3 AS k", "id % 30 AS part", "(id * 7919) % 60000 AS v")
    sketches = merged(rank_sketches(df, ["k", "part"], "v"), ["k"])
    found = sketches.select("k", *[F.kll_sketch_get_rank_double("sketch", F.lit(float(v))).alias(f"r{v}") for v in (600, 15_000, 30_000, 59_000)]).collect()
    assert len(found) == 3
    for r in found:
        for v in (600, 15_000, 30_000, 59_000):
            assert abs(r[f"r{v}"] - v / 60_000) < 0.015


def test_sets(spark):
    df = spark.range(50_000).selectExpr("id", "id % 7 AS day", "id % 2 = 0 AS even", "id % 3 = 0 AS third").withColumn("item", F.when(F.col("id") % 11 > 0, F.col("id")))
    sets = {"even": F.col("even"), "third": F.col("third"), "none": F.lit(False)}
    of = lambda sketches, lg=14: sketches.select(both("even", "third").alias("both"), either("even", "third", lg).alias("either"), only("even", "third").alias("only"), both("even", "none").alias("none")).first()
    items = [k for k in range(50_000) if k % 11]
    want = (sum(k % 6 == 0 for k in items), sum(k % 2 == 0 or k % 3 == 0 for k in items), sum(k % 2 == 0 and k % 3 > 0 for k in items), 0)
    exact = of(merged_sets(set_sketches(df, ["day"], "item", sets, lg=17), [], list(sets), lg=17), 17)
    assert tuple(exact) == want
    rough = of(merged_sets(set_sketches(df, ["day"], "item", sets, lg=12), [], list(sets), lg=12), 12)
    assert rough.none == 0 and all(abs(x - y) < 5 * want[1] / 64 for x, y in zip(rough[:3], want[:3], strict=True))
    assert tuple(of(set_sketches(df.where("false"), [], "item", sets))) == (0, 0, 0, 0)


def test_user_sets_equal_sql_beyond_a_sketch(spark, tmp_path):
    """30,000 users of a week, and null users, times and types."""
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    rows = spark.range(60_000).select(F.when(F.col("id") % 997 > 0, F.col("id") % 30_011).alias("user_id"), F.when(F.col("id") % 991 > 0, start + F.make_dt_interval(F.col("id") % 9)).alias("ts"), F.element_at(F.array(*map(F.lit, ("click", "purchase", "view")), F.lit(None)), ((F.col("id") * 7919) % 4 + 1).cast("int")).alias("event_type"))
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = db.execute(measures.ORACLE_SQL["ext_user_sets"]).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(x)) for x in measures.ext_user_sets(spark, str(tmp_path)).collect()) and len(want) == 3


def test_multisets(spark):
    r = random.Random(4)
    make = lambda n: [(r.choice(["x", "y", None]), r.choice([1, 2, None])) for _ in range(n)] + [("hot", 1)] * n
    a, b = make(60), make(40)
    left, right = (spark.createDataFrame(x, "k string, v int") for x in (a, b))
    count = lambda rows: collections.Counter(map(tuple, rows))
    assert count(repeated(in_both(left, right)).collect()) == count(a) & count(b)
    assert count(repeated(more_in_left(left, right)).collect()) == count(a) - count(b)
    assert count(left.intersectAll(right).collect()) == count(a) & count(b)
    assert in_both(left, right.where("false")).count() == 0 and more_in_left(left, left).count() == 0
    with pytest.raises(ValueError, match="same columns"):
        copies(left, right.withColumn("v", F.lit("x")))
    with pytest.raises(ValueError, match="names of the counts"):
        copies(left.withColumnRenamed("v", "n_left"), right.withColumnRenamed("v", "n_left"))


def test_json(spark):
    texts = ['{"k": 1, "tags": ["x"], "in": {"a": 1.5}}', '{"k": 2, "mixed": "text", "odd name": true}', '{"mixed": 7, "none": null}', "{}", "[1]", "7", "null", "{broken", "", None, '{"k": 3} x']
    df = spark.createDataFrame(list(enumerate(texts)), "id long, j string")
    rows, apart = to_columns(df, "j")
    assert sorted(r.id for r in apart.collect()) == [4, 5, 6, 7, 8, 9] and apart.columns == ["id", "j"]
    got = {r.id: r for r in rows.collect()}
    assert sorted(got) == [0, 1, 2, 3, 10] and got[10].k == 3 and [got[k].k for k in range(4)] == [1, 2, None, None]
    assert got[0].tags == ["x"] and float(got[0]["in"].a) == 1.5 and got[1]["odd name"] is True
    assert [got[k].mixed for k in range(4)] == [None, "text", "7", None] and got[2].none is None
    assert field_types(df.where("id between 4 and 9"), "j") is None and to_columns(df.where("id between 4 and 9"), "j")[0].columns == ["id", "j"]
    with pytest.raises(ValueError, match="fields with names of columns"):
        to_columns(df.withColumn("k", F.lit(1)), "j")


def test_funnel(spark):
    r = random.Random(5)
    listed = [(n, r.choice([1, 1, 1, 2, None]), START + dt.timedelta(seconds=r.randrange(4_000)), r.choice(["click", "view", "purchase", "other", None])) for n in range(800)]
    df = spark.createDataFrame(listed, "id long, user long, ts timestamp, kind string")
    want = []
    for user in (1, 2):
        first = pair = None
        for ts, n, kind in sorted((ts, n, kind) for n, u, ts, kind in listed if u == user and kind in ("click", "view", "purchase")):
            if kind == "click":
                first = (ts, n)
            elif kind == "view":
                pair = (first, n)
            elif pair and pair[0] and (gone := ts - pair[0][0]) <= dt.timedelta(seconds=60):
                want.append((user, pair[0][1], pair[1], n, gone // dt.timedelta(microseconds=1)))
    found = funnel(df, "user", "ts", "id", "kind", ("click", "view", "purchase"), 60)
    assert sorted(map(tuple, found.collect())) == sorted(want) and want
    assert funnel(df.where("false"), "user", "ts", "id", "kind", ("click", "view", "purchase"), 60).count() == 0
