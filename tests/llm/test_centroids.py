import hashlib
import math
import random

import numpy as np
import pytest
from lumenfold.llm import centroids
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("cluster", T.StringType()), T.StructField("x", T.IntegerType())])


def plain(rows, k, rounds, dimensions):
    """Every vector against every centroid."""
    kept = [(i, [math.floor(256 * float(v)) for v in e]) for i, e in rows if e is not None and len(e) == dimensions and all(v is not None and math.isfinite(v) for v in e)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centers = [x for _, x in order[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(centers))

    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in kept]
        for n in set(own):
            mine = [x for (_, x), m in zip(kept, own, strict=True) if m == n]
            centers[n] = [sum(v) // len(mine) for v in zip(*mine, strict=True)]
    last = [(i, *nearest(x)) for i, x in kept]
    inertia = {n: sum(d for _, d, m in last if m == n) for _, _, n in last}
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted((str(i), n, d, inertia[n], sum(inertia.values()), name[n]) for i, d, n in last)


def found(df, **more):
    return sorted((str(r.vec_id), *r[1:]) for r in centroids.cluster(df, **more).collect())


def of(spark, rows):
    return spark.createDataFrame([(i, e, "?", 1) for i, e in rows], SCHEMA)


def test_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert found(df) == plain([(r.vec_id, r.embedding) for r in df.collect()], 40, 5, 64)


def test_odd_vectors_ties_and_repeats(spark):
    nan, inf = math.nan, math.inf
    r = random.Random(3)
    rows = [(k, [r.choice([-2.0, -0.5, 0.0, 0.25, 3.0]) * 4**r.randrange(4) for _ in range(3)]) for k in range(150)]
    rows += rows[:20] + [(7, [1.0, 1.0, 1.0]), (None, [1.0, 2.0, 3.0]), (None, [0.0, 0.0, 0.0])]
    bad = [(900, None), (901, []), (902, [1.0, 2.0]), (903, [1.0, nan, 2.0]), (904, [inf, 1.0, 2.0]), (905, [1.0, None, 2.0]), (906, [0.0] * 4), (907, [-inf, 0.0, 0.0])]
    for k in (40, 7, 1):
        assert found(of(spark, rows + bad), k=k, dimensions=3) == plain(rows, k, 5, 3)
    assert found(of(spark, rows[:4]), dimensions=3) == plain(rows[:4], 40, 5, 3)
    assert found(of(spark, bad), dimensions=3) == []
    assert found(of(spark, []), dimensions=3) == []


def test_hot_vector(spark):
    rows = [(k, [0.5, -0.25]) for k in range(300)] + [(k, [k / 7, k / 9]) for k in range(300, 600)]
    assert found(of(spark, rows), dimensions=2, rounds=2) == plain(rows, 40, 2, 2)


def test_annulus_leaves_out_what_is_farther_and_nothing_else():
    rng = np.random.default_rng(1)
    centers = rng.integers(-50, 50, (40, 8)) * rng.integers(1, 60, (40, 1))
    x = rng.integers(-50, 50, (2000, 8)) * rng.integers(1, 60, (2000, 1))
    number, apart = centroids.nearest(x, centers)
    every = ((x[:, None] - centers[None]) ** 2).sum(2)
    assert (number == every.argmin(1)).all() and (apart == every.min(1)).all()


def test_equally_near_on_the_boundary():
    centers = np.array([[10, 0], [-10, 0], [0, 10], [0, -10], [10, 0]])
    number, apart = centroids.nearest(np.array([[0, 0], [10, 10], [-3, 0], [1 << 26, 0]]), centers)
    assert number.tolist() == [0, 0, 1, 0] and apart[:3].tolist() == [100, 100, 49]


def test_large_components_are_refused(spark):
    with pytest.raises(Exception, match="squared distances don't fit"):
        centroids.cluster(of(spark, [(1, [3.0e38, 0.0])]), dimensions=2).collect()
    rows = [(1, [500_000.0, -500_000.0]), (2, [-500_000.0, 500_000.0])]
    assert found(of(spark, rows), k=1, dimensions=2) == plain(rows, 1, 5, 2)


def test_text_ids_are_refused(spark):
    with pytest.raises(TypeError, match="vec_id must be a whole number"):
        centroids.cluster(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<float>"))
