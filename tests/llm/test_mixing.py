import re
from collections import defaultdict

import pytest
from lumenfold.llm import mixing


def goals(sizes):
    """Targets by sharing the excess again and again."""
    names = sorted((x for x in sizes if x is not None)) + [None] * (None in sizes)
    weight = {x: (5, 2, 1)[k % 3] for k, x in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        share = {x: left * weight[x] / sum(weight[y] for y in open_) for x in open_}
        full = {x for x in open_ if share[x] > 3 * sizes[x]}
        if not full:
            return target | share
        for x in full:
            target[x] = 3.0 * sizes[x]
        open_ -= full
        left = sum(sizes.values()) - sum(target.values())
    return target


def check(rows, found):
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    by = sorted(((str(r.doc_id), r.size, r.source_size) for r in found))
    assert by == sorted((str(r.doc_id), len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), sizes[r.source]) for r in rows)
    want = goals(sizes)
    source = defaultdict(set)
    for r in rows:
        source[str(r.doc_id)].add(r.source)
    for r in found:
        assert 0 <= r.taken <= 3 * r.size
        (s,) = source[str(r.doc_id)] if len(source[str(r.doc_id)]) == 1 else ("?",)
        if s != "?":
            assert r.target == pytest.approx(want[s])
            taken[s] += r.taken
    return taken, want


def test_documents(docs):
    taken, want = check(docs.collect(), mixing.mix(docs).collect())
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)


def test_odd_rows(odd, empty):
    check(odd.collect(), mixing.mix(odd).collect())
    assert mixing.mix(empty).count() == 0


def test_ranges_do_not_matter(docs, monkeypatch):
    whole = sorted(mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "RANGE_ROWS", 2)
    monkeypatch.setattr(mixing, "BINS", 7)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(mixing.mix(docs).collect()) == whole


def test_mixed_rows_have_the_words(docs):
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert words == {r.doc_id: r.taken for r in mixing.mix(docs).collect() if r.taken}


def test_better_documents_are_taken_more_often(spark):
    rows = [(i, "word here and there" if i % 2 else "1234 5678 90 12", "en", "a" if i < 4000 else "b", 0) for i in range(8000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    part = [r for r in mixing.mix(df).collect() if r.target < r.source_size]
    good, bad = (sum(r.taken > 0 for r in part if r.doc_id % 2 == k) for k in (1, 0))
    assert good > 2 * bad


@pytest.mark.parametrize("low", [0.05, 0.001])
def test_no_range_is_larger_with_uneven_qualities(spark, low, monkeypatch):
    """A tenth of a source's rows has a far lower quality, so their keys lie far apart; the bin in which the budget ends stays bounded."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", 500)
    monkeypatch.setattr(mixing, "BINS", 64)
    quality = mixing.F.when(mixing.F.col("doc_id") % 10 == 0, low).otherwise(1.0)
    rows = spark.range(60_000).select(mixing.F.col("id").alias("doc_id"), mixing.F.when(mixing.F.col("id") % 5 == 0, "b").otherwise("a").alias("source"), mixing.F.lit(3).cast("long").alias("size"), mixing.F.lit(0).cast("long").alias("tie"))
    rows = rows.withColumn("key", mixing.key_of(mixing.F.col("doc_id"), quality)).persist()
    for budget in (5, 60_000, 140_000, 143_990):
        goals = rows.groupBy("source").agg(mixing.F.count(mixing.F.lit(1)).alias("n"), mixing.F.min("key").alias("low"), mixing.F.max("key").alias("high")).withColumn("budget", mixing.F.least(mixing.F.lit(budget), mixing.F.col("n") * 3 - 1).cast("long"))
        for r in mixing.ends(rows, goals).collect():
            keys = sorted(x.key for x in rows.where(mixing.F.col("source") == r.e_source).select("key").collect())
            inside = [k for k in keys if r.low <= k <= r.high]
            assert len(inside) == r.n <= 500 and r.base == 3 * sum(k < r.low for k in keys) < r.budget <= r.base + 3 * len(inside)
    rows.unpersist()


def test_many_rows_of_one_key(spark):
    rows = [(7, "one two three", "en", "a", 0)] * 6000 + [(i, "one two three", "en", "b", 0) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = mixing.mix(df).collect()
    check(df.collect(), found)
    assert len({r.taken for r in found if r.doc_id == 7 and r.source_size == 18000}) <= 2
