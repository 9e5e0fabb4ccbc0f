import re

import pytest
from lumenfold.llm import hot, urls


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("", "") if not m else (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2])


def rule(host, path):
    fits = [r for r in urls.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return max(fits, key=lambda r: len(r[0] + r[1]), default=None)


def check(rows, found):
    by = {r.page_id: r for r in found}
    assert len(by) == len(rows)
    for r in rows:
        host, path = parts(r.url)
        x = rule(host, path)
        got = by[r.page_id]
        assert (got.host, got.path, got.rule) == (host, path, x[0] + x[1] if x else None)
        assert got.verdict == x[2] if x else got.verdict in ("allow", "block")


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    check(pages.collect(), urls.judge(pages).collect())


def test_odd_rows(spark):
    texts = [None, "", "no scheme", "http://", "HTTP://WWW.Example.NET/EN/x", "http://net", "http://net/", "http://xnet/", "http://a.net?x=://b.org/fr/", "x://a.org/fr/#y", "http://org/fr", "a\n://b.org/fr/z", "http://\u00c4.net/p"]
    pages = spark.createDataFrame([(k, x, None, "?") for k, x in enumerate(texts)], "page_id long, url string, html string, rank string")
    check(pages.collect(), urls.judge(pages).collect())
    assert urls.judge(pages.limit(0)).count() == 0


def page(k, host, path, *links):
    return (k, f"http://{host}{path}", " ".join(f'<a href="https://{x}/q">x</a>' for x in links))


@pytest.mark.parametrize("split", [False, True])
def test_propagation(spark, monkeypatch, split):
    if split:
        monkeypatch.setattr(hot, "HOT_ROWS", 1)
        monkeypatch.setattr(urls, "BROADCAST_BYTES", 0)
    rows = [page(0, "bad.example.com", "/de/", "x.com"), page(1, "farm.com", "/", "bad.example.com", "bad.example.com"), page(2, "second.com", "/", "farm.com"), page(3, "good.org", "/fr/", "fine.com"), page(4, "fine.com", "/"), page(5, "both.com", "/", "fine.com"), page(6, "x.com", "/")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.host: r.verdict for r in urls.judge(pages).collect()}
    assert got == {"bad.example.com": "block", "farm.com": "block", "second.com": "block", "good.org": "allow", "fine.com": "allow", "both.com": "allow", "x.com": "allow"}


def test_ranks_equal_plain(spark):
    links = [("a", "b", 2), ("b", "c", 1), ("c", "a", 1), ("a", "d", 1), ("d", "b", 3)]
    seeds = {"trust": {"a": 1.0}, "distrust": {"c": 0.5, "d": 0.5}}
    got = {(r.kind, r.host): r["rank"] for r in urls.propagate(spark.createDataFrame(links, "source string, target string, links long"), spark.createDataFrame([(k, h, w) for k, x in seeds.items() for h, w in x.items()], "kind string, host string, seed double")).collect()}
    for kind, seed in seeds.items():
        steps = [(s, t, n) if kind == "trust" else (t, s, n) for s, t, n in links]
        ranks = dict(seed)
        for _ in range(urls.ROUNDS):
            new = {h: w * (1 - urls.DAMPING) for h, w in seed.items()}
            for s, t, n in steps:
                new[t] = new.get(t, 0) + urls.DAMPING * ranks.get(s, 0) * n / sum(k for a, _, k in steps if a == s)
            ranks = new
        for h, w in ranks.items():
            assert got.get((kind, h), 0) == pytest.approx(w)


def test_hot_hosts_are_dealt_over_parts(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = spark.range(1000).select(F.when(F.col("id") < 900, "hub").otherwise(F.concat(F.lit("h"), "id")).alias("host"), "id")
    counted = rows.groupBy("host").agg(F.count("*").alias("n"))
    monkeypatch.setattr(hot, "HOT_ROWS", 100)
    keys = hot.hot_keys(counted, ["host"], 1000)
    assert [tuple(r) for r in keys.collect()] == [("hub", 9)]
    values = counted.where("n > 1 or host = 'h950'")
    joined = hot.join_split(rows, values, ["host"], keys, ["id"], "left").collect()
    assert sorted(r.id for r in joined) == list(range(1000))
    assert all(r.n == (900 if r.host == "hub" else 1 if r.host == "h950" else None) for r in joined)
    assert sorted(r.id for r in hot.join_split(rows, values, ["host"], keys, ["id"]).collect()) == [*range(900), 950]


def test_ranks_do_not_depend_on_parts(spark, monkeypatch):
    links = [("hub", f"h{k}", 1 + k % 3) for k in range(40)] + [(f"h{k}", "hub", 1) for k in range(0, 40, 2)]
    links = spark.createDataFrame(links, "source string, target string, links long")
    seeds = spark.createDataFrame([("trust", "hub", 1.0), ("distrust", "h3", 1.0)], "kind string, host string, seed double")
    ranks = lambda: {(r.kind, r.host): r["rank"] for r in urls.propagate(links, seeds, 5).collect()}
    want = ranks()
    monkeypatch.setattr(hot, "HOT_ROWS", 3)
    assert ranks() == pytest.approx(want)


def test_long_chain(spark):
    rows = [page(0, "bad.example.com", "/de/"), page(1, "h1.com", "/", "bad.example.com")]
    rows += [page(k, f"h{k}.com", "/", f"h{k - 1}.com") for k in range(2, 13)]
    got = {r.host: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {"bad.example.com": "block", **{f"h{k}.com": "block" for k in range(1, 13)}}


def test_rounds_suffice(spark):
    links = spark.createDataFrame([("a", "b", 1), ("b", "a", 1)], "source string, target string, links long")
    seeds = spark.createDataFrame([("trust", "a", 1.0)], "kind string, host string, seed double")
    got = {r.host: r["rank"] for r in urls.propagate(links, seeds, urls.rounds_for(1e-3), missing=1e-3).collect()}
    assert abs(got["a"] - 1 / 1.85) + abs(got["b"] - 0.85 / 1.85) <= 1e-3
