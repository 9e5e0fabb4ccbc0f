from collections import defaultdict

import duckdb
from lumenfold.llm import lines, queries


def plain(rows, least):
    sites, first = defaultdict(set), {}
    split = lambda x: [] if x is None else x.split("\n")
    trim = lambda x: x.strip(" \t\r\x0b\x0c")
    order = lambda i: (i is not None, i or 0)
    for r in rows:
        for k, x in enumerate(split(r.text)):
            sites[trim(x)].add(r.source or "")
            first[trim(x)] = min(first.get(trim(x), (order(r.doc_id), k)), (order(r.doc_id), k))
    out = []
    for r in rows:
        bad = [trim(x) != "" and len(sites[trim(x)]) >= least and first[trim(x)] != (order(r.doc_id), k) for k, x in enumerate(split(r.text))]
        out.append((str(r.doc_id), len(bad), sum(bad), None if r.text is None else "\n".join(x for x, b in zip(split(r.text), bad, strict=True) if not b)))
    return sorted(out, key=str)


def found(df, least):
    return sorted(((str(r.doc_id), r.n_lines, r.n_removed, r.text) for r in lines.remove_boilerplate(df, least).collect()), key=str)


def test_equals_plain(docs):
    for least in (2, 5):
        assert found(docs, least) == plain(docs.collect(), least)


def test_odd_rows(odd, empty):
    assert found(odd, 2) == plain(odd.collect(), 2)
    assert found(empty, 2) == []


def test_near_threshold_is_exact(spark):
    rows = [(i, f"line {n}\nown {i}", "en", f"site{s}", 0) for n in (2, 3, 4, 5, 6, 7) for s in range(n) for i in [100 * n + s]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert found(df, 5) == plain(df.collect(), 5)


def test_clashing_names_and_bounded_broadcast(odd, docs, monkeypatch):
    assert lines.remove_boilerplate(odd, 2).columns.count("n_removed") == 1
    assert lines.without_boilerplate(odd, 2).columns == odd.columns
    assert {r.n_removed for r in lines.without_boilerplate(odd, 2).collect()} == {"?"}
    for name in ("BROADCAST_LINES", "BROADCAST_ROWS"):
        monkeypatch.setattr(lines, name, 3)
    assert found(docs, 2) == plain(docs.collect(), 2)


def test_text_of_many_lines(spark):
    rows = [(k, "\n".join(f"line {n}" for n in range(200_000)), "en", f"s{k}", 0) for k in range(5)]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in lines.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), 2).collect()}
    assert got[0] == (200_000, 0, rows[0][1]) and got[1] == got[4] == (200_000, 200_000, "")


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def test_lines_do_not_carry_their_text(docs):
    """The text is no output of the Generate, and is hashed below it."""
    plan = plan_of(lines._lines(docs))
    at = next(k for k, x in enumerate(plan) if "Generate posexplode" in x)
    assert not any("xxhash64(text" in x for x in plan[:at]) and any("xxhash64(text" in x for x in plan[at + 1 :])
    assert "text#" not in plan[at].split("false, [")[1]


def test_exact_counts_are_combined_before_they_are_sent(spark, docs, monkeypatch):
    """Beyond the broadcast, an aggregation by line and site stands below the join with the lines near the threshold."""
    monkeypatch.setattr(lines, "BROADCAST_LINES", 0)
    sent = []
    once = lines.written
    monkeypatch.setattr(lines, "written", lambda df: sent.append(df) or once(df))
    lines.remove_boilerplate(docs, 2)
    plan = plan_of(sent[1])  # the first is the sketches
    join = next(k for k, x in enumerate(plan) if "Join Inner, ((h1" in x and "LeftSemi" not in x)
    deeper = [x for x in plan[join:] if "Aggregate [h1" in x and "site" in x]
    assert deeper and found(docs, 2) == plain(docs.collect(), 2)


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    for name in ("op3_line_dedup", "op4_mixing", "op5_jaccard_join"):
        df = queries.QUERIES[name](spark, sf)
        columns = sorted(df.columns)
        want = db.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
        assert sorted(map(tuple, df.select(columns).collect())) == sorted(want), name
