"""The columns of op7, op8 and op9 that SQL can express, against DuckDB."""

import duckdb
from lumenfold.llm import queries

SF = "/root/testdata/sf0.001"

OP7 = r"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(rule_host, rule_path, said) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(said, length(rule_host || rule_path)) AS said
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT page_id, host, path, rule, said FROM parts LEFT JOIN fits USING (page_id)"""

OP8 = r"""
WITH found AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS n_email,
  len([x FOR x IN regexp_extract_all(text, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') IF list_max([p::DOUBLE FOR p IN string_split(x, '.')]) <= 255]) AS n_ip,
  len([x FOR x IN regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]') IF length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 9 AND 15]) AS n_phone FROM found"""

OP9 = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
both_ AS (SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS following FROM texts WINDOW w AS (ORDER BY doc_id DESC))
SELECT doc_id, length(text) AS n_chars, sha256(substr(text, 1, length(text) - length(text) // 3) || substr(following, 1, length(text) // 3)) AS edited_sha256 FROM both_"""


def rows(sql):
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return sorted(db.execute(sql).fetchall())


def test_urls(spark):
    got = queries.op7_url_filter(spark, SF).collect()
    want = rows(OP7)
    assert sorted((r.page_id, r.host, r.path, r.rule) for r in got) == [x[:4] for x in want]
    said = {x[0]: x[4] for x in want if x[4]}
    assert said and all(r.verdict == said[r.page_id] for r in got if r.page_id in said)


def test_pii(spark):
    got = queries.op8_pii(spark, SF).select("doc_id", "n_email", "n_ip", "n_phone").collect()
    assert sorted(map(tuple, got)) == rows(OP8)


def test_simhash(spark):
    got = queries.op9_simhash(spark, SF).select("doc_id", "n_chars", "edited_sha256").collect()
    assert sorted(map(tuple, got)) == rows(OP9)
