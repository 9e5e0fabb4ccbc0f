"""The registered queries opN_<name>: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import audit, centroids, jaccard, lines, mixing, packing, pii, quality, simhash, tiles, topk, toxicity, urls
from lumenfold.sources import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.remove_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), n=3, similarity=0.9)


def op6_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return topk.search(docs.where(F.col("doc_id") % 20 == 0), docs)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edit_test(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.near_duplicates(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_toxicity, op3_line_dedup, op4_mixing, op5_jaccard_join, op6_bm25_topk, op7_url_filter, op8_pii, op9_simhash, op10_quality, op11_simhash_dedup, op12_filter_audit, op13_centroids)}

#: Same rows as op3: exact distinct counts stand for the sketches, which are exact near the threshold.
OP3_SQL = r"""
WITH split AS (SELECT doc_id, coalesce(source, '') AS site, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, site, unnest(range(len(parts))) AS pos, trim(unnest(parts), chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM split),
spread AS (SELECT line, min((doc_id, pos)) AS first FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 5),
gone AS (SELECT doc_id, list(pos) AS gone FROM lines JOIN spread USING (line) WHERE (doc_id, pos) <> first GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::INTEGER AS n_lines, coalesce(len(gone), 0)::INTEGER AS n_removed,
  CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string([p FOR p, k IN string_split(text, chr(10)) IF NOT list_contains(gone, k - 1)], chr(10)), '') END AS text
FROM documents LEFT JOIN gone USING (doc_id)"""

OP4_SQL = r"""
WITH rows AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    -ln((('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / ((length(regexp_replace(coalesce(text, ''), '[^\p{L}]+', '', 'g')) + 1) / (length(coalesce(text, '')) + 1)) AS key FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
weighed AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS weight FROM totals),
levels AS (SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, max(level) OVER () * weight)::DOUBLE AS target FROM levels),
budgets AS (SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target + 0.5) / source_size) ELSE 0 END::BIGINT AS epochs FROM goals),
ordered AS (SELECT r.doc_id, r.size, b.source_size, b.target, b.epochs, (floor(b.target + 0.5) - b.epochs * b.source_size)::BIGINT AS budget, sum(r.size) OVER (PARTITION BY r.source ORDER BY key, doc_id) AS upto
  FROM rows r JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - (upto - size))))::BIGINT AS taken FROM ordered"""

OP6_SQL = r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS term FROM documents),
counts AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM words GROUP BY ALL),
sizes AS (SELECT d.doc_id, coalesce(n, 0)::DOUBLE AS n FROM documents d LEFT JOIN (SELECT doc_id, sum(tf) AS n FROM counts GROUP BY doc_id) USING (doc_id)),
stats AS (SELECT count(*)::DOUBLE AS docs, avg(n) AS mean FROM sizes),
weights AS (SELECT term, ln(1 + (docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM counts, stats GROUP BY term, docs),
impacts AS (SELECT c.doc_id, term, idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean)) AS impact FROM counts c JOIN sizes USING (doc_id) JOIN weights USING (term), stats),
scores AS (SELECT q.doc_id AS query_id, i.doc_id, round(sum(impact), 6) AS score FROM counts q JOIN impacts i USING (term) WHERE q.doc_id % 20 = 0 AND q.doc_id <> i.doc_id GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores QUALIFY rank <= 10"""

OP5_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS shingle FROM words),
sizes AS (SELECT d.doc_id, coalesce(n, 0) AS n FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id) USING (doc_id)),
overlap AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM overlap o JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * o.n >= 90 * (x.n + y.n - o.n)),
steps AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, s.b FROM reached r JOIN steps s ON s.a = r.other)
SELECT doc_id, n::BIGINT AS n_shingles, component_id FROM sizes JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) USING (doc_id)"""

#: Same rows as op12: each order by the step at which a document is removed, without a lattice.
OP12_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
judged AS (SELECT part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text), regexp_matches(text, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM texts LEFT JOIN known USING (doc_id)),
counted AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM judged GROUP BY ALL),
one AS (SELECT unnest(range(1, 6)) AS f),
orders AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM one a, one b, one c, one d, one e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
gone AS (SELECT *, coalesce(list_position([fails[x] FOR x IN o], true), 6) AS lost FROM counted, orders),
steps AS (SELECT part, o, step, o[step] AS f, (coalesce(sum(n) FILTER (WHERE lost > step), 0))::BIGINT AS kept, (coalesce(sum(n) FILTER (WHERE lost = step), 0))::BIGINT AS removed,
    (coalesce(sum(n) FILTER (WHERE lost < step AND fails[o[step]]), 0))::BIGINT AS redundant, (coalesce(sum(n) FILTER (WHERE fails[o[step]] AND len(list_filter(fails, lambda x: x)) = 1), 0))::BIGINT AS unique_fails,
    (coalesce(sum(good) FILTER (WHERE lost = step), 0))::BIGINT AS good_lost, (coalesce(sum(toxic) FILTER (WHERE lost = step), 0))::BIGINT AS toxic_lost
  FROM gone, (SELECT unnest(range(1, 6)) AS step) GROUP BY part, o, step)
SELECT part, array_to_string([substr('ABCDE', x::INTEGER, 1) FOR x IN o], '') AS filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM steps"""


def _op13_sql(k: int, rounds: int) -> str:
    """The rounds of op13 one after the other, each vector against each centroid."""
    near = "SELECT vec_id, c, sum((v.x - m.x) * (v.x - m.x)) AS d FROM v JOIN m{0} m USING (dim) GROUP BY vec_id, c"
    pick = "a{0} AS (SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (" + near + ") GROUP BY vec_id)"
    move = "m{1} AS (SELECT c, dim, coalesce(s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END, x) AS x FROM m{0} LEFT JOIN (SELECT c, dim, sum(x)::BIGINT AS s, count(*) AS n FROM v JOIN a{0} USING (vec_id) GROUP BY c, dim) USING (c, dim))"
    steps = [pick.format(r) + ",\n" + move.format(r, r + 1) for r in range(rounds)] + [pick.format(rounds)]
    return f"""
WITH v AS (SELECT vec_id, unnest(range(64)) AS dim, floor(256 * unnest(embedding)::DOUBLE)::BIGINT AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
m0 AS (SELECT c, dim, x FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM (SELECT DISTINCT vec_id FROM v) QUALIFY c < {k}) USING (vec_id)),
{(", " + chr(10)).join(steps)},
named AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY dim)) AS centroid_sha256 FROM m{rounds} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a{rounds} JOIN named USING (c)"""


ORACLE_SQL = {"op12_filter_audit": OP12_SQL, "op13_centroids": _op13_sql(centroids.K, centroids.ROUNDS), "op5_jaccard_join": OP5_SQL, "op6_bm25_topk": OP6_SQL, "op3_line_dedup": OP3_SQL, "op4_mixing": OP4_SQL}
