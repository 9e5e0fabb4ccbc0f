"""Queries of partners, first rows and files of several kinds. None has a counterpart in the surveyed behaviour."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators.firsts import first_rows
from lumenfold.operators.matching import having, lacking
from lumenfold.sources import table
from lumenfold.sources.files import KINDS, read_files, write_files
from lumenfold.sources.shared import shared_folder


def ext_events_of_buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, by type, of the users with a purchase of more than 100."""
    events = table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase' and value > 100").select("user_id")
    return having(events.select("user_id", "event_type"), bought, ["user_id"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_users"))


def ext_unlabelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return lacking(documents, table(spark, sf_dir, "labels"), ["doc_id"])


def ext_dearest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dearest orders of each year and priority, and those of equal price with the third."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("year"), "o_orderpriority", "o_totalprice")
    return first_rows(orders, ["year", "o_orderpriority"], ["-o_totalprice"], 3, ties=True)


def ext_orders_by_file_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as files of each kind in folders by priority, read again, and counted by priority and year."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    found = []
    for kind in KINDS:
        path = shared_folder(spark, f"orders-{kind}")
        write_files(orders, path, kind, ["o_orderpriority"])
        rows, apart = read_files(spark, path, kind, orders.schema, ["o_orderpriority"])
        counted = rows.groupBy("o_orderpriority", F.year("o_orderdate").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("customers"), F.round(F.sum("o_totalprice"), 2).alias("value"))
        found.append(counted.select(F.lit(kind).alias("kind"), "*"))
        found.append(apart.groupBy().agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit(kind).alias("kind"), F.lit("malformed").alias("o_orderpriority"), F.lit(None).cast("long").alias("year"), "n", F.lit(0).cast("long").alias("customers"), F.lit(0.0).alias("value")))
    return reduce(DataFrame.unionByName, found)


QUERIES = {f.__name__: f for f in (ext_events_of_buyers, ext_unlabelled_documents, ext_dearest_orders, ext_orders_by_file_kind)}

ORACLE_SQL = {
    "ext_events_of_buyers": """
        SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events e
        WHERE EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.value > 100) GROUP BY event_type""",
    "ext_unlabelled_documents": """
        SELECT doc_id, source, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
    "ext_dearest_orders": """
        SELECT o_orderkey, year(o_orderdate) AS year, o_orderpriority, o_totalprice, rank() OVER (PARTITION BY year(o_orderdate), o_orderpriority ORDER BY o_totalprice DESC) AS rank FROM orders QUALIFY rank <= 3""",
    "ext_orders_by_file_kind": """
        SELECT kind, o_orderpriority, year(o_orderdate) AS year, count(*) AS n, sum(o_custkey)::BIGINT AS customers, round(sum(o_totalprice), 2) AS value
        FROM orders CROSS JOIN (VALUES ('csv'), ('json'), ('orc'), ('parquet')) kinds(kind) GROUP BY ALL""",
}
