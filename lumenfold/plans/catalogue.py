"""The registered queries of the operators outside `llm`, and the SQL that gives the same rows.

r1_constant_greeting is the whole of the surveyed behaviour. The ext_ queries have no counterpart in it;
they show the relational operators on the supplied tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import revenue
from lumenfold.operators.constant import constant_greeting
from lumenfold.plans import measures, relations, streams, temporal
from lumenfold.sources import table


def r1_constant_greeting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constant_greeting(spark)


def ext_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan of seven columns, the date filter pushed down, one partial and one final aggregation."""
    items = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz"))
    return items.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum(revenue()), 2).alias("sum_disc_price"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count(F.lit(1)).alias("count_order"),
    )


def ext_revenue_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equi-joins whose small sides Spark broadcasts by their measured size."""
    t = lambda name: table(spark, sf_dir, name)
    joined = (
        t("lineitem")
        .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.groupBy("r_name").agg(F.round(F.sum(revenue()), 2).alias("revenue"), F.count(F.lit(1)).alias("items"))


def ext_events_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling day windows by event type."""
    events = table(spark, sf_dir, "events").select(F.date_format(F.window("ts", "1 day")["start"], "yyyy-MM-dd").alias("day"), "event_type", "value")
    return events.groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


QUERIES = {"r1_constant_greeting": r1_constant_greeting, "ext_pricing_summary": ext_pricing_summary, "ext_revenue_by_region": ext_revenue_by_region, "ext_events_by_day": ext_events_by_day, **temporal.QUERIES, **measures.QUERIES, **relations.QUERIES, **streams.QUERIES}

ORACLE_SQL = {
    "r1_constant_greeting": "SELECT 'Hello World!' AS greeting",
    "ext_pricing_summary": """
        SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY l_returnflag, l_linestatus""",
    "ext_revenue_by_region": """
        SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS items
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
    "ext_events_by_day": """
        SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL""",
    **temporal.ORACLE_SQL,
    **measures.ORACLE_SQL,
    **relations.ORACLE_SQL,
    **streams.ORACLE_SQL,
}
