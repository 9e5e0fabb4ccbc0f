"""Queries over time: as-of and interval joins, sessions; and several groupings of one scan. None has a counterpart in the surveyed behaviour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators.asof import asof_join
from lumenfold.operators.groupings import grouping_sets, rollup
from lumenfold.operators.intervals import interval_join
from lumenfold.operators.sessions import sessions
from lumenfold.sources import table


def micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def ext_asof_before_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last signup or view of the user before each purchase, and how long before."""
    events = table(spark, sf_dir, "events")
    found = asof_join(
        events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"),
        events.where("event_type in ('signup', 'view')").select("event_id", "user_id", "ts", "event_type"),
        on="ts",
        by=["user_id"],
        take={"before_id": "event_id", "before_type": "event_type", "before_ts": "ts"},
        tie=("event_id",),
        strict=True,
    )
    return found.select("event_id", "user_id", F.coalesce("before_id", F.lit(-1)).alias("before_id"), F.coalesce("before_type", F.lit("none")).alias("before_type"), F.coalesce(micros("ts") - micros("before_ts"), F.lit(-1)).alias("micros_before"))


def ext_open_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that are open (ordered, and not shipped whole) at the start of each month with orders."""
    orders = table(spark, sf_dir, "orders")
    shipped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("shipped"))
    opened = orders.select("o_orderkey", "o_orderdate", "o_totalprice").join(shipped, "o_orderkey").select(F.col("o_orderdate").cast("date").alias("opened"), F.col("shipped").cast("date").alias("shipped"), "o_totalprice")
    months = orders.select(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("day")).distinct()
    met = interval_join(opened, months, ("opened", "shipped"), ("day", "day"), left_end_belongs=False)
    return met.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n_open"), F.round(F.sum("o_totalprice"), 2).alias("value_open"))


def ext_errors_around_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and purchases of a user within three hours of each other: the pairs of their three-hour intervals that overlap."""
    events = table(spark, sf_dir, "events")
    of = lambda kind, name: events.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(f"{name}_id"), F.col("ts").alias(f"{name}_from"), (F.col("ts") + F.expr("INTERVAL 3 HOURS")).alias(f"{name}_to"))
    met = interval_join(of("error", "error"), of("purchase", "purchase"), ("error_from", "error_to"), ("purchase_from", "purchase_to"), by=["user_id"])
    return met.select("user_id", "error_id", "purchase_id", (micros("purchase_from") - micros("error_from")).alias("micros_after"))


def ext_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user: events that follow each other within six hours."""
    found = sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", 6 * 3600, {"total": F.col("value")})
    return found.select("user_id", micros("session_start").alias("start_micros"), micros("session_end").alias("end_micros"), "n", F.round("total", 2).alias("total"))


def ext_orders_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by segment, year and priority, their rollup, and by priority and year alone; a column that is left out shows a star."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("segment"), F.year("o_orderdate").cast("long").alias("year"), F.col("o_orderpriority").alias("priority"), "o_totalprice")
    columns = ["segment", "year", "priority"]
    found = grouping_sets(joined, columns, [*rollup(columns), ["priority"], ["year"]], {"value": ("sum", F.col("o_totalprice")), "largest": ("max", F.col("o_totalprice"))})
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("*")).alias(c) for c in columns]  # none is null in these tables
    return found.select(*shown, "grouping_id", "n", F.round("value", 2).alias("value"), "largest")


QUERIES = {f.__name__: f for f in (ext_asof_before_purchase, ext_open_orders, ext_errors_around_purchases, ext_sessions, ext_orders_grouped)}

ORACLE_SQL = {
    "ext_asof_before_purchase": """
        WITH before AS (SELECT user_id, ts, arg_max(event_id, event_id) AS before_id, arg_max(event_type, event_id) AS before_type FROM events WHERE event_type IN ('signup', 'view') GROUP BY user_id, ts)
        SELECT p.event_id, p.user_id, coalesce(before_id, -1) AS before_id, coalesce(before_type, 'none') AS before_type, coalesce(epoch_us(p.ts) - epoch_us(b.ts), -1) AS micros_before
        FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN before b ON p.user_id = b.user_id AND p.ts > b.ts""",
    "ext_open_orders": """
        WITH opened AS (SELECT o_orderdate::DATE AS opened, shipped::DATE AS shipped, o_totalprice FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey),
        months AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS day FROM orders)
        SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS n_open, round(sum(o_totalprice), 2) AS value_open FROM opened JOIN months ON opened <= day AND day < shipped GROUP BY day""",
    "ext_errors_around_purchases": """
        SELECT e.user_id, e.event_id AS error_id, p.event_id AS purchase_id, epoch_us(p.ts) - epoch_us(e.ts) AS micros_after
        FROM events e JOIN events p ON e.user_id = p.user_id AND e.ts <= p.ts + INTERVAL 3 HOUR AND p.ts <= e.ts + INTERVAL 3 HOUR WHERE e.event_type = 'error' AND p.event_type = 'purchase'""",
    "ext_sessions": """
        WITH marked AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000, true)::INTEGER AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        numbered AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM marked)
        SELECT user_id, epoch_us(min(ts)) AS start_micros, epoch_us(max(ts)) + 21600000000 AS end_micros, count(*) AS n, round(sum(value), 2) AS total FROM numbered GROUP BY user_id, session""",
    "ext_orders_grouped": """
        SELECT coalesce(c_mktsegment, '*') AS segment, coalesce(year(o_orderdate)::VARCHAR, '*') AS year, coalesce(o_orderpriority, '*') AS priority, grouping_id(c_mktsegment, year(o_orderdate), o_orderpriority)::BIGINT AS grouping_id, count(*) AS n, round(sum(o_totalprice), 2) AS value, max(o_totalprice) AS largest
        FROM orders JOIN customer ON o_custkey = c_custkey
        GROUP BY GROUPING SETS ((c_mktsegment, year(o_orderdate), o_orderpriority), (c_mktsegment, year(o_orderdate)), (c_mktsegment), (), (o_orderpriority), (year(o_orderdate)))""",
}
