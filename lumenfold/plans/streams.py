"""Queries that run the events as a stream to its end, and give what it has appended. None has a counterpart in the surveyed behaviour.

What the watermark has not passed at the end (an hour behind the last row) is not given; the SQL says so too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.plans.temporal import micros
from lumenfold.sources import table
from lumenfold.streaming.pairs import followed_by
from lumenfold.streaming.pending import TICKS, stream_first_answers
from lumenfold.streaming.replay import run_to_end, streamed
from lumenfold.streaming.windows import events_by_window, sessions_of

DAY, SIX_HOURS = 86_400, 21_600


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamed(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events"))


def ext_stream_events_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and type, once the day is over."""
    found = run_to_end(events_by_window(_events(spark, sf_dir)))
    return found.select(micros("window.start").alias("start_micros"), "event_type", "n")


def ext_stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user, once their gap of six hours is over."""
    found = run_to_end(sessions_of(_events(spark, sf_dir), ["user_id"], "ts", SIX_HOURS, {"total": F.col("value")}))
    return found.select("user_id", micros("session_start").alias("start_micros"), micros("session_end").alias("end_micros"), "n", F.round("total", 2).alias("total"))


def ext_stream_first_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's first purchase within a day of each view, or -1, once the day is over."""
    is_view, is_purchase = (F.col("event_type") == x for x in ("view", "purchase"))
    return run_to_end(stream_first_answers(_events(spark, sf_dir), "user_id", "ts", "event_id", is_view, is_purchase, DAY)).withColumnRenamed("key", "user_id")


def ext_stream_clicks_to_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases that follow a click of the user within six hours."""
    events = _events(spark, sf_dir)
    of = lambda kind: events.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(f"{kind}_id"), F.col("ts").alias(f"{kind}_at"))
    found = run_to_end(followed_by(of("click"), of("purchase"), ["user_id"], ("click_at", "purchase_at"), "6 HOURS"))
    return found.select("user_id", "click_id", "purchase_id", (micros("purchase_at") - micros("click_at")).alias("micros_after"))


QUERIES = {f.__name__: f for f in (ext_stream_events_by_window, ext_stream_sessions, ext_stream_first_purchases, ext_stream_clicks_to_purchases)}

_PASSED = "(SELECT epoch_us(max(ts)) // 1000 * 1000 - 3600000000 FROM events{0})"
_TICK = -(-DAY * 1_000_000 // TICKS)

ORACLE_SQL = {
    "ext_stream_events_by_window": f"""
        SELECT * FROM (SELECT epoch_us(date_trunc('day', ts)) AS start_micros, event_type, count(*) AS n FROM events GROUP BY ALL) WHERE start_micros + 86400000000 <= {_PASSED.format("")}""",
    "ext_stream_sessions": f"""
        WITH marked AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000, true)::INTEGER AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        numbered AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM marked)
        SELECT user_id, epoch_us(min(ts)) AS start_micros, epoch_us(max(ts)) + 21600000000 AS end_micros, count(*) AS n, round(sum(value), 2) AS total FROM numbered GROUP BY user_id, session HAVING end_micros <= {_PASSED.format("")}""",
    "ext_stream_first_purchases": f"""
        WITH views AS (SELECT user_id, event_id AS call_id, ts, epoch_us(ts) AS called_micros FROM events WHERE event_type = 'view' AND (epoch_us(ts) // {_TICK} + 1) * {_TICK} + {DAY}000000 <= {_PASSED.format(" WHERE event_type IN ('view', 'purchase')")}),
        answers AS (SELECT call_id, min((epoch_us(p.ts), p.event_id)) AS first FROM views v JOIN events p ON v.user_id = p.user_id AND p.event_type = 'purchase' AND p.ts > v.ts AND p.ts <= v.ts + INTERVAL {DAY} SECOND GROUP BY call_id)
        SELECT user_id, call_id, called_micros, coalesce(first[2], -1) AS answer_id, coalesce(first[1] - called_micros, -1) AS micros_to_answer FROM views LEFT JOIN answers USING (call_id)""",
    "ext_stream_clicks_to_purchases": """
        SELECT c.user_id, c.event_id AS click_id, p.event_id AS purchase_id, epoch_us(p.ts) - epoch_us(c.ts) AS micros_after
        FROM events c JOIN events p ON c.user_id = p.user_id AND p.ts > c.ts AND p.ts <= c.ts + INTERVAL 6 HOUR WHERE c.event_type = 'click' AND p.event_type = 'purchase'""",
}
