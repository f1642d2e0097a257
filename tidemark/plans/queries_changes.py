"""Registered queries: loads of the event table in which something changes.

The first load takes the events before a split but for some that are held
back; the second run offers the rest together with late rows, new ids at the
very instant of the high-water mark, ids sent again with another date and
value, and ids that occur twice in the batch.  All of it is derived from the
given events, in Spark and in the SQL alike.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.timeops import add_days, add_seconds
from tidemark.operators import incremental as I
from tidemark.operators.event_table import EventTable
from tidemark.operators.user_state import UserStateTable
from tidemark.plans import reports as R
from tidemark.plans.catalog import register
from tidemark.plans.oracle import cte, rate, sql
from tidemark.session import scratch_path
from tidemark.sources import bindings as B

# Fixed values of the registered runs.
SPLIT = "2024-01-16 00:00:00"
LOOKBACK_DAYS = 3
TIE_OFFSET = 1_000_000_000_000         # ids of the rows at the high-water mark
EMPTIED_DAY = "2024-01-05"


def _parts(events):
    """(first load, what the second run offers)."""
    ts, i = F.col("event_timestamp"), F.col("event_id")
    early = ts < F.lit(SPLIT).cast("timestamp_ntz")
    held = i % 10 == 3
    first = events.where(early & ~held)
    new = events.where(~early)
    # one row: the greatest time of the first load
    mark = first.agg(F.max("event_timestamp").alias("mark"))
    ties = first.join(F.broadcast(mark), ts == F.col("mark")).select(
        (i + TIE_OFFSET).alias("event_id"), "user_id", "event_type", "event_timestamp",
        "event_properties")
    again = first.where(i % 7 == 1).select(
        "event_id", "user_id", F.lit("task_completed").alias("event_type"),
        add_days(ts, F.lit(20)).alias("event_timestamp"),
        F.lit("again").alias("event_properties"))
    twice = new.where(i % 11 == 2).select(
        "event_id", "user_id", "event_type", add_seconds(ts, F.lit(60)).alias("event_timestamp"),
        F.lit("twice").alias("event_properties"))
    offered = (new.unionByName(events.where(early & held)).unionByName(ties)
               .unionByName(again).unionByName(twice))
    return first, offered


cte("o_chg_first", ("b_events",), f"""
  SELECT * FROM b_events
  WHERE event_timestamp < TIMESTAMP '{SPLIT}' AND event_id % 10 <> 3""")
cte("o_chg_mark", ("o_chg_first",), "SELECT max(event_timestamp) AS mark FROM o_chg_first")
cte("o_chg_offered", ("b_events", "o_chg_first", "o_chg_mark"), f"""
  SELECT * FROM b_events WHERE event_timestamp >= TIMESTAMP '{SPLIT}' OR event_id % 10 = 3
  UNION ALL
  SELECT f.* REPLACE (f.event_id + {TIE_OFFSET} AS event_id)
  FROM o_chg_first f JOIN o_chg_mark m ON f.event_timestamp = m.mark
  UNION ALL
  SELECT * REPLACE ('task_completed' AS event_type, 'again' AS event_properties,
                    event_timestamp + INTERVAL 20 DAY AS event_timestamp)
  FROM o_chg_first WHERE event_id % 7 = 1
  UNION ALL
  SELECT * REPLACE ('twice' AS event_properties,
                    event_timestamp + INTERVAL 1 MINUTE AS event_timestamp)
  FROM b_events WHERE event_timestamp >= TIMESTAMP '{SPLIT}' AND event_id % 11 = 2""")


def _changed(taken: str) -> str:
    """SQL of the table after the second run took the rows of ``taken``."""
    return f"""
  SELECT e.event_id, e.user_id, e.event_type, e.event_timestamp,
         CAST(e.event_timestamp AS DATE) AS event_date,
         date_trunc('hour', e.event_timestamp) AS event_hour, e.event_properties,
         u.region, u.signup_source
  FROM (SELECT * FROM o_chg_first WHERE event_id NOT IN (SELECT event_id FROM ({taken}) t)
        UNION ALL {taken}) e
  LEFT JOIN b_users u ON u.user_id = e.user_id"""


_LAST = """SELECT * EXCLUDE (n) FROM (
    SELECT o.*, row_number() OVER (PARTITION BY event_id ORDER BY event_timestamp DESC) AS n
    FROM o_chg_offered o {where}) q WHERE n = 1"""
_DEPENDS = ("b_users", "o_chg_first", "o_chg_mark", "o_chg_offered")
TAKEN = {
    "strict": "SELECT * FROM o_chg_offered WHERE event_timestamp > (SELECT mark FROM o_chg_mark)",
    "lookback": _LAST.format(where=f"""WHERE event_timestamp >
      (SELECT mark - INTERVAL {LOOKBACK_DAYS} DAY FROM o_chg_mark)"""),
    "keyed": _LAST.format(where=""),
}


def _run(s, d, mode):
    users, (first, offered) = B.users(s, d), _parts(B.user_events(s, d))
    path = scratch_path(s, f"event_table_{mode}")
    I.load_events(s, path, users, first, mode, LOOKBACK_DAYS)
    return I.load_events(s, path, users, offered, mode, LOOKBACK_DAYS)


@register("event_table_strict", sql(_changed(TAKEN["strict"]), *_DEPENDS))
def q_event_table_strict(s, d):
    return _run(s, d, "strict")


@register("event_table_lookback", sql(_changed(TAKEN["lookback"]), *_DEPENDS))
def q_event_table_lookback(s, d):
    return _run(s, d, "lookback")


@register("event_table_keyed", sql(_changed(TAKEN["keyed"]), *_DEPENDS))
def q_event_table_keyed(s, d):
    return _run(s, d, "keyed")


@register("event_table_deltas", sql(_changed(TAKEN["keyed"]), *_DEPENDS))
def q_event_table_deltas(s, d):
    """The same by appended micro-batches, the last one sent twice and not yet
    folded in when the table is read."""
    users, (first, offered) = B.users(s, d), _parts(B.user_events(s, d))
    table = EventTable(s, scratch_path(s, "event_table_deltas"))
    table.append(users, first, "first", 0)
    table.compact()
    for _ in range(2):
        table.append(users, offered, "offered", 0)
    return table.read()


@register("event_table_emptied_day", sql(f"""
  SELECT event_id, user_id, event_type, t AS event_timestamp, CAST(t AS DATE) AS event_date,
         date_trunc('hour', t) AS event_hour, event_properties, region, signup_source
  FROM (SELECT *, event_timestamp + CASE WHEN event_date = DATE '{EMPTIED_DAY}'
                  THEN INTERVAL 10 DAY ELSE INTERVAL 0 DAY END AS t FROM o_fct_events) e""",
                                         "o_fct_events"))
def q_event_table_emptied_day(s, d):
    """A load whose re-sent ids take every row of a day away."""
    users, events = B.users(s, d), B.user_events(s, d)
    moved = events.where(F.to_date("event_timestamp") == F.lit(EMPTIED_DAY).cast("date")) \
        .withColumn("event_timestamp", add_days(F.col("event_timestamp"), F.lit(10)))
    path = scratch_path(s, "event_table_emptied")
    I.load_events(s, path, users, events, "keyed")
    return I.load_events(s, path, users, moved, "keyed")


@register("event_table_dau_wau_mau", sql(f"""
  SELECT *, coalesce({rate('wau', 'mau')}, CAST(0 AS DOUBLE)) AS wau_mau_ratio
  FROM (SELECT count(DISTINCT user_id) FILTER (WHERE event_date = DATE '2024-01-19') AS dau,
               count(DISTINCT user_id) FILTER (WHERE event_date >= DATE '2024-01-13') AS wau,
               count(DISTINCT user_id) AS mau
        FROM o_fct_events WHERE event_date >= DATE '2023-12-21') t""", "o_fct_events"))
def q_event_table_dau_wau_mau(s, d):
    """DAU/WAU/MAU of another day, from the folders of the table that its
    thirty days meet."""
    table = EventTable(s, scratch_path(s, "event_table_active"))
    table.load(B.users(s, d), B.user_events(s, d), "keyed")
    return R.kpi_dau_wau_mau(table.read(R.active_span("2024-01-20")), "2024-01-20")


@register("funnel_snapshot_maintained", sql("SELECT * FROM o_snapshot", "o_snapshot"))
def q_funnel_snapshot_maintained(s, d):
    """The snapshot out of four batches, in which a third of the users arrive
    after their first events and one batch is sent twice."""
    users, events = B.users(s, d), B.user_events(s, d)
    state = UserStateTable(s, scratch_path(s, "user_state"))
    late = F.col("user_id") % 3 == 0
    early = F.col("event_timestamp") < F.lit(SPLIT).cast("timestamp_ntz")
    state.update(users.where(~late), events.where(early), "daily", 0)
    for _ in range(2):
        state.update(users.where(late & (F.col("user_id") % 2 == 0)),
                     events.where(~early & (F.col("event_id") % 2 == 0)), "daily", 1)
    state.update(users.where(late), events.limit(0), "daily", 2)
    state.update(users.limit(0), events.where(~early & (F.col("event_id") % 2 == 1)), "daily", 3)
    return state.snapshot(users, B.subscriptions(s, d))
