"""Registered streaming queries: each runs its stream over the driver's
table files (availableNow) into a fresh sink in the shared checkpoint folder
and returns the sink's final state."""

from __future__ import annotations

from tidemark.plans.catalog import register
from tidemark.plans.oracle import sql
from tidemark.session import scratch_path
from tidemark.sources import bindings as B
from tidemark.streaming import queries as SQ


def _source(spark, sf_dir, table):
    """The table as a stream, be it one file or a folder of files."""
    df = B.read_driver_table(spark, sf_dir, table)
    if any(f.endswith(f"/{table}.parquet") for f in df.inputFiles()):
        return SQ.read_stream(spark, sf_dir, df.schema, glob=f"{table}.parquet",
                              max_files_per_trigger=1)
    return SQ.read_stream(spark, f"{sf_dir}/{table}.parquet", df.schema,
                          max_files_per_trigger=8)


@register("stream_user_events", sql("SELECT * FROM o_fct_events", "o_fct_events"))
def q_stream_user_events(s, d):
    base = scratch_path(s, "stream_user_events")
    events = B.map_events(_source(s, d, "events"))
    SQ.event_fact_stream(events, B.users(s, d), f"{base}/table", f"{base}/_checkpoint")
    return SQ.read_result(s, f"{base}/table", keyed=False).select(
        "event_id", "user_id", "event_type", "event_timestamp", "event_date", "event_hour",
        "event_properties", "region", "signup_source")


@register("stream_funnel_snapshot", sql("""
  SELECT e.user_id,
         min(e.event_timestamp) FILTER (WHERE e.event_type = 'board_created')
           AS created_first_board_at,
         min(e.event_timestamp) FILTER (WHERE e.event_type = 'member_invited')
           AS invited_first_member_at,
         min(e.event_timestamp) FILTER (
           WHERE e.event_timestamp >= u.signed_up_at + INTERVAL 7 DAY
             AND e.event_timestamp < u.signed_up_at + INTERVAL 14 DAY) AS active_in_week_2_at
  FROM b_events e JOIN b_users u ON u.user_id = e.user_id
  GROUP BY e.user_id""", "b_events", "b_users"))
def q_stream_funnel_snapshot(s, d):
    base = scratch_path(s, "stream_funnel_snapshot")
    events = B.map_events(_source(s, d, "events"))
    SQ.funnel_snapshot_stream(events, B.users(s, d), f"{base}/table", f"{base}/_checkpoint")
    return SQ.read_result(s, f"{base}/table").select(*SQ.SNAPSHOT_STREAM_COLUMNS)


@register("stream_funnel_snapshot_join", sql("""
  SELECT u.user_id,
         min(e.event_timestamp) FILTER (WHERE e.event_type = 'board_created')
           AS created_first_board_at,
         min(e.event_timestamp) FILTER (WHERE e.event_type = 'member_invited')
           AS invited_first_member_at,
         min(e.event_timestamp) FILTER (
           WHERE e.event_timestamp >= u.signed_up_at + INTERVAL 7 DAY
             AND e.event_timestamp < u.signed_up_at + INTERVAL 14 DAY) AS active_in_week_2_at
  FROM b_users u LEFT JOIN b_events e ON u.user_id = e.user_id
  GROUP BY u.user_id""", "b_events", "b_users"))
def q_stream_funnel_snapshot_join(s, d):
    base = scratch_path(s, "stream_funnel_snapshot_join")
    users = B.map_users(_source(s, d, "customer"), B.read_driver_table(s, d, "nation"),
                        B.read_driver_table(s, d, "region"))
    SQ.funnel_snapshot_join_stream(B.map_events(_source(s, d, "events")), users,
                                   f"{base}/table", f"{base}/_checkpoint")
    return SQ.read_result(s, f"{base}/table").select(*SQ.SNAPSHOT_STREAM_COLUMNS)


@register("stream_weekly_signups", sql("""
  SELECT signup_week, count(*) AS signups FROM stg_users GROUP BY signup_week""",
                                       "stg_users"))
def q_stream_weekly_signups(s, d):
    base = scratch_path(s, "stream_weekly_signups")
    users = B.map_users(_source(s, d, "customer"), B.read_driver_table(s, d, "nation"),
                        B.read_driver_table(s, d, "region"))
    SQ.weekly_signups_stream(users, f"{base}/table", f"{base}/_checkpoint")
    return SQ.read_result(s, f"{base}/table").select("signup_week", "signups")
