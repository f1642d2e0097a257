"""Conformed dimensions and facts built from the staged inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timeops import calendar, date_series, elapsed, trunc_date
from tidemark.operators.engagement import (
    MILESTONES, ActivationSpec, FunnelSpec, lifecycle_label, user_journey,
)
from tidemark.operators.joins import join_dimension
from tidemark.operators.staging import stg_subscriptions, stg_user_events, stg_users

# The reference's calendar range.
DEFAULT_DATE_START = "2024-09-01"
DEFAULT_DATE_END = "2026-03-31"

DIM_USERS_COLUMNS = (
    "user_id", "email", "full_name", "region", "signup_source", "signed_up_at",
    "signup_week", "signup_month", "initial_plan", "current_plan", "current_mrr",
    "created_first_board_at", "invited_first_member_at", "active_in_week_2_at",
    "upgraded_to_paid_at", "max_funnel_stage", "activation_score", "is_activated",
    "members_invited_week1", "tasks_created_week1", "active_days_week1", "lifecycle_stage")

SNAPSHOT_COLUMNS = (
    "user_id", "region", "signup_source", "cohort_week", "cohort_month", "signed_up_at",
    "created_first_board_at", "invited_first_member_at", "active_in_week_2_at",
    "upgraded_to_paid_at", "hours_to_first_board", "hours_board_to_invite",
    "hours_to_conversion", "completed_board", "completed_invite", "completed_week2",
    "completed_conversion", "max_funnel_stage", "activation_score", "is_activated")

_USER_ATTRS = ("email", "full_name", "region", "signup_source", "signup_week",
               "signup_month", "initial_plan")


def dim_users(users: DataFrame, events: DataFrame, subs: DataFrame,
              funnel: FunnelSpec = FunnelSpec(),
              activation: ActivationSpec = ActivationSpec(),
              rollup: DataFrame | None = None) -> DataFrame:
    """User dimension: attributes, current plan, milestones, activation.
    ``rollup`` may be a built ``event_rollup`` table (then events is unused)."""
    j = user_journey(stg_users(users), events, subs, funnel, activation,
                     keep=_USER_ATTRS, rollup=rollup)
    return j.select(
        *DIM_USERS_COLUMNS[:9],
        F.coalesce("current_plan", F.lit("free")).alias("current_plan"),
        F.coalesce("current_mrr", F.lit(0).cast("decimal(10,2)")).alias("current_mrr"),
        *DIM_USERS_COLUMNS[11:21],
        lifecycle_label(F.col("max_funnel_stage")).alias("lifecycle_stage"))


def funnel_snapshot(users: DataFrame, events: DataFrame, subs: DataFrame,
                    funnel: FunnelSpec = FunnelSpec(),
                    activation: ActivationSpec = ActivationSpec(),
                    rollup: DataFrame | None = None) -> DataFrame:
    """Accumulating snapshot: one row per user, one timestamp per milestone,
    lags in hours (board -> invite may be negative), completion flags."""
    journey = user_journey(stg_users(users), events, subs, funnel, activation,
                           keep=("region", "signup_source", "signup_week", "signup_month"),
                           rollup=rollup)
    return snapshot_from(journey)


def snapshot_from(journey: DataFrame) -> DataFrame:
    """The snapshot's columns from a frame holding the user's attributes and
    journey (``user_journey`` output or ``dim_users``), so a run that builds
    dim_users gets the snapshot without a second pass over events."""
    return journey.select(
        "user_id", "region", "signup_source",
        F.col("signup_week").alias("cohort_week"), F.col("signup_month").alias("cohort_month"),
        "signed_up_at", *MILESTONES, "upgraded_to_paid_at",
        elapsed("signed_up_at", "created_first_board_at", "hour").alias("hours_to_first_board"),
        elapsed("created_first_board_at", "invited_first_member_at", "hour")
        .alias("hours_board_to_invite"),
        elapsed("signed_up_at", "upgraded_to_paid_at", "hour").alias("hours_to_conversion"),
        F.col("created_first_board_at").isNotNull().alias("completed_board"),
        F.col("invited_first_member_at").isNotNull().alias("completed_invite"),
        F.col("active_in_week_2_at").isNotNull().alias("completed_week2"),
        F.col("upgraded_to_paid_at").isNotNull().alias("completed_conversion"),
        "max_funnel_stage", "activation_score", "is_activated")


def fct_subscriptions(users: DataFrame, subs: DataFrame) -> DataFrame:
    s = stg_subscriptions(subs)
    u = users.select("user_id", "region", "signup_source")
    j = join_dimension(s, u, "user_id", "left")
    return j.select(
        "subscription_id", "user_id", "plan", "mrr", "plan_mrr", "started_at", "ended_at",
        "change_type", "is_active", "region", "signup_source",
        elapsed("started_at", "ended_at", "day").alias("duration_days"),
        trunc_date("month", "started_at").alias("started_month"),
        trunc_date("month", "ended_at").alias("ended_month"))


FCT_EVENT_COLUMNS = ("event_id", "user_id", "event_type", "event_timestamp", "event_date",
                     "event_hour", "event_properties", "region", "signup_source")


def fct_user_events(users: DataFrame, events: DataFrame) -> DataFrame:
    """Event fact with the user's region and signup source (full refresh;
    ``incremental`` has the keyed upsert)."""
    e = stg_user_events(events)
    u = users.select("user_id", "region", "signup_source")
    return join_dimension(e, u, "user_id", "left").select(*FCT_EVENT_COLUMNS)


def dim_date(spark: SparkSession, start=DEFAULT_DATE_START, end=DEFAULT_DATE_END,
             bounds: DataFrame | None = None, pad_names: bool = True) -> DataFrame:
    """Date dimension, one row per day in [start, end] (both inclusive)."""
    return calendar(date_series(spark, start, end, "date_day", bounds), "date_day", pad_names)
