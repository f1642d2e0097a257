"""Funnel milestones, the activation score and retention flags, from one pass
over events.

All read the same events joined to each user's signup time.  Instead of one
scan and aggregate per milestone, a single conditional aggregate builds every
per-user figure:

  events(user_id, type, ts) JOIN users(user_id, signed_up_at)   size-checked broadcast
    -> group by (user_id, event_date)   partial aggregate; a hot user is
                                        spread over its days
    -> group by user_id                 <= one row per active day per user

The second level also yields the count of distinct active days without a
distinct aggregate; readers that do not need it use one per-user aggregate.
Users without events are kept by a left join from users.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeops import DAY_US, add_days, elapsed_micros
from tidemark.operators.joins import join_dimension
from tidemark.operators.revenue import subscription_rollup
from tidemark.operators.specs import STAGES, WINDOWS, ActivationSpec, FunnelSpec  # noqa: F401

MILESTONES = ("created_first_board_at", "invited_first_member_at", "active_in_week_2_at")
WEEK1_COUNTS = ("boards_created_week1", "members_invited_week1", "tasks_created_week1",
                "total_events_week1", "active_days_week1")


def retained_col(day: int) -> str:
    return f"retained_d{day}"


def event_rollup(users: DataFrame, events: DataFrame, funnel: FunnelSpec = FunnelSpec(),
                 activation: ActivationSpec = ActivationSpec(),
                 windows=WINDOWS, with_days: bool = True) -> DataFrame:
    """Per user with events: 3 milestone timestamps, 5 week-1 counts and one
    0/1 retention flag per window -- everything per user that events give,
    in one pass.  Readers select what they need; Catalyst drops the rest.

    ``with_days=False`` skips the (user, day) level, which only the count of
    distinct active days needs: one aggregate per user (its partial
    aggregation still reduces a hot user in every task); active_days_week1 is
    then absent."""
    ev = events.select("user_id", "event_type", "event_timestamp")
    su = users.select("user_id", "signed_up_at")
    j = join_dimension(ev, su, "user_id")
    ts, s, t = F.col("event_timestamp"), F.col("signed_up_at"), F.col("event_type")
    # No lower bound: events before signup count as week 1.
    in_w1 = ts < add_days(s, activation.window_days)
    in_w2 = (ts >= add_days(s, funnel.week2_from_days)) & (ts < add_days(s, funnel.week2_to_days))
    d_us = elapsed_micros(s, ts)
    if not with_days:
        return j.groupBy("user_id").agg(
            F.min(F.when(t == funnel.board_event, ts)).alias("created_first_board_at"),
            F.min(F.when(t == funnel.invite_event, ts)).alias("invited_first_member_at"),
            F.min(F.when(in_w2, ts)).alias("active_in_week_2_at"),
            F.count_if(in_w1 & (t == activation.board_event)).alias("boards_created_week1"),
            F.count_if(in_w1 & (t == activation.invite_event)).alias("members_invited_week1"),
            F.count_if(in_w1 & (t == activation.task_event)).alias("tasks_created_week1"),
            F.count_if(in_w1 & t.isNotNull()).alias("total_events_week1"),
            *[F.max(F.when((d_us >= lo * DAY_US) & (d_us < hi * DAY_US), 1).otherwise(0))
              .alias(retained_col(day)) for day, lo, hi in windows])
    return rollup_days(daily_activity(j, funnel, activation, windows), windows)


def daily_activity(joined: DataFrame, funnel: FunnelSpec = FunnelSpec(),
                   activation: ActivationSpec = ActivationSpec(),
                   windows=WINDOWS) -> DataFrame:
    """Partial figures per (user, date) of events that carry ``signed_up_at``.
    Rows of the same key can be merged (:func:`merge_days`)."""
    ts, s, t = F.col("event_timestamp"), F.col("signed_up_at"), F.col("event_type")
    in_w1 = ts < add_days(s, activation.window_days)
    in_w2 = (ts >= add_days(s, funnel.week2_from_days)) & (ts < add_days(s, funnel.week2_to_days))
    d_us = elapsed_micros(s, ts)
    return joined.groupBy("user_id", F.to_date(ts).alias("event_date")).agg(
        *[F.max(F.when((d_us >= lo * DAY_US) & (d_us < hi * DAY_US), 1).otherwise(0))
          .alias(f"f{day}") for day, lo, hi in windows],
        F.min(F.when(t == funnel.board_event, ts)).alias("b_at"),
        F.min(F.when(t == funnel.invite_event, ts)).alias("i_at"),
        F.min(F.when(in_w2, ts)).alias("w2_at"),
        F.count_if(in_w1 & (t == activation.board_event)).alias("b1"),
        F.count_if(in_w1 & (t == activation.invite_event)).alias("i1"),
        F.count_if(in_w1 & (t == activation.task_event)).alias("t1"),
        F.count_if(in_w1 & t.isNotNull()).alias("n1"),
        F.count_if(in_w1).alias("any1"))


def merge_days(days: DataFrame, windows=WINDOWS) -> DataFrame:
    """Partial figures of several batches as one row per (user, date)."""
    return days.groupBy("user_id", "event_date").agg(
        *[F.max(f"f{day}").alias(f"f{day}") for day, _, _ in windows],
        *[F.min(c).alias(c) for c in ("b_at", "i_at", "w2_at")],
        *[F.sum(c).alias(c) for c in ("b1", "i1", "t1", "n1", "any1")])


def rollup_days(daily: DataFrame, windows=WINDOWS) -> DataFrame:
    """Per user, out of :func:`daily_activity`."""
    return daily.groupBy("user_id").agg(
        F.min("b_at").alias("created_first_board_at"),
        F.min("i_at").alias("invited_first_member_at"),
        F.min("w2_at").alias("active_in_week_2_at"),
        F.sum("b1").alias("boards_created_week1"),
        F.sum("i1").alias("members_invited_week1"),
        F.sum("t1").alias("tasks_created_week1"),
        F.sum("n1").alias("total_events_week1"),
        # a NULL date (NULL timestamp) is not an active day
        F.count_if((F.col("any1") > 0) & F.col("event_date").isNotNull())
        .alias("active_days_week1"),
        *[F.max(f"f{day}").alias(retained_col(day)) for day, _, _ in windows])


def _tier(col: Column, tiers) -> Column:
    expr = None
    for threshold, points in tiers:
        expr = (F.when(col >= threshold, points) if expr is None
                else expr.when(col >= threshold, points))
    return expr.otherwise(0)


def stage_expr() -> Column:
    return (F.when(F.col("upgraded_to_paid_at").isNotNull(), 5)
            .when(F.col("active_in_week_2_at").isNotNull(), 4)
            .when(F.col("invited_first_member_at").isNotNull(), 3)
            .when(F.col("created_first_board_at").isNotNull(), 2)
            .otherwise(1).cast("int"))


def lifecycle_label(stage: Column) -> Column:
    expr = None
    for n, label in STAGES[:-1]:
        expr = F.when(stage == n, label) if expr is None else expr.when(stage == n, label)
    return expr.otherwise(STAGES[-1][1])


def score_expr(spec: ActivationSpec = ActivationSpec()) -> Column:
    total = (_tier(F.col("boards_created_week1"), spec.board_tiers)
             + _tier(F.col("members_invited_week1"), spec.invite_tiers)
             + _tier(F.col("tasks_created_week1"), spec.task_tiers)
             + _tier(F.col("active_days_week1"), spec.day_tiers))
    return F.least(F.lit(spec.max_score), total).cast("int")


def user_journey(users: DataFrame, events: DataFrame, subs: DataFrame,
                 funnel: FunnelSpec = FunnelSpec(),
                 activation: ActivationSpec = ActivationSpec(),
                 keep: tuple = (), rollup: DataFrame | None = None) -> DataFrame:
    """Every user: funnel milestones, stage, week-1 counts, score, flag, and
    the current plan (NULL without subscriptions).

    ``keep`` carries further user columns through, so marts need no second
    join back to users.  ``rollup`` may be a built ``event_rollup`` table."""
    roll = rollup if rollup is not None else event_rollup(users, events, funnel, activation)
    base = users.select("user_id", "signed_up_at", *keep)
    j = (base.join(roll, "user_id", "left")
         .join(subscription_rollup(subs, funnel.paid_plans), "user_id", "left"))
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in WEEK1_COUNTS]
    out = j.select("user_id", "signed_up_at", *keep, *MILESTONES, "upgraded_to_paid_at",
                   *counts, "current_plan", "current_mrr")
    return out.select(
        "*", stage_expr().alias("max_funnel_stage"),
        score_expr(activation).alias("activation_score"),
        (F.col("members_invited_week1") >= activation.activated_min_invites)
        .alias("is_activated"))


def funnel_stages(users: DataFrame, events: DataFrame, subs: DataFrame,
                  spec: FunnelSpec = FunnelSpec()) -> DataFrame:
    """One row per user: signup, 4 milestone timestamps, highest stage reached
    (each milestone is tested on its own; no ordering between them)."""
    roll = event_rollup(users, events, spec, with_days=False)
    j = (users.select("user_id", "signed_up_at").join(roll, "user_id", "left")
         .join(subscription_rollup(subs, spec.paid_plans), "user_id", "left"))
    return j.select("user_id", "signed_up_at", *MILESTONES, "upgraded_to_paid_at",
                    stage_expr().alias("max_funnel_stage"))


def activation_score(users: DataFrame, events: DataFrame,
                     spec: ActivationSpec = ActivationSpec()) -> DataFrame:
    """One row per user: week-1 counts, weighted score (capped), flag."""
    roll = event_rollup(users, events, FunnelSpec(), spec)
    j = users.select("user_id").join(roll, "user_id", "left")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in WEEK1_COUNTS]
    out = j.select("user_id", *counts)
    return out.select("*", score_expr(spec).alias("activation_score"),
                      (F.col("members_invited_week1") >= spec.activated_min_invites)
                      .alias("is_activated"))
