"""Cohort retention flags: user x window -> retained 0/1.

A user is retained in a window [lo, hi) when any event falls between lo and
hi days after signup (elapsed time, fractions of a day kept).  The flags come
from the one-pass event rollup (events joined to signup time, reduced per
(user, day) then per user -- partial aggregation absorbs hot users); users
are left-joined and unpivoted to one row per window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeops import add_days, trunc_date
from tidemark.operators.engagement import event_rollup, retained_col
from tidemark.operators.revenue import current_plan
from tidemark.operators.specs import WINDOWS

FLAG_COLUMNS = ("user_id", "cohort_week", "region", "signup_source", "plan_at_latest",
                "retention_day", "is_retained")


def window_flags(users: DataFrame, events: DataFrame, windows=WINDOWS) -> DataFrame:
    """Per user with events: one 0/1 per window (the retention part of the
    one-pass event rollup)."""
    roll = event_rollup(users, events, windows=windows, with_days=False)
    return roll.select("user_id", *[retained_col(day) for day, _, _ in windows])


def retention_flags(users: DataFrame, events: DataFrame, subs: DataFrame,
                    windows=WINDOWS, as_of=None, rollup: DataFrame | None = None) -> DataFrame:
    """Seven columns per (user, window); with ``as_of`` an ``eligible`` flag
    tells whether the window had closed by then (signup + hi <= as_of).
    ``rollup`` may be a built ``event_rollup`` table."""
    flags = (rollup.select("user_id", *[retained_col(day) for day, _, _ in windows])
             if rollup is not None else window_flags(users, events, windows))
    plan = current_plan(subs).select("user_id", "current_plan")
    base = (users.select("user_id", "signed_up_at", "region", "signup_source")
            .join(flags, "user_id", "left").join(plan, "user_id", "left"))
    cells = []
    for day, _, hi in windows:
        fields = [F.lit(day).cast("int").alias("retention_day"),
                  F.coalesce(F.col(retained_col(day)), F.lit(0)).cast("int")
                  .alias("is_retained")]
        if as_of is not None:
            limit = F.lit(str(as_of)).cast("date").cast("timestamp_ntz")
            fields.append((add_days("signed_up_at", hi) <= limit).alias("eligible"))
        cells.append(F.struct(*fields))
    extra = ["cell.eligible"] if as_of is not None else []
    return (base.select("user_id", trunc_date("week", "signed_up_at").alias("cohort_week"),
                        "region", "signup_source",
                        F.coalesce("current_plan", F.lit("free")).alias("plan_at_latest"),
                        F.explode(F.array(*cells)).alias("cell"))
            .select(*FLAG_COLUMNS[:5], "cell.retention_day", "cell.is_retained", *extra))
