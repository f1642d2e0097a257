"""Data jobs over the raw inputs: churn cleanup, activation lift, invoice
schedule, activity span."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rates import pct1, ratio1
from tidemark.functions.timeops import DAY_US, elapsed_micros
from tidemark.operators.joins import join_dimension

EVENT_COLUMNS = ("event_id", "user_id", "event_type", "event_timestamp", "event_properties")


def events_before_churn(events: DataFrame, subs: DataFrame) -> DataFrame:
    """Drop each user's events after their first churn row started (events
    at exactly that time stay; users who never churned keep everything)."""
    churn = (subs.filter(F.col("change_type") == "churn").groupBy("user_id")
             .agg(F.min("started_at").alias("churn_date")))
    # one row per churned user: broadcast when its size is proven small
    j = join_dimension(events, churn, "user_id", "left")
    keep = F.col("churn_date").isNull() | (F.col("event_timestamp") <= F.col("churn_date"))
    return j.filter(keep).select(*EVENT_COLUMNS)


def activation_lift(users: DataFrame, events: DataFrame, subs: DataFrame,
                    invite_event: str = "member_invited", window_days: int = 7,
                    min_invites: int = 2, paid_plans=("pro", "enterprise")) -> DataFrame:
    """Activated users (>= ``min_invites`` invites at most ``window_days``
    after signup, inclusive) against the rest: users, paid users, conversion
    % and the lift (activated rate / rest rate, NULL if the rest never pay)."""
    inv = events.filter(F.col("event_type") == invite_event).select("user_id",
                                                                    "event_timestamp")
    su = users.select("user_id", "signed_up_at")
    j = join_dimension(inv, su, "user_id")
    early = j.filter(elapsed_micros("signed_up_at", "event_timestamp")
                     <= F.lit(window_days * DAY_US))
    activated = (early.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
                 .filter(F.col("n") >= min_invites).select("user_id",
                                                           F.lit(True).alias("act")))
    paid = (subs.filter(F.col("plan").isin(*paid_plans)).select("user_id").distinct()
            .select("user_id", F.lit(True).alias("paid")))
    per_user = (users.select("user_id").join(activated, "user_id", "left")
                .join(paid, "user_id", "left")
                .select(F.coalesce("act", F.lit(False)).alias("a"),
                        F.coalesce("paid", F.lit(False)).alias("p")))
    # one global aggregate, then two output rows from its single row
    tot = per_user.agg(F.count_if("a").alias("ta"), F.count_if(F.col("a") & F.col("p")).alias("pa"),
                       F.count_if(~F.col("a")).alias("tn"),
                       F.count_if(~F.col("a") & F.col("p")).alias("pn"))
    lift = ratio1("pa", "ta", "pn", "tn")
    rows = F.array(
        F.struct(F.lit(True).alias("is_activated"), F.col("ta").alias("users"),
                 F.col("pa").alias("paid")),
        F.struct(F.lit(False).alias("is_activated"), F.col("tn").alias("users"),
                 F.col("pn").alias("paid")))
    return (tot.select(F.explode(rows).alias("r"), lift.alias("lift"))
            .select("r.is_activated", "r.users", "r.paid",
                    pct1("r.paid", "r.users").alias("conversion_pct"), "lift"))


def invoice_schedule(subs: DataFrame, as_of) -> DataFrame:
    """One invoice per month of each paid subscription: the first of each month
    from the start's month (time of day kept) through its end (open: as_of),
    never before the start itself."""
    end = F.coalesce(F.col("ended_at"), F.lit(str(as_of)).cast("timestamp_ntz"))
    start = F.col("started_at")
    # first of the start's month, same time of day
    anchor = start - F.make_dt_interval(days=F.dayofmonth(start) - 1)
    paid = subs.filter(F.col("mrr") > 0).select(
        "subscription_id", "user_id", F.col("mrr").alias("amount"), start.alias("s"),
        anchor.alias("anchor"), end.alias("e")).filter(F.col("anchor") <= F.col("e"))
    months = paid.select("subscription_id", "user_id", "amount", "s",
                         F.explode(F.sequence("anchor", "e", F.expr("INTERVAL 1 MONTH")))
                         .alias("m"))
    return months.select("subscription_id", "user_id", "amount",
                         F.greatest("m", "s").alias("issued_at"))


def user_active_span(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.min("event_timestamp").alias("first_event_at"),
                                         F.max("event_timestamp").alias("last_event_at"))
