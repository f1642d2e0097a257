"""Staging projections: rename, cast and derive, one function per raw table.

Pure projections, so Catalyst folds them into the scan (pruned ReadSchema,
pushed filters) and into whatever reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeops import elapsed, trunc_date, trunc_ts

# List price per plan.
PLAN_PRICES = (("free", "0.00"), ("pro", "29.00"), ("enterprise", "99.00"))


def stg_users(users: DataFrame) -> DataFrame:
    return users.select("user_id", "email", "full_name", "region", "signup_source",
                        "signed_up_at", "initial_plan",
                        trunc_date("week", "signed_up_at").alias("signup_week"),
                        trunc_date("month", "signed_up_at").alias("signup_month"))


def stg_user_events(events: DataFrame) -> DataFrame:
    return events.select("event_id", "user_id", "event_type", "event_timestamp",
                         "event_properties",
                         F.to_date("event_timestamp").alias("event_date"),
                         trunc_ts("hour", "event_timestamp").alias("event_hour"))


def stg_feature_usage(usage: DataFrame) -> DataFrame:
    return usage.select("usage_id", "user_id", "feature_name", "used_at",
                        "duration_seconds", F.to_date("used_at").alias("usage_date"))


def plan_mrr(plan_col="plan"):
    """List price of a plan; NULL for an unknown plan."""
    p = F.col(plan_col) if isinstance(plan_col, str) else plan_col
    expr = None
    for name, price in PLAN_PRICES:
        value = F.lit(price).cast("decimal(10,2)")
        expr = F.when(p == name, value) if expr is None else expr.when(p == name, value)
    return expr


def stg_subscriptions(subs: DataFrame) -> DataFrame:
    return subs.select("subscription_id", "user_id", "plan", "mrr", "started_at",
                       "ended_at", "change_type",
                       plan_mrr("plan").alias("plan_mrr"),
                       F.col("ended_at").isNull().alias("is_active"))


def stg_invoices(invoices: DataFrame) -> DataFrame:
    return invoices.select("invoice_id", "subscription_id", "user_id", "amount",
                           "currency", "status", "issued_at",
                           F.to_date("issued_at").alias("invoice_date"),
                           trunc_date("month", "issued_at").alias("invoice_month"))


def stg_conversations(tickets: DataFrame) -> DataFrame:
    return tickets.select("conversation_id", "user_id", "topic", "status", "created_at",
                          "resolved_at", "messages_count", "first_response_minutes",
                          elapsed("created_at", "resolved_at", "hour")
                          .alias("resolution_hours"))
