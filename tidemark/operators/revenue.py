"""Subscription revenue: current plan per user and the monthly MRR waterfall.

Everything per user is an aggregate (partial + final), never a window over a
user's rows, so a user with millions of subscription rows is reduced
map-side.  The predecessor of a row ("the row that ended when this one started")
is found by grouping starts and ends on (user_id, instant), in one exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timeops import month_series, trunc_date

# The reference's month spine.
DEFAULT_FIRST_MONTH = "2024-09-01"
DEFAULT_LAST_MONTH = "2026-02-01"

WATERFALL_COLUMNS = ("report_month", "new_mrr", "expansion_mrr", "contraction_mrr",
                     "churn_mrr", "net_new_mrr", "ending_mrr")


def _latest_key():
    # Latest row first; a NULL started_at counts as latest (it sorts first
    # in a descending SQL order); ties go to the greatest subscription_id.
    return F.struct(F.col("started_at").isNull().alias("open_start"),
                    F.col("started_at").alias("started_at"),
                    F.col("subscription_id").alias("subscription_id"))


def subscription_rollup(subs: DataFrame, paid_plans=("pro", "enterprise")) -> DataFrame:
    """Per user, one aggregate over subscriptions: first start on a paid plan,
    and plan and MRR of the latest row.  Readers select what they need."""
    paid = F.when(F.col("plan").isin(*paid_plans), F.col("started_at"))
    roll = subs.groupBy("user_id").agg(
        F.min(paid).alias("upgraded_to_paid_at"),
        F.max_by(F.struct("plan", "mrr"), _latest_key()).alias("cp"))
    return roll.select("user_id", "upgraded_to_paid_at",
                       F.col("cp.plan").alias("current_plan"),
                       F.col("cp.mrr").alias("current_mrr"))


def current_plan(subs: DataFrame) -> DataFrame:
    """Plan and MRR of each user's latest subscription row."""
    return subscription_rollup(subs).select("user_id", "current_plan", "current_mrr")


def _instants(subs: DataFrame) -> DataFrame:
    """Every row as its start and its end, keyed (user_id, at): ``mrr`` with
    ``churned`` / ``starts`` (0 or 1) of a start, ``last_end`` (the order among
    rows ending at once) of an end.  One scan; keys that are NULL meet nothing."""
    end_order = F.struct(F.col("started_at"), F.col("subscription_id"))
    start = F.struct(F.col("started_at").alias("at"), F.lit(1).alias("starts"),
                     F.coalesce(F.col("change_type") == "churn", F.lit(False))
                     .cast("int").alias("churned"),
                     F.lit(None).cast(_end_type(subs)).alias("last_end"))
    end = F.struct(F.col("ended_at").alias("at"), F.lit(0).alias("starts"),
                   F.lit(0).alias("churned"), end_order.alias("last_end"))
    return (subs.select("user_id", "mrr", F.inline(F.array(start, end)))
            .filter(F.col("at").isNotNull()))


def _end_type(subs: DataFrame) -> str:
    types = dict(subs.dtypes)
    return f"struct<started_at:{types['started_at']},subscription_id:{types['subscription_id']}>"


def month_span(subs: DataFrame) -> DataFrame:
    """``lo, hi`` (one row): the first and last day on which a subscription
    starts or ends; null without any."""
    return subs.agg(
        F.to_date(F.least(F.min("started_at"), F.min("ended_at"))).alias("lo"),
        F.to_date(F.greatest(F.max("started_at"), F.max("ended_at"))).alias("hi"))


def _spine(subs: DataFrame, first_month, last_month) -> DataFrame:
    """Months from first to last; a bound that is None is that of the data."""
    spark = subs.sparkSession
    if first_month is not None and last_month is not None:
        return month_series(spark, first_month, last_month, "report_month")
    return month_series(spark, first_month if first_month is not None else F.col("lo"),
                        last_month if last_month is not None else F.col("hi"),
                        "report_month", month_span(subs))


def _spine_join(spine: DataFrame, monthly: DataFrame) -> DataFrame:
    measures = ("new_mrr", "expansion_mrr", "contraction_mrr", "churn_mrr")
    # both sides hold one row per month; the monthly aggregate is broadcast
    # (its size is bounded by the months the data spans)
    j = spine.join(F.broadcast(monthly), "report_month", "left")
    zero = F.lit(0).cast("decimal(10,2)")
    filled = j.select("report_month", *[F.coalesce(F.col(m), zero).alias(m) for m in measures])
    net = (F.col("new_mrr") + F.col("expansion_mrr") - F.col("contraction_mrr")
           - F.col("churn_mrr"))
    # The spine is one row per month: a single ordered partition is fine.
    running = Window.orderBy("report_month").rowsBetween(Window.unboundedPreceding,
                                                          Window.currentRow)
    return (filled.withColumn("net_new_mrr", net)
            .withColumn("ending_mrr", F.sum("net_new_mrr").over(running))
            .select(*WATERFALL_COLUMNS))


def mrr_waterfall(subs: DataFrame, first_month=DEFAULT_FIRST_MONTH,
                  last_month=DEFAULT_LAST_MONTH) -> DataFrame:
    """Monthly waterfall by the reference rule: new = MRR of a user's first
    row on a paid plan; expansion = the *full* MRR of an expansion row;
    contraction = 0; churn = MRR of the row that ended when the churn row
    started (0 if none); ending = running sum of net from zero.  Changes
    outside the spine drop out; a spine bound of None is that of the data, so
    that nothing does."""
    ct, plan = F.col("change_type"), F.col("plan")
    none, month = F.lit(None).cast("decimal(10,2)"), trunc_date("month", "started_at")
    gains = subs.select(
        month.alias("report_month"),
        F.when((ct == "new") & (plan != "free"), F.col("mrr")).alias("new_mrr"),
        F.when(ct == "expansion", F.col("mrr")).alias("expansion_mrr"),
        none.alias("lost"), F.lit(0).cast("long").alias("times"))
    # one aggregate per (user, instant) finds the churn rows that start and the
    # row that ended then (greatest started_at, subscription_id); only starts
    # of churn rows and ends of rows are shuffled
    met = (_instants(subs).filter((F.col("churned") == 1) | F.col("last_end").isNotNull())
           .groupBy("user_id", "at")
           .agg(F.sum("churned").alias("times"),
                F.max_by("mrr", "last_end").alias("lost"))
           .filter((F.col("times") > 0) & F.col("user_id").isNotNull()))
    losses = met.select(trunc_date("month", "at").alias("report_month"), none.alias("new_mrr"),
                        none.alias("expansion_mrr"), "lost", "times")
    monthly = gains.unionByName(losses).groupBy("report_month").agg(
        F.sum("new_mrr").alias("new_mrr"), F.sum("expansion_mrr").alias("expansion_mrr"),
        F.lit(0).cast("decimal(10,2)").alias("contraction_mrr"),
        F.sum(F.col("lost") * F.col("times")).cast("decimal(20,2)").alias("churn_mrr"))
    return _spine_join(_spine(subs, first_month, last_month), monthly)


def mrr_waterfall_delta(subs: DataFrame, first_month=DEFAULT_FIRST_MONTH,
                        last_month=DEFAULT_LAST_MONTH) -> DataFrame:
    """Waterfall from movements: each row is compared with its predecessor
    (same user, ended when it started).  new = MRR from zero; expansion /
    contraction = the difference; churn = MRR lost going to zero, or at
    ``ended_at`` when nothing follows.  Ending MRR equals active MRR when all
    changes fall inside the spine, as they do with bounds of None."""
    # equal amounts of one (user, instant) are counted together first, so what
    # the window sees per instant is its distinct amounts, not its rows
    amounts = _instants(subs).groupBy("user_id", "at", "mrr").agg(
        F.sum("starts").alias("starts"), F.count("last_end").alias("ends"),
        F.max("last_end").alias("last_end"))
    at = Window.partitionBy("user_id", "at")
    # rows without a user meet no other row: no predecessor, no successor
    known = F.col("user_id").isNotNull()
    zero = F.lit(0).cast("decimal(10,2)")
    met = amounts.select(
        trunc_date("month", "at").alias("report_month"), "starts", "ends",
        F.coalesce("mrr", zero).alias("mrr"),
        F.when(known, F.sum("starts").over(at)).otherwise(F.lit(0)).alias("followers"),
        F.coalesce(F.when(known, F.max_by("mrr", "last_end").over(at)), zero).alias("prev"))
    prev, mrr, n = F.col("prev"), F.col("mrr"), F.col("starts")
    monthly = met.groupBy("report_month").agg(*[
        F.sum(v).cast("decimal(20,2)").alias(c) for c, v in (
            ("new_mrr", F.when((prev == 0) & (mrr > 0) & (n > 0), mrr * n)),
            ("expansion_mrr", F.when((prev > 0) & (mrr > prev) & (n > 0), (mrr - prev) * n)),
            ("contraction_mrr", F.when((prev > 0) & (mrr > 0) & (mrr < prev) & (n > 0),
                                       (prev - mrr) * n)),
            # lost going to zero, and by rows that end with no successor
            ("churn_mrr", F.when((prev > 0) & (mrr == 0) & (n > 0), prev * n).otherwise(zero)
             + F.when((F.col("followers") == 0) & (mrr > 0), mrr * F.col("ends"))
             .otherwise(zero)))])
    return _spine_join(_spine(subs, first_month, last_month), monthly)
