"""Dashboard reports: the data behind every KPI, chart and table.

Filters are values, never SQL text.  Each report reduces a mart with one
aggregate (partial + final); windows only ever run over the handful of rows
an aggregate returns.  Rates use the exact rounding of ``functions.rates``.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rates import pct1, round_cents_avg
from tidemark.functions.timeops import ntz_lit
from tidemark.operators.specs import WINDOWS

# The dashboard's region list and its fallback source.
KNOWN_REGIONS = ("US", "UK", "AU")
FALLBACK_SOURCE = "organic"
FUNNEL_STAGES = (
    (1, "Signed Up", None),
    (2, "Created Board", "completed_board"),
    (3, "Invited Member", "completed_invite"),
    (4, "Active Week 2", "completed_week2"),
    (5, "Converted", "completed_conversion"),
)
SEGMENT_LABELS = {True: "Activated (2+ invites week 1)", False: "Not Activated"}


@dataclass(frozen=True)
class Filters:
    """Region and signup-source selection.

    ``None`` means no filter.  An empty tuple reproduces the dashboard's
    fallbacks: no region chosen -> all known regions; no source chosen ->
    'organic' only."""

    regions: tuple | None = None
    sources: tuple | None = None
    known_regions: tuple = KNOWN_REGIONS
    fallback_source: str = FALLBACK_SOURCE

    def region_values(self):
        if self.regions is None:
            return None
        return tuple(self.regions) or tuple(self.known_regions)

    def source_values(self):
        if self.sources is None:
            return None
        return tuple(self.sources) or (self.fallback_source,)


ALL = Filters()


def ordered_small(df: DataFrame, *cols) -> DataFrame:
    """ORDER BY for a report whose row count is bounded by its grouping keys
    (regions, plans, stages, weeks): the aggregate stays parallel, its few
    output rows move to one partition and are sorted there -- no range
    partitioning and no sampling job."""
    return df.repartition(1).sortWithinPartitions(*cols)


def apply_filters(df: DataFrame, f: Filters = ALL, regions: bool = True,
                  sources: bool = True) -> DataFrame:
    if regions and f.region_values() is not None:
        df = df.filter(F.col("region").isin(*f.region_values()))
    if sources and f.source_values() is not None:
        df = df.filter(F.col("signup_source").isin(*f.source_values()))
    return df


def _flag(col: str):
    return F.count_if(F.col(col))


def kpi_total_users(dim_users: DataFrame, f: Filters = ALL) -> DataFrame:
    return apply_filters(dim_users, f).agg(F.count(F.lit(1)).alias("n"))


def kpi_activation_rate(snapshot: DataFrame, f: Filters = ALL) -> DataFrame:
    """Share of users whose highest stage is >= 3 (NULL on no rows)."""
    return apply_filters(snapshot, f).agg(
        pct1(F.count_if(F.col("max_funnel_stage") >= 3), F.count(F.lit(1))).alias("rate"))


def _as_date(as_of) -> _dt.date:
    return as_of if isinstance(as_of, _dt.date) else _dt.date.fromisoformat(str(as_of))


def active_span(as_of) -> tuple[str, str]:
    """First and last timestamp (as text) that DAU, WAU and MAU look at."""
    return f"{_as_date(as_of) - _dt.timedelta(days=30)} 00:00:00", "9999-12-31 23:59:59.999999"


def kpi_dau_wau_mau(fct_events: DataFrame, as_of) -> DataFrame:
    """Distinct users active yesterday / in the last 7 / 30 days (no upper
    bound, as on the dashboard); ratio = WAU/MAU in percent, 0 if no MAU.

    Reduced per user first (two flags), so three distinct counts cost one
    shuffle of at most one row per user and map task."""
    day = _as_date(as_of)
    d1, d7, d30 = (day - _dt.timedelta(days=n) for n in (1, 7, 30))
    since = _dt.datetime.combine(d30, _dt.time())
    recent = fct_events.filter((F.col("event_timestamp") >= ntz_lit(since))
                               & (F.col("event_date") >= F.lit(d30))
                               & F.col("user_id").isNotNull())
    per_user = recent.groupBy("user_id").agg(
        F.max(F.col("event_date") == F.lit(d1)).alias("d"),
        F.max(F.col("event_date") >= F.lit(d7)).alias("w"))
    agg = per_user.agg(F.count_if("d").alias("dau"), F.count_if("w").alias("wau"),
                       F.count(F.lit(1)).alias("mau"))
    return agg.select("dau", "wau", "mau",
                      F.coalesce(pct1("wau", "mau"), F.lit(0.0)).alias("wau_mau_ratio"))


def kpi_current_mrr(waterfall: DataFrame) -> DataFrame:
    """Ending MRR of the latest spine month."""
    return waterfall.agg(F.max_by("ending_mrr", "report_month").alias("ending_mrr"))


def weekly_signups(dim_users: DataFrame, f: Filters = ALL) -> DataFrame:
    return ordered_small(apply_filters(dim_users, f).groupBy("signup_week")
                         .agg(F.count(F.lit(1)).alias("signups")), "signup_week")


def activation_by_source(dim_users: DataFrame, f: Filters = ALL) -> DataFrame:
    """Uses ``is_activated`` (>= 2 invites in week 1); region filter only."""
    agg = (apply_filters(dim_users, f, sources=False).groupBy("signup_source")
           .agg(F.count(F.lit(1)).alias("total"), _flag("is_activated").alias("activated")))
    return ordered_small(agg.withColumn("activation_rate", pct1("activated", "total")),
                         F.desc("activation_rate"))


def funnel_counts(snapshot: DataFrame, f: Filters = ALL) -> DataFrame:
    """Users per stage from completion flags, with % of the first stage and
    % of the previous stage (the first stage is 100% of itself)."""
    counts = apply_filters(snapshot, f).agg(*[
        (F.count(F.lit(1)) if flag is None else _flag(flag)).alias(f"s{n}")
        for n, _, flag in FUNNEL_STAGES])
    rows = F.array(*[F.struct(F.lit(n).cast("int").alias("stage_order"),
                              F.lit(label).alias("stage"), F.col(f"s{n}").alias("users"))
                     for n, label, _ in FUNNEL_STAGES])
    long = counts.select(F.inline(rows))
    order = Window.orderBy("stage_order")
    first = F.first("users").over(order.rowsBetween(Window.unboundedPreceding,
                                                     Window.currentRow))
    prev = F.coalesce(F.lag("users").over(order), F.col("users"))
    return long.select("stage_order", "stage", "users",
                       pct1(F.col("users"), first).alias("pct_of_initial"),
                       pct1(F.col("users"), prev).alias("pct_of_previous"))


def funnel_by_region(snapshot: DataFrame, f: Filters = ALL) -> DataFrame:
    """Per region: users and the share completing each milestone (source
    filter only)."""
    agg = apply_filters(snapshot, f, regions=False).groupBy("region").agg(
        F.count(F.lit(1)).alias("total"),
        _flag("completed_board").alias("b"), _flag("completed_invite").alias("i"),
        _flag("completed_week2").alias("w"), _flag("completed_conversion").alias("c"))
    return ordered_small(agg.select("region", "total",
                                    pct1("b", "total").alias("board_rate"),
                                    pct1("i", "total").alias("invite_rate"),
                                    pct1("w", "total").alias("week2_rate"),
                                    pct1("c", "total").alias("conversion_rate")), "region")


def conversion_by_activation(snapshot: DataFrame, f: Filters = ALL) -> DataFrame:
    agg = apply_filters(snapshot, f).groupBy("is_activated").agg(
        F.count(F.lit(1)).alias("users"), _flag("completed_conversion").alias("converted"))
    label = (F.when(F.col("is_activated"), SEGMENT_LABELS[True])
             .when(~F.col("is_activated"), SEGMENT_LABELS[False]))
    return agg.select("is_activated", "users", "converted",
                      pct1("converted", "users").alias("conversion_rate"),
                      label.alias("segment"))


def _retention_rate(alias: str):
    return pct1(F.sum("is_retained"), F.count("is_retained")).alias(alias)


def retention_by_cohort(flags: DataFrame, f: Filters = ALL) -> DataFrame:
    agg = (apply_filters(flags, f).groupBy("cohort_week", "retention_day")
           .agg(_retention_rate("retention_rate"), F.count(F.lit(1)).alias("cohort_size")))
    return ordered_small(agg, "cohort_week", "retention_day")


def retention_heatmap(by_cohort: DataFrame, windows=WINDOWS, min_values: int = 3,
                      last_n: int = 20) -> DataFrame:
    """Cohort x day matrix; cohorts with fewer than ``min_values`` rates are
    dropped, then the latest ``last_n`` cohorts are kept (a top-k report)."""
    days = [d for d, _, _ in windows]
    wide = (by_cohort.groupBy("cohort_week").pivot("retention_day", days)
            .agg(F.avg("retention_rate")))
    wide = wide.select("cohort_week", *[F.col(str(d)).alias(f"d{d}") for d in days])
    present = sum(F.col(f"d{d}").isNotNull().cast("int") for d in days)
    kept = wide.filter(present >= min_values)
    return ordered_small(kept.orderBy(F.desc("cohort_week")).limit(last_n), "cohort_week")


def _retention_by(flags: DataFrame, col: str, f: Filters) -> DataFrame:
    agg = (apply_filters(flags, f).groupBy(F.col(col).alias("segment"), "retention_day")
           .agg(_retention_rate("retention_rate")))
    return ordered_small(agg, "segment", "retention_day")


def retention_by_region(flags: DataFrame, f: Filters = ALL) -> DataFrame:
    return _retention_by(flags, "region", f)


def retention_by_source(flags: DataFrame, f: Filters = ALL) -> DataFrame:
    return _retention_by(flags, "signup_source", f)


def retention_summary(flags: DataFrame, f: Filters = ALL) -> DataFrame:
    agg = (apply_filters(flags, f).groupBy("retention_day")
           .agg(_retention_rate("overall_rate"), F.countDistinct("user_id").alias("users")))
    return ordered_small(agg, "retention_day")


def mrr_series(waterfall: DataFrame) -> DataFrame:
    """Long form of the waterfall chart: new, expansion, churn (negated),
    ending."""
    rows = F.array(
        F.struct(F.lit("new").alias("series"), F.col("new_mrr").alias("value")),
        F.struct(F.lit("expansion").alias("series"), F.col("expansion_mrr").alias("value")),
        F.struct(F.lit("churn").alias("series"), (-F.col("churn_mrr")).alias("value")),
        F.struct(F.lit("ending").alias("series"), F.col("ending_mrr").alias("value")))
    return ordered_small(waterfall.select("report_month", F.inline(rows)),
                         "report_month", "series")


def revenue_by_region(dim_users: DataFrame) -> DataFrame:
    paying = dim_users.filter(F.col("current_plan") != "free")
    agg = paying.groupBy("region").agg(
        F.countDistinct("user_id").alias("paying_users"),
        F.sum("current_mrr").alias("total_mrr"),
        F.sum((F.col("current_mrr") * 100).cast("long")).alias("cents"),
        F.count("current_mrr").alias("n"))
    return ordered_small(agg.select("region", "paying_users", "total_mrr",
                                    round_cents_avg("cents", "n").alias("arpu")),
                         F.desc("total_mrr"))


def plan_distribution(dim_users: DataFrame) -> DataFrame:
    agg = dim_users.groupBy("current_plan").agg(F.count(F.lit(1)).alias("users"),
                                                F.sum("current_mrr").alias("total_mrr"))
    everyone = F.sum("users").over(Window.partitionBy())
    return ordered_small(agg.select("current_plan", "users", "total_mrr",
                                    pct1(F.col("users"), everyone).alias("user_share")),
                         F.desc("total_mrr"))
