"""Registered queries: MRR waterfall, retention and their reports."""

from __future__ import annotations

from tidemark.operators import retention as RT
from tidemark.operators import revenue as RV
from tidemark.plans import reports as R
from tidemark.plans.catalog import register
from tidemark.plans.oracle import rate, sql
from tidemark.sources import bindings as B

_MRR_COLS = """report_month, CAST(new_mrr AS DOUBLE) AS new_mrr,
  CAST(expansion_mrr AS DOUBLE) AS expansion_mrr,
  CAST(contraction_mrr AS DOUBLE) AS contraction_mrr, CAST(churn_mrr AS DOUBLE) AS churn_mrr,
  CAST(net_new_mrr AS DOUBLE) AS net_new_mrr, CAST(ending_mrr AS DOUBLE) AS ending_mrr"""


def waterfall(s, d):
    return RV.mrr_waterfall(B.subscriptions(s, d), B.MRR_FIRST_MONTH, B.MRR_LAST_MONTH)


def flags(s, d, as_of=None):
    return RT.retention_flags(B.users(s, d), B.user_events(s, d), B.subscriptions(s, d),
                              as_of=as_of)


@register("mrr_waterfall", sql(f"SELECT {_MRR_COLS} FROM o_mrr", "o_mrr"))
def q_mrr_waterfall(s, d):
    return waterfall(s, d)


@register("mrr_waterfall_delta", sql(f"SELECT {_MRR_COLS} FROM o_mrr_delta", "o_mrr_delta"))
def q_mrr_waterfall_delta(s, d):
    return RV.mrr_waterfall_delta(B.subscriptions(s, d), B.MRR_FIRST_MONTH, B.MRR_LAST_MONTH)


@register("kpi_current_mrr", sql("""
  SELECT CAST(ending_mrr AS DOUBLE) AS ending_mrr FROM o_mrr
  ORDER BY report_month DESC LIMIT 1""", "o_mrr"))
def q_kpi_current_mrr(s, d):
    return R.kpi_current_mrr(waterfall(s, d))


@register("mrr_series", sql("""
  SELECT report_month, series, CAST(value AS DOUBLE) AS value FROM (
    SELECT report_month, 'new' AS series, new_mrr AS value FROM o_mrr
    UNION ALL SELECT report_month, 'expansion', expansion_mrr FROM o_mrr
    UNION ALL SELECT report_month, 'churn', -churn_mrr FROM o_mrr
    UNION ALL SELECT report_month, 'ending', ending_mrr FROM o_mrr) t""", "o_mrr"))
def q_mrr_series(s, d):
    return R.mrr_series(waterfall(s, d))


_FLAG_COLS = ("user_id, cohort_week, region, signup_source, plan_at_latest, retention_day, "
              "is_retained")


@register("retention_flags", sql(f"SELECT {_FLAG_COLS} FROM o_retention", "o_retention"))
def q_retention_flags(s, d):
    return flags(s, d)


@register("retention_flags_eligible",
          sql(f"SELECT {_FLAG_COLS}, eligible FROM o_retention", "o_retention"))
def q_retention_flags_eligible(s, d):
    return flags(s, d, as_of=B.AS_OF)


_RATE = rate("sum(is_retained)", "count(is_retained)")


@register("retention_by_cohort", sql(f"""
  SELECT cohort_week, retention_day, {_RATE} AS retention_rate, count(*) AS cohort_size
  FROM o_retention GROUP BY cohort_week, retention_day""", "o_retention"))
def q_retention_by_cohort(s, d):
    return R.retention_by_cohort(flags(s, d))


@register("retention_heatmap", sql(f"""
  SELECT * FROM (
    SELECT cohort_week,
           max(rate) FILTER (WHERE retention_day = 1) AS d1,
           max(rate) FILTER (WHERE retention_day = 7) AS d7,
           max(rate) FILTER (WHERE retention_day = 14) AS d14,
           max(rate) FILTER (WHERE retention_day = 30) AS d30,
           max(rate) FILTER (WHERE retention_day = 60) AS d60,
           max(rate) FILTER (WHERE retention_day = 90) AS d90,
           count(rate) AS present
    FROM (SELECT cohort_week, retention_day, {_RATE} AS rate
          FROM o_retention GROUP BY cohort_week, retention_day) c
    GROUP BY cohort_week) w
  WHERE present >= 3 ORDER BY cohort_week DESC LIMIT 20""".replace(
    "SELECT * FROM (", "SELECT cohort_week, d1, d7, d14, d30, d60, d90 FROM ("),
    "o_retention"))
def q_retention_heatmap(s, d):
    return R.retention_heatmap(R.retention_by_cohort(flags(s, d)))


@register("retention_by_region", sql(f"""
  SELECT region AS segment, retention_day, {_RATE} AS retention_rate
  FROM o_retention GROUP BY region, retention_day""", "o_retention"))
def q_retention_by_region(s, d):
    return R.retention_by_region(flags(s, d))


@register("retention_by_source", sql(f"""
  SELECT signup_source AS segment, retention_day, {_RATE} AS retention_rate
  FROM o_retention GROUP BY signup_source, retention_day""", "o_retention"))
def q_retention_by_source(s, d):
    return R.retention_by_source(flags(s, d))


@register("retention_summary", sql(f"""
  SELECT retention_day, {_RATE} AS overall_rate, count(DISTINCT user_id) AS users
  FROM o_retention GROUP BY retention_day""", "o_retention"))
def q_retention_summary(s, d):
    return R.retention_summary(flags(s, d))
