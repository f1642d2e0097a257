"""Registered queries: staging, funnel, activation, marts, reports."""

from __future__ import annotations

from tidemark.operators import engagement as E
from tidemark.operators import marts as M
from tidemark.operators import staging as S
from tidemark.plans import reports as R
from tidemark.plans.catalog import register
from tidemark.plans.oracle import rate, sql
from tidemark.sources import bindings as B


def _users(s, d):
    return B.users(s, d)


def _events(s, d):
    return B.user_events(s, d)


def _subs(s, d):
    return B.subscriptions(s, d)


def snapshot(s, d):
    return M.funnel_snapshot(_users(s, d), _events(s, d), _subs(s, d))


def dim_users(s, d):
    return M.dim_users(_users(s, d), _events(s, d), _subs(s, d))


# ---- staging ----------------------------------------------------------------
@register("stg_users", sql("SELECT * FROM stg_users", "stg_users"))
def q_stg_users(s, d):
    return S.stg_users(_users(s, d))


@register("stg_user_events", sql("SELECT * FROM stg_events", "stg_events"))
def q_stg_user_events(s, d):
    return S.stg_user_events(_events(s, d))


@register("stg_subscriptions", sql("""
  SELECT subscription_id, user_id, plan, CAST(mrr AS DOUBLE) AS mrr, started_at, ended_at,
         change_type, CAST(plan_mrr AS DOUBLE) AS plan_mrr, is_active
  FROM stg_subs""", "stg_subs"))
def q_stg_subscriptions(s, d):
    return S.stg_subscriptions(_subs(s, d))


@register("stg_feature_usage", sql("""
  SELECT *, CAST(used_at AS DATE) AS usage_date FROM b_usage""", "b_usage"))
def q_stg_feature_usage(s, d):
    return S.stg_feature_usage(B.feature_usage(s, d))


@register("stg_invoices", sql("""
  SELECT invoice_id, subscription_id, user_id, CAST(amount AS DOUBLE) AS amount, currency,
         status, issued_at, CAST(issued_at AS DATE) AS invoice_date,
         CAST(date_trunc('month', issued_at) AS DATE) AS invoice_month
  FROM b_invoices""", "b_invoices"))
def q_stg_invoices(s, d):
    return S.stg_invoices(B.invoices(s, d))


@register("stg_conversations", sql("""
  SELECT *, CASE WHEN resolved_at IS NOT NULL THEN
              CAST(epoch_us(resolved_at) - epoch_us(created_at) AS DOUBLE)
              / CAST(3600000000 AS DOUBLE) END AS resolution_hours
  FROM b_tickets""", "b_tickets"))
def q_stg_conversations(s, d):
    return S.stg_conversations(B.conversations(s, d))


# ---- funnel, activation, marts ------------------------------------------------
@register("funnel_stages", sql("SELECT * FROM o_funnel", "o_funnel"))
def q_funnel_stages(s, d):
    return E.funnel_stages(_users(s, d), _events(s, d), _subs(s, d))


@register("activation_score", sql("SELECT * FROM o_activation", "o_activation"))
def q_activation_score(s, d):
    return E.activation_score(_users(s, d), _events(s, d))


@register("funnel_snapshot", sql("SELECT * FROM o_snapshot", "o_snapshot"))
def q_funnel_snapshot(s, d):
    return snapshot(s, d)


@register("dim_users", sql("""
  SELECT * REPLACE (CAST(current_mrr AS DOUBLE) AS current_mrr) FROM o_dim_users""",
                           "o_dim_users"))
def q_dim_users(s, d):
    return dim_users(s, d)


@register("current_plan", sql("""
  SELECT user_id, current_plan, CAST(current_mrr AS DOUBLE) AS current_mrr
  FROM o_current_plan""", "o_current_plan"))
def q_current_plan(s, d):
    from tidemark.operators.revenue import current_plan
    return current_plan(_subs(s, d))


# ---- reports over the snapshot and dim_users ----------------------------------
@register("funnel_by_region", sql(f"""
  SELECT region, count(*) AS total,
         {rate('count(*) FILTER (WHERE completed_board)', 'count(*)')} AS board_rate,
         {rate('count(*) FILTER (WHERE completed_invite)', 'count(*)')} AS invite_rate,
         {rate('count(*) FILTER (WHERE completed_week2)', 'count(*)')} AS week2_rate,
         {rate('count(*) FILTER (WHERE completed_conversion)', 'count(*)')}
           AS conversion_rate
  FROM o_snapshot GROUP BY region ORDER BY region""", "o_snapshot"))
def q_funnel_by_region(s, d):
    return R.funnel_by_region(snapshot(s, d))


@register("kpi_total_users", sql("SELECT count(*) AS n FROM o_dim_users", "o_dim_users"))
def q_kpi_total_users(s, d):
    return R.kpi_total_users(dim_users(s, d))


@register("kpi_activation_rate", sql(f"""
  SELECT {rate('count(*) FILTER (WHERE max_funnel_stage >= 3)', 'count(*)')} AS rate
  FROM o_snapshot""", "o_snapshot"))
def q_kpi_activation_rate(s, d):
    return R.kpi_activation_rate(snapshot(s, d))


@register("weekly_signups", sql("""
  SELECT signup_week, count(*) AS signups FROM o_dim_users
  GROUP BY signup_week ORDER BY signup_week""", "o_dim_users"))
def q_weekly_signups(s, d):
    return R.weekly_signups(dim_users(s, d))


@register("activation_by_source", sql(f"""
  SELECT signup_source, count(*) AS total, count(*) FILTER (WHERE is_activated) AS activated,
         {rate('count(*) FILTER (WHERE is_activated)', 'count(*)')} AS activation_rate
  FROM o_dim_users GROUP BY signup_source""", "o_dim_users"))
def q_activation_by_source(s, d):
    return R.activation_by_source(dim_users(s, d))


@register("funnel_counts", sql(f"""
  SELECT stage_order, stage, users,
         {rate('users', 'first_value(users) OVER (ORDER BY stage_order)')} AS pct_of_initial,
         {rate('users', 'coalesce(lag(users) OVER (ORDER BY stage_order), users)')}
           AS pct_of_previous
  FROM (
    SELECT CAST(1 AS INTEGER) AS stage_order, 'Signed Up' AS stage, count(*) AS users
    FROM o_snapshot
    UNION ALL SELECT 2, 'Created Board', count(*) FILTER (WHERE completed_board) FROM o_snapshot
    UNION ALL SELECT 3, 'Invited Member', count(*) FILTER (WHERE completed_invite)
      FROM o_snapshot
    UNION ALL SELECT 4, 'Active Week 2', count(*) FILTER (WHERE completed_week2) FROM o_snapshot
    UNION ALL SELECT 5, 'Converted', count(*) FILTER (WHERE completed_conversion)
      FROM o_snapshot) t""", "o_snapshot"))
def q_funnel_counts(s, d):
    return R.funnel_counts(snapshot(s, d))


@register("conversion_by_activation", sql(f"""
  SELECT is_activated, count(*) AS users,
         count(*) FILTER (WHERE completed_conversion) AS converted,
         {rate('count(*) FILTER (WHERE completed_conversion)', 'count(*)')} AS conversion_rate,
         CASE WHEN is_activated THEN 'Activated (2+ invites week 1)'
              WHEN NOT is_activated THEN 'Not Activated' END AS segment
  FROM o_snapshot GROUP BY is_activated""", "o_snapshot"))
def q_conversion_by_activation(s, d):
    return R.conversion_by_activation(snapshot(s, d))


@register("revenue_by_region", sql("""
  SELECT region, count(DISTINCT user_id) AS paying_users,
         CAST(sum(current_mrr) AS DOUBLE) AS total_mrr,
         CAST((2 * sum(CAST(current_mrr * 100 AS BIGINT)) + count(current_mrr))
              // (2 * count(current_mrr)) AS DOUBLE) / CAST(100 AS DOUBLE) AS arpu
  FROM o_dim_users WHERE current_plan <> 'free'
  GROUP BY region""", "o_dim_users"))
def q_revenue_by_region(s, d):
    return R.revenue_by_region(dim_users(s, d))


@register("plan_distribution", sql(f"""
  SELECT current_plan, users, total_mrr,
         {rate('users', 'sum(users) OVER ()')} AS user_share
  FROM (SELECT current_plan, count(*) AS users, CAST(sum(current_mrr) AS DOUBLE) AS total_mrr
        FROM o_dim_users GROUP BY current_plan) t""", "o_dim_users"))
def q_plan_distribution(s, d):
    return R.plan_distribution(dim_users(s, d))
