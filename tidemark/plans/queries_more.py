"""Registered queries: facts, calendar, data tests, data jobs, incremental
loads, sinks and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.money import cents_to_dollars
from tidemark.operators import engagement as E
from tidemark.operators import incremental as I
from tidemark.operators import jobs as J
from tidemark.operators import marts as M
from tidemark.operators import quality as Q
from tidemark.operators import retention as RT
from tidemark.operators import revenue as RV
from tidemark.plans import reports as R
from tidemark.plans import suite as SU
from tidemark.plans.catalog import register
from tidemark.plans.oracle import BROKEN, cte, rate, sql
from tidemark.sources import bindings as B
from tidemark.sources import sinks as SK
from tidemark.sources.contracts import cast_to_contract, infer_contract, split_by_contract

# Fixed values of the registered incremental runs: the first load takes the
# events before this instant, the second run offers all events.
INCREMENTAL_SPLIT = "2024-01-16 00:00:00"
LOOKBACK_DAYS = 3


def _fct_events(s, d):
    return M.fct_user_events(B.users(s, d), B.user_events(s, d))


@register("fct_user_events", sql("SELECT * FROM o_fct_events", "o_fct_events"))
def q_fct_user_events(s, d):
    return _fct_events(s, d)


@register("fct_subscriptions", sql("""
  SELECT * REPLACE (CAST(mrr AS DOUBLE) AS mrr, CAST(plan_mrr AS DOUBLE) AS plan_mrr)
  FROM o_fct_subs""", "o_fct_subs"))
def q_fct_subscriptions(s, d):
    return M.fct_subscriptions(B.users(s, d), B.subscriptions(s, d))


@register("dim_date", sql("SELECT * FROM o_dim_date", "o_dim_date"))
def q_dim_date(s, d):
    """Calendar over the span of subscription starts (bounds from the data)."""
    subs = B.subscriptions(s, d)
    span = subs.agg(F.min(F.to_date("started_at")).alias("lo"),
                    F.max(F.to_date("started_at")).alias("hi"))
    return M.dim_date(s, F.col("lo"), F.col("hi"), bounds=span)


@register("kpi_dau_wau_mau", sql(f"""
  SELECT *, coalesce({rate('wau', 'mau')}, CAST(0 AS DOUBLE)) AS wau_mau_ratio
  FROM (SELECT count(*) FILTER (WHERE list_contains(days, DATE '2024-01-30')) AS dau,
               count(*) FILTER (WHERE list_max(days) > DATE '2024-01-23') AS wau,
               count(*) FILTER (WHERE list_max(days) > DATE '2023-12-31') AS mau
        FROM (SELECT user_id, list(DISTINCT event_date) AS days FROM o_fct_events
              WHERE user_id IS NOT NULL GROUP BY user_id) u) t""", "o_fct_events"))
def q_kpi_dau_wau_mau(s, d):
    return R.kpi_dau_wau_mau(_fct_events(s, d), B.AS_OF)


@register("cents_to_dollars", sql("""
  SELECT o_orderkey, cents,
         CAST(CAST(CAST(cents AS DECIMAL(16,2)) / 100 AS DECIMAL(16,2)) AS DOUBLE) AS dollars
  FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders) o"""))
def q_cents_to_dollars(s, d):
    o = B.read_driver_table(s, d, "orders")
    c = o.select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return c.select("o_orderkey", "cents", cents_to_dollars("cents").alias("dollars"))


@register("load_raw_cast", sql("""
  SELECT CAST(subscription_id AS VARCHAR) AS subscription_id,
         CAST(user_id AS VARCHAR) AS user_id, plan, CAST(mrr AS DOUBLE) AS mrr,
         started_at, ended_at, change_type
  FROM b_subs""", "b_subs"))
def q_load_raw_cast(s, d):
    return cast_to_contract(B.subscriptions(s, d), "subscriptions")


# Invoices as a careless export would write them: all text, some of it broken.
cte("o_raw_invoices", ("b_invoices",), """
  SELECT CAST(invoice_id AS VARCHAR) AS invoice_id,
         CASE WHEN invoice_id % 61 <> 0 THEN CAST(subscription_id AS VARCHAR) END
           AS subscription_id,
         CAST(user_id AS VARCHAR) AS user_id,
         CASE WHEN invoice_id % 97 = 0 THEN 'n/a' WHEN invoice_id % 89 = 0 THEN '123456789012.50'
              ELSE CAST(amount AS VARCHAR) END AS amount, currency, status,
         CASE WHEN invoice_id % 83 = 0 THEN '2024-13-45 00:00:00'
              ELSE strftime(issued_at, '%Y-%m-%d %H:%M:%S') END AS issued_at
  FROM b_invoices""")


def _raw_invoices(s, d):
    i = F.col("invoice_id")
    return B.invoices(s, d).select(
        i.cast("string").alias("invoice_id"),
        F.when(i % 61 != 0, F.col("subscription_id").cast("string")).alias("subscription_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.when(i % 97 == 0, "n/a").when(i % 89 == 0, "123456789012.50")
        .otherwise(F.col("amount").cast("string")).alias("amount"), "currency", "status",
        F.when(i % 83 == 0, "2024-13-45 00:00:00")
        .otherwise(F.date_format("issued_at", "yyyy-MM-dd HH:mm:ss")).alias("issued_at"))


_REQUIRED = ("invoice_id", "subscription_id")


@register("load_accepted", sql("""
  SELECT invoice_id, subscription_id, user_id, CAST(CAST(amount AS DECIMAL(10,2)) AS DOUBLE)
           AS amount, currency, status, CAST(issued_at AS TIMESTAMP) AS issued_at
  FROM o_raw_invoices
  WHERE subscription_id IS NOT NULL AND TRY_CAST(amount AS DECIMAL(10,2)) IS NOT NULL
    AND TRY_CAST(issued_at AS TIMESTAMP) IS NOT NULL""",
                               "o_raw_invoices"))
def q_load_accepted(s, d):
    return split_by_contract(_raw_invoices(s, d), "invoices", _REQUIRED)[0]


@register("load_rejects", sql("""
  SELECT invoice_id, 'subscription_id' AS column_name, CAST(NULL AS VARCHAR) AS value,
         'missing' AS reason FROM o_raw_invoices WHERE subscription_id IS NULL
  UNION ALL SELECT invoice_id, 'amount', amount, 'not decimal(10,2)' FROM o_raw_invoices
            WHERE TRY_CAST(amount AS DECIMAL(10,2)) IS NULL
  UNION ALL SELECT invoice_id, 'issued_at', issued_at, 'not timestamp_ntz' FROM o_raw_invoices
            WHERE TRY_CAST(issued_at AS TIMESTAMP) IS NULL""", "o_raw_invoices"))
def q_load_rejects(s, d):
    rejected = split_by_contract(_raw_invoices(s, d), "invoices", _REQUIRED)[1]
    return rejected.select(F.get_json_object("row", "$.invoice_id").alias("invoice_id"),
                           "column_name", "value", "reason")


@register("load_inferred", sql("""
  SELECT o_orderkey AS order_key, CAST(round(o_totalprice * 100) AS BIGINT) * 1000000 AS micros,
         CAST(CAST(o_totalprice AS DECIMAL(10,2)) AS DOUBLE) AS amount,
         CAST(o_orderdate AS DATE) AS day, o_orderstatus AS status,
         o_orderkey % 2 = 0 AS even FROM orders"""))
def q_load_inferred(s, d):
    """Orders as text, loaded with the types their values have."""
    o = B.read_driver_table(s, d, "orders")
    text = o.select(
        F.col("o_orderkey").cast("string").alias("order_key"),
        (F.round(F.col("o_totalprice") * 100).cast("long") * 1000000).cast("string")
        .alias("micros"),
        F.col("o_totalprice").cast("decimal(10,2)").cast("string").alias("amount"),
        F.to_date("o_orderdate").cast("string").alias("day"),
        F.col("o_orderstatus").alias("status"),
        (F.col("o_orderkey") % 2 == 0).cast("string").alias("even"))
    typed = cast_to_contract(text, infer_contract(text))
    return typed.withColumn("order_key", F.col("order_key").cast("long"))


# ---- data tests ---------------------------------------------------------------
@register("dq_not_null", sql("""
  SELECT * FROM b_events WHERE event_id IS NULL OR user_id IS NULL OR event_type IS NULL
    OR event_timestamp IS NULL""", "b_events"))
def q_dq_not_null(s, d):
    return Q.not_null(B.user_events(s, d), "event_id", "user_id", "event_type",
                      "event_timestamp")


@register("dq_unique", sql("""
  SELECT l_orderkey, l_linenumber, count(*) AS n_records FROM lineitem
  WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL
  GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"""))
def q_dq_unique(s, d):
    return Q.unique(B.read_driver_table(s, d, "lineitem"), "l_orderkey", "l_linenumber")


@register("dq_accepted_values", sql("""
  SELECT region AS value_field, count(*) AS n_records FROM o_dim_users
  WHERE region IS NOT NULL AND region NOT IN ('US', 'UK', 'AU') GROUP BY region""",
                                    "o_dim_users"))
def q_dq_accepted_values(s, d):
    dim = M.dim_users(B.users(s, d), B.user_events(s, d), B.subscriptions(s, d))
    return Q.accepted_values(dim, "region", SU.REGIONS)


@register("dq_relationships", sql("""
  SELECT * FROM b_users u WHERE u.user_id IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM b_events e WHERE e.user_id = u.user_id)""",
                                  "b_users", "b_events"))
def q_dq_relationships(s, d):
    """Users (customers) with no event: child = users, parent = event users."""
    return Q.relationships(B.users(s, d), "user_id", B.user_events(s, d), "user_id")


@register("dq_milestones_after_signup", sql(BROKEN["milestones"], "o_snapshot"))
def q_dq_milestones(s, d):
    return Q.milestones_after_signup(
        M.funnel_snapshot(B.users(s, d), B.user_events(s, d), B.subscriptions(s, d)))


@register("dq_mrr_reconciliation", sql(BROKEN["reconciliation"], "o_mrr"))
def q_dq_mrr_reconciliation(s, d):
    return Q.mrr_reconciliation(
        RV.mrr_waterfall(B.subscriptions(s, d), B.MRR_FIRST_MONTH, B.MRR_LAST_MONTH))


@register("dq_mrr_against_active", sql("""
  SELECT ending_mrr, active_mrr FROM (
    SELECT (SELECT CAST(ending_mrr AS DOUBLE) FROM o_mrr ORDER BY report_month DESC LIMIT 1)
             AS ending_mrr,
           (SELECT CAST(coalesce(sum(mrr), 0) AS DOUBLE) FROM b_subs WHERE ended_at IS NULL)
             AS active_mrr) t
  WHERE abs(ending_mrr - active_mrr) > 0.01""", "o_mrr", "b_subs"))
def q_dq_mrr_against_active(s, d):
    """The reconciliation made real: final ending MRR (reference rule) against
    the MRR of open subscriptions."""
    subs = B.subscriptions(s, d)
    return Q.mrr_against_active(RV.mrr_waterfall(subs, B.MRR_FIRST_MONTH, B.MRR_LAST_MONTH),
                                subs)


@register("dq_events_before_signup", sql(BROKEN["early_events"], "o_aged"))
def q_dq_events_before_signup(s, d):
    # the fact's event columns and the dimension's signup time come unchanged
    # from their inputs, so the test joins these once
    return Q.events_before_signup(B.user_events(s, d), B.users(s, d))


@register("dq_retention_boolean", sql(BROKEN["boolean"], "o_retention"))
def q_dq_retention_boolean(s, d):
    return Q.retention_boolean(
        RT.retention_flags(B.users(s, d), B.user_events(s, d), B.subscriptions(s, d)))


@register("dq_not_null_resolved", sql("SELECT * FROM b_tickets WHERE resolved_at IS NULL",
                                      "b_tickets"))
def q_dq_not_null_resolved(s, d):
    """The not-null test on a column that does hold nulls."""
    return Q.not_null(B.conversations(s, d), "resolved_at")


@register("dq_boolean_active_days", sql("""
  SELECT user_id, 7 AS retention_day, active_days_week1 AS is_retained FROM o_activation
  WHERE active_days_week1 > 1""", "o_activation"))
def q_dq_boolean_active_days(s, d):
    """The boolean test on a count: active days of week 1 in place of a flag."""
    score = E.activation_score(B.users(s, d), B.user_events(s, d))
    return Q.retention_boolean(score.select("user_id", F.lit(7).alias("retention_day"),
                                            F.col("active_days_week1").alias("is_retained")))


@register("dq_mrr_reconciliation_delta", sql("""
  SELECT r.report_month, CAST(r.ending_mrr AS DOUBLE) AS ending_mrr,
         CAST(m.ending_mrr AS DOUBLE) AS expected_ending_mrr,
         CAST(abs(r.ending_mrr - m.ending_mrr) AS DOUBLE) AS difference
  FROM o_mrr r JOIN o_mrr_delta m USING (report_month)
  WHERE abs(r.ending_mrr - m.ending_mrr) > 0.01""", "o_mrr", "o_mrr_delta"))
def q_dq_mrr_reconciliation_delta(s, d):
    """The reconciliation test on net amounts that do not add up: ending MRR by
    the full-amount rule against the movements."""
    subs = B.subscriptions(s, d)
    months = (B.MRR_FIRST_MONTH, B.MRR_LAST_MONTH)
    ending = RV.mrr_waterfall(subs, *months).select("report_month", "ending_mrr")
    net = RV.mrr_waterfall_delta(subs, *months).select("report_month", "net_new_mrr")
    return Q.mrr_reconciliation(ending.join(net, "report_month"))


@register("dq_suite", SU.suite_sql())
def q_dq_suite(s, d):
    return SU.spark_suite(SU.driver_frames(s, d))


# ---- data jobs -------------------------------------------------------------------
@register("events_before_churn", sql("""
  SELECT e.event_id, e.user_id, e.event_type, e.event_timestamp, e.event_properties
  FROM b_events e
  LEFT JOIN (SELECT user_id, min(started_at) AS churn_date FROM b_subs
             WHERE change_type = 'churn' GROUP BY user_id) c ON c.user_id = e.user_id
  WHERE c.churn_date IS NULL OR e.event_timestamp <= c.churn_date""", "b_events", "b_subs"))
def q_events_before_churn(s, d):
    return J.events_before_churn(B.user_events(s, d), B.subscriptions(s, d))


@register("activation_lift", sql(f"""
  SELECT true AS is_activated, ta AS users, pa AS paid, {rate('pa', 'ta')} AS conversion_pct,
         {rate('pa * tn', 'ta * pn', 1)} AS lift FROM o_lift_totals
  UNION ALL
  SELECT false, tn, pn, {rate('pn', 'tn')}, {rate('pa * tn', 'ta * pn', 1)} FROM o_lift_totals""",
    "o_lift_totals"))
def q_activation_lift(s, d):
    return J.activation_lift(B.users(s, d), B.user_events(s, d), B.subscriptions(s, d))


@register("invoice_schedule", sql("""
  SELECT subscription_id, user_id, CAST(mrr AS DOUBLE) AS amount,
         greatest(m, started_at) AS issued_at
  FROM (SELECT subscription_id, user_id, mrr, started_at,
               unnest(generate_series(started_at - to_days(CAST(day(started_at) - 1 AS INTEGER)),
                                      coalesce(ended_at, TIMESTAMP '2024-01-31 00:00:00'),
                                      INTERVAL 1 MONTH)) AS m
        FROM b_subs WHERE mrr > 0) t""", "b_subs"))
def q_invoice_schedule(s, d):
    return J.invoice_schedule(B.subscriptions(s, d), B.AS_OF)


@register("user_active_span", sql("""
  SELECT user_id, min(event_timestamp) AS first_event_at, max(event_timestamp) AS last_event_at
  FROM b_events GROUP BY user_id""", "b_events"))
def q_user_active_span(s, d):
    return J.user_active_span(B.user_events(s, d))


# ---- incremental loads ---------------------------------------------------------
_INC_SQL = """
  SELECT * FROM o_inc_initial i
  WHERE NOT EXISTS (SELECT 1 FROM {batch} b WHERE b.event_id = i.event_id)
  UNION ALL SELECT * FROM {batch}"""


@register("fct_user_events_incremental",
          sql(_INC_SQL.format(batch="o_inc_strict"), "o_inc_initial", "o_inc_strict"))
def q_fct_user_events_incremental(s, d):
    users, events = B.users(s, d), B.user_events(s, d)
    first = I.merge_events(None, users, events.filter(
        F.col("event_timestamp") < F.lit(INCREMENTAL_SPLIT).cast("timestamp_ntz")))
    return I.merge_events(first, users, events, "strict")


@register("fct_user_events_lookback",
          sql(_INC_SQL.format(batch="o_inc_lookback"), "o_inc_initial", "o_inc_lookback"))
def q_fct_user_events_lookback(s, d):
    users, events = B.users(s, d), B.user_events(s, d)
    first = I.merge_events(None, users, events.filter(
        F.col("event_timestamp") < F.lit(INCREMENTAL_SPLIT).cast("timestamp_ntz")))
    return I.merge_events(first, users, events, "lookback", LOOKBACK_DAYS)


# ---- sinks and sources --------------------------------------------------------
@register("sink_table", sql("""
  SELECT * REPLACE (CAST(current_mrr AS DOUBLE) AS current_mrr) FROM o_dim_users""",
                            "o_dim_users"))
def q_sink_table(s, d):
    """dim_users written as a table in the shared folder and read back."""
    dim = M.dim_users(B.users(s, d), B.user_events(s, d), B.subscriptions(s, d))
    return SK.sink_table(dim, SK.scratch_table_path(s, "dim_users"))


@register("sink_view", sql("SELECT * FROM o_funnel", "o_funnel"))
def q_sink_view(s, d):
    from tidemark.operators.engagement import funnel_stages
    f = funnel_stages(B.users(s, d), B.user_events(s, d), B.subscriptions(s, d))
    return SK.sink_view(f, "int_users_funnel_stages")


@register("scan_csv_seed", sql("SELECT * FROM customer"))
def q_scan_csv_seed(s, d):
    """The customer table exported as a headed CSV seed, scanned back with
    an explicit schema in FAILFAST mode."""
    from tidemark.sources.seeds import scan_csv_seed, write_csv_seed
    c = B.read_driver_table(s, d, "customer")
    path = write_csv_seed(c, SK.scratch_table_path(s, "seed_customer"))
    return scan_csv_seed(s, path, c.schema)
