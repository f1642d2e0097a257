"""DuckDB SQL used as an independent oracle for the registered queries.

Written from the definitions, not from the Spark code: every stage a user
reaches is a row and the funnel reads the first row of each, scores come from
a table of point tiers joined by threshold, retention is an EXISTS per (user,
window), the latest plan is a row_number, revenue is a ledger of signed
amounts summed up to each month.  The driver's tables are pre-registered as
views; the ``b_*`` CTEs are the fixture binding of FIXTURES.md C.
"""

from __future__ import annotations

# name -> (dependencies, body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, deps: tuple[str, ...], body: str) -> None:
    CTES[name] = (deps, body)


def rate(a: str, b: str, scale: int = 100) -> str:
    """round(scale * a / b, 1) half away from zero, exact; NULL when b = 0."""
    return (f"CASE WHEN ({b}) <> 0 THEN CAST((({a}) * {scale * 20} + ({b})) // (2 * ({b}))"
            f" AS DOUBLE) / CAST(10 AS DOUBLE) END")


def hours(a: str, b: str, unit_us: int = 3_600_000_000) -> str:
    return f"CAST(epoch_us({b}) - epoch_us({a}) AS DOUBLE) / CAST({unit_us} AS DOUBLE)"


# ---- binding ----------------------------------------------------------------
cte("b_users", (), """
  SELECT c.c_custkey AS user_id, lower(c.c_name) || '@example.com' AS email,
         c.c_name AS full_name, r.r_name AS region, c.c_mktsegment AS signup_source,
         TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(c.c_custkey % 28 AS INTEGER))
           AS signed_up_at,
         'free' AS initial_plan
  FROM customer c
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey""")
cte("b_events", (), """
  SELECT event_id, user_id,
         CASE WHEN event_type = 'signup' AND value >= 120 THEN 'board_created'
              WHEN event_type = 'purchase' AND value >= 100 THEN 'member_invited'
              WHEN event_type = 'view' THEN 'task_created'
              WHEN event_type = 'click' THEN 'task_completed'
              WHEN event_type = 'error' THEN 'settings_changed'
              WHEN event_type = 'signup' THEN 'comment_added'
              WHEN event_type = 'purchase' THEN 'file_uploaded' END AS event_type,
         ts AS event_timestamp, props AS event_properties
  FROM events""")
cte("b_subs_raw", (), """
  SELECT o_orderkey AS subscription_id, o_custkey AS user_id, plan,
         CAST(CASE plan WHEN 'enterprise' THEN 99 WHEN 'pro' THEN 29 ELSE 0 END
              AS DECIMAL(10,2)) AS mrr,
         o_orderdate + to_days(10592) + to_seconds(o_orderkey % 86400) AS started_at
  FROM (SELECT *, CASE WHEN o_custkey % 3 <> 0 THEN 'free'
                       WHEN o_orderpriority = '1-URGENT' THEN 'enterprise'
                       WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 'pro'
                       ELSE 'free' END AS plan
        FROM orders) o""")
cte("b_subs", ("b_subs_raw",), """
  SELECT subscription_id, user_id, plan, mrr, started_at,
         lead(started_at) OVER w AS ended_at,
         CASE WHEN lag(mrr) OVER w IS NULL THEN 'new'
              WHEN mrr = 0 AND lag(mrr) OVER w > 0 THEN 'churn'
              WHEN mrr > lag(mrr) OVER w THEN 'expansion'
              WHEN mrr < lag(mrr) OVER w THEN 'contraction'
              ELSE 'renewal' END AS change_type
  FROM b_subs_raw
  WINDOW w AS (PARTITION BY user_id ORDER BY started_at, subscription_id)""")
cte("b_usage", (), """
  SELECT event_id AS usage_id, user_id,
         CASE event_type WHEN 'view' THEN 'kanban_board' WHEN 'click' THEN 'time_tracking'
              WHEN 'signup' THEN 'templates' WHEN 'purchase' THEN 'reporting'
              WHEN 'error' THEN 'api_access' END AS feature_name,
         ts AS used_at, CAST(floor(value) AS INTEGER) AS duration_seconds
  FROM events""")
cte("b_invoices", (), """
  SELECT o_orderkey AS invoice_id, o_orderkey AS subscription_id, o_custkey AS user_id,
         CAST(o_totalprice AS DECIMAL(10,2)) AS amount, 'usd' AS currency,
         CASE WHEN o_orderstatus = 'O' THEN 'failed' ELSE 'paid' END AS status,
         o_orderdate + to_days(10592) AS issued_at
  FROM orders""")
cte("b_tickets", (), """
  SELECT o_orderkey AS conversation_id, o_custkey AS user_id, o_orderpriority AS topic,
         CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open'
              WHEN 'P' THEN 'snoozed' END AS status,
         o_orderdate + to_days(10592) AS created_at,
         CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_days(10592)
              + to_seconds(3600 * (1 + o_orderkey % 72) + 60 * (o_orderkey % 60)) END
           AS resolved_at,
         CAST(2 + o_orderkey % 14 AS INTEGER) AS messages_count,
         CAST(5 + o_orderkey % 1436 AS INTEGER) AS first_response_minutes
  FROM orders""")

# ---- staging ----------------------------------------------------------------
cte("stg_users", ("b_users",), """
  SELECT *, CAST(date_trunc('week', signed_up_at) AS DATE) AS signup_week,
         CAST(date_trunc('month', signed_up_at) AS DATE) AS signup_month
  FROM b_users""")
cte("stg_events", ("b_events",), """
  SELECT *, CAST(event_timestamp AS DATE) AS event_date,
         date_trunc('hour', event_timestamp) AS event_hour
  FROM b_events""")
cte("stg_subs", ("b_subs",), """
  SELECT *, CAST(CASE plan WHEN 'free' THEN 0 WHEN 'pro' THEN 29 WHEN 'enterprise' THEN 99
                END AS DECIMAL(10,2)) AS plan_mrr,
         ended_at IS NULL AS is_active
  FROM b_subs""")

# ---- funnel & activation ------------------------------------------------------
# Events of known users with their age: microseconds since the user signed up.
cte("o_aged", ("b_events", "b_users"), """
  SELECT e.event_id, e.user_id, e.event_type, e.event_timestamp, u.signed_up_at,
         epoch_us(e.event_timestamp) - epoch_us(u.signed_up_at) AS age_us
  FROM b_events e JOIN b_users u USING (user_id)""")
# One row per stage and moment that reaches it; 604800000000 us are a week.
cte("o_reached", ("b_users", "b_subs", "o_aged"), """
  SELECT user_id, 1 AS stage, signed_up_at AS reached_at FROM b_users
  UNION ALL
  SELECT user_id, list_position(['board_created', 'member_invited'], event_type) + 1,
         event_timestamp
  FROM o_aged WHERE event_type IN ('board_created', 'member_invited')
  UNION ALL
  SELECT user_id, 4, event_timestamp FROM o_aged WHERE age_us // 604800000000 = 1
  UNION ALL
  SELECT user_id, 5, started_at FROM b_subs SEMI JOIN b_users USING (user_id)
  WHERE plan <> 'free'""")
cte("o_firsts", ("o_reached",), """
  SELECT DISTINCT ON (user_id, stage) user_id, stage, reached_at FROM o_reached
  WHERE reached_at IS NOT NULL ORDER BY user_id, stage, reached_at""")
cte("o_funnel", ("o_firsts",), """
  SELECT user_id, path[1] AS signed_up_at, path[2] AS created_first_board_at,
         path[3] AS invited_first_member_at, path[4] AS active_in_week_2_at,
         path[5] AS upgraded_to_paid_at, CAST(furthest AS INTEGER) AS max_funnel_stage
  FROM (SELECT user_id, max(stage) AS furthest,
               map_from_entries(list((stage, reached_at))) AS path
        FROM o_firsts GROUP BY user_id) p""")
# What a user did in the first week, one row per signal.
cte("o_week1_signals", ("o_aged",), """
  SELECT user_id, event_type AS signal, count(*) AS n
  FROM o_aged WHERE age_us < 604800000000 AND event_type IS NOT NULL
  GROUP BY ALL
  UNION ALL
  SELECT user_id, 'active day', count(*)
  FROM (SELECT DISTINCT user_id, CAST(event_timestamp AS DATE) AS d
        FROM o_aged WHERE age_us < 604800000000) x
  GROUP BY user_id""")
# Points of the best tier reached count, per signal.
cte("o_tiers", (), """
  SELECT * FROM (VALUES ('board_created', 1, 20),
                        ('member_invited', 1, 15), ('member_invited', 2, 30),
                        ('member_invited', 3, 40),
                        ('task_created', 2, 10), ('task_created', 5, 20),
                        ('active day', 3, 10), ('active day', 5, 20))
    t(signal, at_least, points)""")
cte("o_points", ("o_week1_signals", "o_tiers"), """
  SELECT DISTINCT ON (user_id, signal) user_id, signal, points
  FROM o_week1_signals s JOIN o_tiers t USING (signal)
  WHERE s.n >= t.at_least ORDER BY user_id, signal, t.at_least DESC""")
cte("o_signal_map", ("o_week1_signals",), """
  SELECT user_id, map_from_entries(list((signal, n))) AS had,
         CAST(sum(n) FILTER (WHERE signal <> 'active day') AS BIGINT) AS total
  FROM o_week1_signals GROUP BY user_id""")
cte("o_activation", ("b_users", "o_signal_map", "o_points"), """
  SELECT user_id,
         coalesce(had['board_created'], 0) AS boards_created_week1,
         coalesce(had['member_invited'], 0) AS members_invited_week1,
         coalesce(had['task_created'], 0) AS tasks_created_week1,
         coalesce(total, 0) AS total_events_week1,
         coalesce(had['active day'], 0) AS active_days_week1,
         CAST(least(coalesce((SELECT sum(points) FROM o_points p
                              WHERE p.user_id = u.user_id), 0), 100) AS INTEGER)
           AS activation_score,
         coalesce(had['member_invited'] > 1, false) AS is_activated
  FROM b_users u LEFT JOIN o_signal_map USING (user_id)""")
cte("o_current_plan", ("b_subs",), """
  SELECT user_id, plan AS current_plan, mrr AS current_mrr
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id
                                     ORDER BY started_at DESC NULLS FIRST,
                                              subscription_id DESC) AS rn
        FROM b_subs) s
  WHERE rn = 1""")
# Everything known of a user; funnel and activation hold one row per user.
cte("o_profile", ("stg_users", "o_funnel", "o_activation", "o_current_plan"), """
  SELECT * REPLACE (coalesce(current_plan, 'free') AS current_plan,
                    coalesce(current_mrr, CAST(0 AS DECIMAL(10,2))) AS current_mrr)
  FROM (SELECT * EXCLUDE (signed_up_at) FROM o_funnel) f
  NATURAL JOIN o_activation NATURAL JOIN stg_users
  LEFT JOIN o_current_plan USING (user_id)""")
cte("o_dim_users", ("o_profile",), """
  SELECT user_id, email, full_name, region, signup_source, signed_up_at, signup_week,
         signup_month, initial_plan, current_plan, current_mrr, created_first_board_at,
         invited_first_member_at, active_in_week_2_at, upgraded_to_paid_at,
         max_funnel_stage, activation_score, is_activated, members_invited_week1,
         tasks_created_week1, active_days_week1,
         ['signed_up_only', 'created_board', 'invited_member', 'retained_week2',
          'converted'][max_funnel_stage] AS lifecycle_stage
  FROM o_profile""")
cte("o_snapshot", ("o_profile",), f"""
  SELECT user_id, region, signup_source, signup_week AS cohort_week,
         signup_month AS cohort_month, signed_up_at, created_first_board_at,
         invited_first_member_at, active_in_week_2_at, upgraded_to_paid_at,
         {hours('signed_up_at', 'created_first_board_at')} AS hours_to_first_board,
         {hours('created_first_board_at', 'invited_first_member_at')} AS hours_board_to_invite,
         {hours('signed_up_at', 'upgraded_to_paid_at')} AS hours_to_conversion,
         created_first_board_at IS NOT NULL AS completed_board,
         invited_first_member_at IS NOT NULL AS completed_invite,
         active_in_week_2_at IS NOT NULL AS completed_week2,
         upgraded_to_paid_at IS NOT NULL AS completed_conversion,
         max_funnel_stage, activation_score, is_activated
  FROM o_profile""")


def sql(body: str, *deps: str) -> str:
    """``WITH <deps in dependency order> <body>``."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for d in CTES[name][0]:
            visit(d)
        order.append(name)

    for d in deps:
        visit(d)
    if not order:
        return body.strip()
    parts = ",\n".join(f"{n} AS ({CTES[n][1]}\n)" for n in order)
    return f"WITH {parts}\n{body.strip()}"


# ---- revenue ------------------------------------------------------------------
# Every month from the first to the last moment a subscription starts or ends.
cte("o_months", ("b_subs",), """
  SELECT CAST(unnest(generate_series(date_trunc('month', min(moment)),
                                     date_trunc('month', max(moment)), INTERVAL 1 MONTH)) AS DATE)
           AS report_month
  FROM (SELECT unnest([started_at, ended_at]) AS moment FROM b_subs) t""")
# What a user paid just before an instant at which a row of theirs ends.
cte("o_paid_until", ("b_subs",), """
  SELECT user_id, ended_at AS instant,
         last(mrr ORDER BY started_at, subscription_id) AS paid
  FROM b_subs WHERE ended_at IS NOT NULL GROUP BY ALL""")
# Signed amounts per month and kind of change.
cte("o_ledger", ("b_subs", "o_paid_until"), """
  SELECT CAST(date_trunc('month', s.started_at) AS DATE) AS booked, s.change_type AS kind,
         sum(CASE s.change_type WHEN 'churn' THEN -p.paid ELSE s.mrr END) AS amount
  FROM b_subs s
  LEFT JOIN o_paid_until p ON p.user_id = s.user_id AND p.instant = s.started_at
  WHERE s.change_type IN ('expansion', 'churn')
     OR (s.change_type = 'new' AND s.plan <> 'free')
  GROUP BY ALL""")
cte("o_mrr", ("o_months", "o_ledger"), """
  SELECT m.report_month,
         coalesce(sum(amount) FILTER (WHERE booked = m.report_month AND kind = 'new'), 0)
           AS new_mrr,
         coalesce(sum(amount) FILTER (WHERE booked = m.report_month AND kind = 'expansion'), 0)
           AS expansion_mrr,
         CAST(0 AS DECIMAL(10,2)) AS contraction_mrr,
         coalesce(sum(-amount) FILTER (WHERE booked = m.report_month AND kind = 'churn'), 0)
           AS churn_mrr,
         coalesce(sum(amount) FILTER (WHERE booked = m.report_month), 0) AS net_new_mrr,
         coalesce(sum(amount), 0) AS ending_mrr
  FROM o_months m
  LEFT JOIN o_ledger l ON l.booked <= m.report_month
                      AND l.booked >= (SELECT min(report_month) FROM o_months)
  GROUP BY m.report_month""")
# Movement form: previous row = same user, ended when this one started.
cte("o_moves", ("b_subs",), """
  SELECT CAST(date_trunc('month', s.started_at) AS DATE) AS change_month, s.mrr,
         coalesce((SELECT p.mrr FROM b_subs p
                   WHERE p.user_id = s.user_id AND p.ended_at = s.started_at
                   ORDER BY p.started_at DESC, p.subscription_id DESC LIMIT 1),
                  CAST(0 AS DECIMAL(10,2))) AS prev
  FROM b_subs s""")
cte("o_orphan_ends", ("b_subs",), """
  SELECT CAST(date_trunc('month', s.ended_at) AS DATE) AS change_month, s.mrr
  FROM b_subs s
  WHERE s.ended_at IS NOT NULL AND s.mrr > 0
    AND NOT EXISTS (SELECT 1 FROM b_subs n
                    WHERE n.user_id = s.user_id AND n.started_at = s.ended_at)""")
cte("o_mrr_delta", ("o_months", "o_moves", "o_orphan_ends"), """
  SELECT report_month, new_mrr, expansion_mrr, contraction_mrr, churn_mrr,
         new_mrr + expansion_mrr - contraction_mrr - churn_mrr AS net_new_mrr,
         sum(new_mrr + expansion_mrr - contraction_mrr - churn_mrr)
           OVER (ORDER BY report_month) AS ending_mrr
  FROM (
    SELECT m.report_month,
           coalesce((SELECT sum(mrr) FROM o_moves v
                     WHERE v.change_month = m.report_month AND v.prev = 0 AND v.mrr > 0), 0)
             AS new_mrr,
           coalesce((SELECT sum(mrr - prev) FROM o_moves v
                     WHERE v.change_month = m.report_month AND v.prev > 0 AND v.mrr > v.prev), 0)
             AS expansion_mrr,
           coalesce((SELECT sum(prev - mrr) FROM o_moves v
                     WHERE v.change_month = m.report_month AND v.prev > 0 AND v.mrr > 0
                       AND v.mrr < v.prev), 0) AS contraction_mrr,
           coalesce((SELECT sum(prev) FROM o_moves v
                     WHERE v.change_month = m.report_month AND v.prev > 0 AND v.mrr = 0), 0)
           + coalesce((SELECT sum(mrr) FROM o_orphan_ends e
                       WHERE e.change_month = m.report_month), 0) AS churn_mrr
    FROM o_months m) t""")

# ---- retention ----------------------------------------------------------------
cte("o_windows", (), """
  SELECT * FROM (VALUES (1, 1, 8), (7, 7, 14), (14, 14, 21), (30, 30, 37), (60, 60, 67),
                        (90, 90, 97)) w(retention_day, lo, hi)""")
cte("o_retention", ("b_users", "b_events", "o_windows", "o_current_plan"), """
  SELECT u.user_id, CAST(date_trunc('week', u.signed_up_at) AS DATE) AS cohort_week,
         u.region, u.signup_source, coalesce(cp.current_plan, 'free') AS plan_at_latest,
         CAST(w.retention_day AS INTEGER) AS retention_day,
         CAST(CASE WHEN EXISTS (
                SELECT 1 FROM b_events e
                WHERE e.user_id = u.user_id
                  AND epoch_us(e.event_timestamp) - epoch_us(u.signed_up_at)
                      >= CAST(w.lo AS BIGINT) * 86400000000
                  AND epoch_us(e.event_timestamp) - epoch_us(u.signed_up_at)
                      < CAST(w.hi AS BIGINT) * 86400000000) THEN 1 ELSE 0 END AS INTEGER)
           AS is_retained,
         u.signed_up_at + to_days(CAST(w.hi AS INTEGER)) <= TIMESTAMP '2024-01-31 00:00:00'
           AS eligible
  FROM b_users u CROSS JOIN o_windows w
  LEFT JOIN o_current_plan cp ON cp.user_id = u.user_id""")


# ---- facts --------------------------------------------------------------------
cte("o_fct_events", ("stg_events", "b_users"), """
  SELECT e.event_id, e.user_id, e.event_type, e.event_timestamp, e.event_date, e.event_hour,
         e.event_properties, u.region, u.signup_source
  FROM stg_events e LEFT JOIN b_users u ON u.user_id = e.user_id""")
cte("o_fct_subs", ("stg_subs", "b_users"), f"""
  SELECT s.subscription_id, s.user_id, s.plan, s.mrr, s.plan_mrr, s.started_at, s.ended_at,
         s.change_type, s.is_active, u.region, u.signup_source,
         CASE WHEN s.ended_at IS NOT NULL THEN
           {hours('s.started_at', 's.ended_at', 86_400_000_000)} END AS duration_days,
         CAST(date_trunc('month', s.started_at) AS DATE) AS started_month,
         CAST(date_trunc('month', s.ended_at) AS DATE) AS ended_month
  FROM stg_subs s LEFT JOIN b_users u ON u.user_id = s.user_id""")
cte("o_dim_date", ("b_subs",), """
  SELECT d AS date_day, CAST(year(d) AS INTEGER) AS year_number,
         CAST(month(d) AS INTEGER) AS month_number, CAST(day(d) AS INTEGER) AS day_number,
         CAST(dayofweek(d) AS INTEGER) AS day_of_week,
         CAST(weekofyear(d) AS INTEGER) AS week_number,
         CAST(quarter(d) AS INTEGER) AS quarter_number,
         strftime(d, '%Y-%m') AS year_month,
         rpad(dayname(d), 9, ' ') AS day_name, rpad(monthname(d), 9, ' ') AS month_name,
         CAST(date_trunc('week', d) AS DATE) AS week_start_date,
         CAST(date_trunc('month', d) AS DATE) AS month_start_date,
         CAST(date_trunc('quarter', d) AS DATE) AS quarter_start_date,
         dayofweek(d) IN (0, 6) AS is_weekend
  FROM (SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP),
                                           INTERVAL 1 DAY)) AS DATE) AS d
        FROM (SELECT CAST(min(started_at) AS DATE) AS lo, CAST(max(started_at) AS DATE) AS hi
              FROM b_subs) b) t""")
cte("o_dim_plans", (), """
  SELECT * FROM (VALUES
    ('free', CAST(0.00 AS DECIMAL(10,2)), CAST(0.00 AS DECIMAL(10,2)), 5,
     false, false, false, false, false, false, false),
    ('pro', 29.00, 290.00, 50, true, true, true, true, false, false, false),
    ('enterprise', 99.00, 990.00, 10000, true, true, true, true, true, true, true))
    p(plan_name, monthly_price, annual_price, max_users, has_gantt, has_automations,
      has_custom_fields, has_reporting, has_api_access, has_sso, has_guest_access)""")
cte("o_dim_features", (), """
  SELECT * FROM (VALUES ('kanban_board'), ('gantt_chart'), ('time_tracking'),
    ('file_storage'), ('team_chat'), ('automations'), ('custom_fields'), ('reporting'),
    ('api_access'), ('sso_login'), ('guest_access'), ('templates'), ('calendar_view'),
    ('dependencies'), ('workload_view')) f(feature_name)""")


# ---- data jobs ------------------------------------------------------------------
cte("o_lift_users", ("b_users", "b_events", "b_subs"), """
  SELECT u.user_id,
         u.user_id IN (SELECT e.user_id FROM b_events e JOIN b_users x ON x.user_id = e.user_id
                       WHERE e.event_type = 'member_invited'
                         AND epoch_us(e.event_timestamp) - epoch_us(x.signed_up_at)
                             <= 7 * 86400000000
                       GROUP BY e.user_id HAVING count(*) >= 2) AS a,
         u.user_id IN (SELECT user_id FROM b_subs WHERE plan IN ('pro', 'enterprise')) AS p
  FROM b_users u""")
cte("o_lift_totals", ("o_lift_users",), """
  SELECT count(*) FILTER (WHERE a) AS ta, count(*) FILTER (WHERE a AND p) AS pa,
         count(*) FILTER (WHERE NOT a) AS tn, count(*) FILTER (WHERE NOT a AND p) AS pn
  FROM o_lift_users""")

# ---- incremental (first load before 2024-01-16, then all events offered) ----------
cte("o_inc_initial", ("o_fct_events",), """
  SELECT * FROM o_fct_events WHERE event_timestamp < TIMESTAMP '2024-01-16 00:00:00'""")
cte("o_inc_strict", ("o_fct_events", "o_inc_initial"), """
  SELECT * FROM o_fct_events
  WHERE event_timestamp > (SELECT max(event_timestamp) FROM o_inc_initial)""")
cte("o_inc_lookback", ("o_fct_events", "o_inc_initial"), """
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY event_id
                                 ORDER BY event_timestamp DESC, event_properties DESC) AS rn
    FROM o_fct_events
    WHERE event_timestamp > (SELECT max(event_timestamp) FROM o_inc_initial) - INTERVAL 3 DAY
  ) o WHERE rn = 1""")

# ---- rows that break a data test ---------------------------------------------------
BROKEN = {
    "milestones": """
  SELECT user_id, signed_up_at, created_first_board_at, invited_first_member_at,
         active_in_week_2_at, upgraded_to_paid_at
  FROM o_snapshot
  WHERE least(created_first_board_at, invited_first_member_at, active_in_week_2_at,
              upgraded_to_paid_at) < signed_up_at""",
    "reconciliation": """
  SELECT a.report_month, CAST(a.ending_mrr AS DOUBLE) AS ending_mrr,
         CAST(sum(b.net_new_mrr) AS DOUBLE) AS expected_ending_mrr,
         CAST(abs(a.ending_mrr - sum(b.net_new_mrr)) AS DOUBLE) AS difference
  FROM o_mrr a JOIN o_mrr b ON b.report_month <= a.report_month
  GROUP BY a.report_month, a.ending_mrr
  HAVING abs(a.ending_mrr - sum(b.net_new_mrr)) > 0.01""",
    "early_events": """
  SELECT event_id, user_id, event_timestamp, signed_up_at FROM o_aged WHERE age_us < 0""",
    "boolean": """
  SELECT user_id, retention_day, is_retained FROM o_retention
  WHERE is_retained * (1 - is_retained) <> 0""",
}
