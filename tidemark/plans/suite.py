"""The full data-test suite: 51 column tests and 4 singular tests.

One declaration per test; ``spark_suite`` turns it into DataFrames and
``suite_sql`` into the SQL oracle.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import quality as Q
from tidemark.operators.quality import Check
from tidemark.plans.oracle import BROKEN, sql

# The accepted value lists of the tests.
EVENT_TYPES = ("board_created", "member_invited", "task_created", "task_completed",
               "comment_added", "file_uploaded", "settings_changed")
PLANS = ("free", "pro", "enterprise")
REGIONS = ("US", "UK", "AU")


def _col_tests(table: str, column: str, *kinds, values=(), parent=None) -> list[Check]:
    out = []
    for kind in kinds:
        name = f"{kind}_{table}_{column}"
        if kind == "relationships":
            out.append(Check(name, table, kind, column, parent=parent, parent_column="user_id"))
        else:
            out.append(Check(name, table, kind, column, values=values))
    return out


GENERIC: list[Check] = [
    *_col_tests("users", "user_id", "unique", "not_null"),
    *_col_tests("users", "email", "unique", "not_null"),
    *_col_tests("users", "signed_up_at", "not_null"),
    *_col_tests("user_events", "event_id", "unique", "not_null"),
    *_col_tests("user_events", "user_id", "not_null"),
    *_col_tests("user_events", "event_type", "not_null"),
    *_col_tests("user_events", "event_type", "accepted_values", values=EVENT_TYPES),
    *_col_tests("user_events", "event_timestamp", "not_null"),
    *_col_tests("feature_usage", "usage_id", "unique", "not_null"),
    *_col_tests("feature_usage", "user_id", "not_null"),
    *_col_tests("retention_flags", "user_id", "not_null"),
    *_col_tests("retention_flags", "retention_day", "not_null"),
    *_col_tests("subscriptions", "subscription_id", "unique", "not_null"),
    *_col_tests("subscriptions", "user_id", "not_null"),
    *_col_tests("subscriptions", "plan", "not_null"),
    *_col_tests("subscriptions", "plan", "accepted_values", values=PLANS),
    *_col_tests("subscriptions", "started_at", "not_null"),
    *_col_tests("invoices", "invoice_id", "unique", "not_null"),
    *_col_tests("invoices", "subscription_id", "not_null"),
    *_col_tests("conversations", "conversation_id", "unique", "not_null"),
    *_col_tests("conversations", "user_id", "not_null"),
    *_col_tests("dim_users", "user_id", "unique", "not_null"),
    *_col_tests("dim_users", "region", "not_null"),
    *_col_tests("dim_users", "region", "accepted_values", values=REGIONS),
    *_col_tests("dim_users", "current_plan", "accepted_values", values=PLANS),
    *_col_tests("dim_plans", "plan_name", "unique", "not_null"),
    *_col_tests("dim_date", "date_day", "unique", "not_null"),
    *_col_tests("dim_features", "feature_name", "unique", "not_null"),
    *_col_tests("fct_user_events", "event_id", "unique", "not_null"),
    *_col_tests("fct_user_events", "user_id", "not_null"),
    *_col_tests("fct_user_events", "user_id", "relationships", parent="dim_users"),
    *_col_tests("fct_user_events", "event_type", "not_null"),
    *_col_tests("fct_subscriptions", "subscription_id", "unique", "not_null"),
    *_col_tests("fct_subscriptions", "user_id", "not_null"),
    *_col_tests("fct_subscriptions", "user_id", "relationships", parent="dim_users"),
    *_col_tests("funnel_snapshot", "user_id", "unique", "not_null"),
    *_col_tests("funnel_snapshot", "user_id", "relationships", parent="dim_users"),
]

SINGULAR = ("assert_funnel_milestones_chronological", "assert_mrr_reconciliation",
            "assert_no_events_before_signup", "assert_retention_flags_boolean")


def spark_suite(frames: dict[str, DataFrame]) -> DataFrame:
    """``frames`` holds every table named in GENERIC plus ``mrr_waterfall``;
    derived models are expected as written tables (they are read several times)."""
    # checks on a table that was not supplied (None) are skipped
    checks = [c for c in GENERIC if frames.get(c.table) is not None
              and (c.parent is None or frames.get(c.parent) is not None)]
    counted = Q.count_checks(checks, frames)
    results = [
        (SINGULAR[0], Q.milestones_after_signup(frames["funnel_snapshot"])),
        (SINGULAR[1], Q.mrr_reconciliation(frames["mrr_waterfall"])),
        (SINGULAR[2], Q.events_before_signup(frames["fct_user_events"], frames["dim_users"])),
        (SINGULAR[3], Q.retention_boolean(frames["retention_flags"])),
    ]
    return Q.run_suite(results, counted, [c.name for c in checks])


def _sql_count(c: Check, names: dict[str, str]) -> str:
    t, col = names[c.table], c.column
    if c.kind == "not_null":
        return f"SELECT count(*) FROM {t} WHERE {col} IS NULL"
    if c.kind == "unique":
        return (f"SELECT count(*) FROM (SELECT {col} FROM {t} WHERE {col} IS NOT NULL "
                f"GROUP BY {col} HAVING count(*) > 1) x")
    if c.kind == "accepted_values":
        vals = ", ".join(f"'{v}'" for v in c.values)
        return (f"SELECT count(*) FROM (SELECT DISTINCT {col} FROM {t} "
                f"WHERE {col} IS NOT NULL AND {col} NOT IN ({vals})) x")
    if c.kind == "relationships":
        p = names[c.parent]
        return (f"SELECT count(*) FROM {t} c WHERE c.{col} IS NOT NULL AND NOT EXISTS "
                f"(SELECT 1 FROM {p} p WHERE p.{c.parent_column} = c.{col})")
    raise ValueError(c.kind)


SINGULAR_SQL = {name: f"SELECT count(*) FROM ({BROKEN[rows]}) x" for name, rows in zip(
    SINGULAR, ("milestones", "reconciliation", "early_events", "boolean"))}

SQL_NAMES = {"users": "b_users", "user_events": "b_events", "feature_usage": "b_usage",
             "retention_flags": "o_retention", "subscriptions": "b_subs",
             "invoices": "b_invoices", "conversations": "b_tickets",
             "dim_users": "o_dim_users", "dim_plans": "o_dim_plans", "dim_date": "o_dim_date",
             "dim_features": "o_dim_features", "fct_user_events": "o_fct_events",
             "fct_subscriptions": "o_fct_subs", "funnel_snapshot": "o_snapshot"}


def suite_sql() -> str:
    parts = [f"SELECT '{c.name}' AS test_name, CAST(({_sql_count(c, SQL_NAMES)}) AS BIGINT)"
             " AS violations" for c in GENERIC]
    parts += [f"SELECT '{n}', CAST(({q}) AS BIGINT)" for n, q in SINGULAR_SQL.items()]
    body = ("SELECT test_name, violations, violations = 0 AS passed FROM (\n"
            + "\nUNION ALL ".join(parts) + "\n) t")
    return sql(body, *SQL_NAMES.values(), "o_mrr", "o_aged")


def built_frames(tables, models: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The suite's inputs from raw tables and ``plans.build.build_models``
    output: every check on a model becomes a scan of its written table."""
    frames = {"users": tables.users, "user_events": tables.user_events,
              "subscriptions": tables.subscriptions, "feature_usage": tables.feature_usage,
              "invoices": tables.invoices, "conversations": tables.conversations}
    frames.update({k: models[k] for k in
                   ("retention_flags", "dim_users", "dim_plans", "dim_features", "dim_date",
                    "fct_user_events", "fct_subscriptions", "funnel_snapshot",
                    "mrr_waterfall")})
    return frames


def driver_frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    from pyspark.sql import functions as F

    from tidemark.operators import marts as M
    from tidemark.operators import retention as RT
    from tidemark.operators import revenue as RV
    from tidemark.sources import bindings as B
    from tidemark.sources import literals as L
    from tidemark.sources.sinks import scratch_table_path

    def written(df: DataFrame, name: str) -> DataFrame:
        path = scratch_table_path(spark, f"suite_{name}")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    users, events, subs = (B.users(spark, sf_dir), B.user_events(spark, sf_dir),
                           B.subscriptions(spark, sf_dir))
    # models that several tests read are written once to the shared folder, as a
    # warehouse tests the tables it built; facts keep the columns under test.
    # The writes do not depend on each other and run side by side
    models = {
        "dim_users": M.dim_users(users, events, subs),
        "fct_user_events": M.fct_user_events(users, events).select(
            "event_id", "user_id", "event_type", "event_timestamp"),
        "fct_subscriptions": M.fct_subscriptions(users, subs).select(
            "subscription_id", "user_id")}
    with ThreadPoolExecutor(len(models)) as pool:
        built = dict(zip(models, pool.map(lambda m: written(models[m], m), models)))
    dim = built["dim_users"]
    span = subs.agg(F.min(F.to_date("started_at")).alias("lo"),
                    F.max(F.to_date("started_at")).alias("hi"))
    return {
        "users": users, "user_events": events, "subscriptions": subs,
        "feature_usage": B.feature_usage(spark, sf_dir),
        "invoices": B.invoices(spark, sf_dir), "conversations": B.conversations(spark, sf_dir),
        "retention_flags": RT.retention_flags(users, events, subs),
        "dim_users": dim,
        "dim_plans": L.dim_plans(spark), "dim_features": L.dim_features(spark),
        "dim_date": M.dim_date(spark, F.col("lo"), F.col("hi"), bounds=span),
        "fct_user_events": built["fct_user_events"],
        "fct_subscriptions": built["fct_subscriptions"],
        "funnel_snapshot": M.snapshot_from(dim),
        "mrr_waterfall": RV.mrr_waterfall(subs, B.MRR_FIRST_MONTH, B.MRR_LAST_MONTH),
    }
