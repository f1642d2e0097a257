"""Build every model as a table, then serve reports from the tables.

``build_models`` is the full-refresh run of the model graph: marts are
written (Parquet, one commit per table) under a folder of the shared file
system and read back, so every later model and report starts from files
rather than from lineage.  Events are read twice in all: once for the
per-user activity table (funnel milestones, activation counts, retention
flags) and once for the event fact.  The event fact is loaded incrementally when its
table already exists.  ``dashboard`` returns every report over the built
tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import incremental as I
from tidemark.operators import marts as M
from tidemark.operators import retention as RT
from tidemark.operators import revenue as RV
from tidemark.operators.engagement import ActivationSpec, FunnelSpec, event_rollup
from tidemark.plans import reports as R
from tidemark.sources.literals import dim_features, dim_plans
from tidemark.sources.sinks import sink_table
from tidemark.sources.tables import Tables


@dataclass(frozen=True)
class BuildParams:
    as_of: str
    first_month: str = RV.DEFAULT_FIRST_MONTH
    last_month: str = RV.DEFAULT_LAST_MONTH
    date_start: str | None = None          # None: span of the data
    date_end: str | None = None
    funnel: FunnelSpec = FunnelSpec()
    activation: ActivationSpec = ActivationSpec()
    incremental_mode: str = "strict"


def build_models(spark: SparkSession, tables: Tables, out_dir: str,
                 params: BuildParams) -> dict[str, DataFrame]:
    out = out_dir.rstrip("/")
    users, events, subs = tables.users, tables.user_events, tables.subscriptions
    built: dict[str, DataFrame] = {}
    # every per-user figure events give, in one pass over events; the user
    # models below read this table instead of scanning events again
    built["user_activity"] = sink_table(
        event_rollup(users, events, params.funnel, params.activation), f"{out}/user_activity")
    built["dim_users"] = sink_table(
        M.dim_users(users, events, subs, params.funnel, params.activation,
                    rollup=built["user_activity"]), f"{out}/dim_users")
    # the snapshot is a projection of the written dim_users: no second pass
    built["funnel_snapshot"] = sink_table(M.snapshot_from(built["dim_users"]),
                                          f"{out}/funnel_snapshot")
    built["fct_user_events"] = I.load_events(spark, f"{out}/fct_user_events", users, events,
                                             params.incremental_mode)
    built["fct_subscriptions"] = sink_table(M.fct_subscriptions(users, subs),
                                            f"{out}/fct_subscriptions")
    built["retention_flags"] = sink_table(
        RT.retention_flags(users, events, subs, rollup=built["user_activity"]),
        f"{out}/retention_flags")
    built["mrr_waterfall"] = sink_table(
        RV.mrr_waterfall(subs, params.first_month, params.last_month), f"{out}/mrr_waterfall")
    if params.date_start and params.date_end:
        dates = M.dim_date(spark, params.date_start, params.date_end)
    else:
        span = built["fct_user_events"].agg(F.min("event_date").alias("lo"),
                                            F.max("event_date").alias("hi"))
        dates = M.dim_date(spark, F.col("lo"), F.col("hi"), bounds=span)
    built["dim_date"] = sink_table(dates, f"{out}/dim_date")
    built["dim_plans"] = sink_table(dim_plans(spark), f"{out}/dim_plans")
    built["dim_features"] = sink_table(dim_features(spark), f"{out}/dim_features")
    return built


def dashboard(models: dict[str, DataFrame], as_of, f: R.Filters = R.ALL) -> dict[str, DataFrame]:
    """Every dashboard query over built models (lazy; nothing runs here)."""
    dim, snap = models["dim_users"], models["funnel_snapshot"]
    flags, wf = models["retention_flags"], models["mrr_waterfall"]
    by_cohort = R.retention_by_cohort(flags, f)
    return {
        "kpi_total_users": R.kpi_total_users(dim, f),
        "kpi_activation_rate": R.kpi_activation_rate(snap, f),
        "kpi_dau_wau_mau": R.kpi_dau_wau_mau(models["fct_user_events"], as_of),
        "kpi_current_mrr": R.kpi_current_mrr(wf),
        "weekly_signups": R.weekly_signups(dim, f),
        "activation_by_source": R.activation_by_source(dim, f),
        "funnel_counts": R.funnel_counts(snap, f),
        "funnel_by_region": R.funnel_by_region(snap, f),
        "conversion_by_activation": R.conversion_by_activation(snap, f),
        "retention_by_cohort": by_cohort,
        "retention_heatmap": R.retention_heatmap(by_cohort),
        "retention_by_region": R.retention_by_region(flags, f),
        "retention_by_source": R.retention_by_source(flags, f),
        "retention_summary": R.retention_summary(flags, f),
        "mrr_series": R.mrr_series(wf),
        "revenue_by_region": R.revenue_by_region(dim),
        "plan_distribution": R.plan_distribution(dim),
    }
