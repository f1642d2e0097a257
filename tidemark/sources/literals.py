"""Literal relations: the plan and feature catalogues."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Plan catalogue.
PLANS = (
    ("free", "0.00", "0.00", 5, False, False, False, False, False, False, False),
    ("pro", "29.00", "290.00", 50, True, True, True, True, False, False, False),
    ("enterprise", "99.00", "990.00", 10000, True, True, True, True, True, True, True),
)
PLAN_SCHEMA = T.StructType(
    [T.StructField("plan_name", T.StringType()),
     T.StructField("monthly_price", T.DecimalType(10, 2)),
     T.StructField("annual_price", T.DecimalType(10, 2)),
     T.StructField("max_users", T.IntegerType())]
    + [T.StructField(n, T.BooleanType()) for n in
       ("has_gantt", "has_automations", "has_custom_fields", "has_reporting",
        "has_api_access", "has_sso", "has_guest_access")])

# Feature taxonomy (name, category, minimum plan).
FEATURES = (
    ("kanban_board", "core", "free"),
    ("gantt_chart", "project_mgmt", "pro"),
    ("time_tracking", "productivity", "free"),
    ("file_storage", "collaboration", "free"),
    ("team_chat", "collaboration", "free"),
    ("automations", "workflow", "pro"),
    ("custom_fields", "customization", "pro"),
    ("reporting", "analytics", "pro"),
    ("api_access", "integrations", "enterprise"),
    ("sso_login", "security", "enterprise"),
    ("guest_access", "collaboration", "enterprise"),
    ("templates", "productivity", "free"),
    ("calendar_view", "project_mgmt", "free"),
    ("dependencies", "project_mgmt", "free"),
    ("workload_view", "project_mgmt", "pro"),
)
FEATURE_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in
                               ("feature_name", "feature_category", "min_plan_required")])


def dim_plans(spark: SparkSession) -> DataFrame:
    rows = [(p[0], Decimal(p[1]), Decimal(p[2]), *p[3:]) for p in PLANS]
    return spark.createDataFrame(rows, PLAN_SCHEMA)


def dim_features(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FEATURES), FEATURE_SCHEMA)
