"""Registered queries: key -> (Spark builder, DuckDB oracle SQL).

Every builder reads the driver's tables through the fixture binding, so its
work grows with them.  Decimals leave as doubles (summed as decimals first).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import apply_defaults

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(key: str, oracle_sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_defaults(spark)
            return decimals_to_double(fn(spark, sf_dir))
        run.__name__ = key
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if oracle_sql is not None:
            ORACLE[key] = oracle_sql
        return fn
    return deco


def decimals_to_double(df: DataFrame) -> DataFrame:
    if not any(isinstance(f.dataType, T.DecimalType) for f in df.schema.fields):
        return df
    return df.select(*[F.col(f.name).cast("double").alias(f.name)
                       if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
                       for f in df.schema.fields])


# Importing the query modules fills the registry.
from tidemark.plans import (  # noqa: E402,F401
    queries_changes, queries_core, queries_more, queries_revenue, queries_stream,
)
from tidemark.plans import queries_filtered  # noqa: E402,F401  (reads the oracles above)
