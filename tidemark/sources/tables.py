"""The six raw inputs, read once and handed to operators as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.contracts import CONTRACTS, cast_to_contract

RAW_TABLES = ("users", "user_events", "subscriptions", "feature_usage", "invoices",
              "conversations")


def read_table(spark: SparkSession, path: str, contract: str | None = None,
               fmt: str = "parquet") -> DataFrame:
    """Scan a raw table.  With a contract the scan uses its schema (no
    inference) and the result is cast to it; Parquet pushdown and column
    pruning still apply because the projection is a plain select."""
    reader = spark.read.format(fmt)
    if contract is not None and fmt != "parquet":
        reader = reader.schema(CONTRACTS[contract])
    df = reader.load(path)
    return cast_to_contract(df, contract) if contract is not None else df


@dataclass(frozen=True)
class Tables:
    """Holder of the raw inputs (any may be None if a report does not need it)."""

    users: DataFrame
    user_events: DataFrame
    subscriptions: DataFrame
    feature_usage: DataFrame | None = None
    invoices: DataFrame | None = None
    conversations: DataFrame | None = None

    @classmethod
    def from_paths(cls, spark: SparkSession, paths: dict[str, str],
                   fmt: str = "parquet", contracts: bool = True) -> "Tables":
        frames = {name: read_table(spark, p, name if contracts else None, fmt)
                  for name, p in paths.items()}
        return cls(**frames)

    def with_(self, **frames) -> "Tables":
        return replace(self, **frames)
