"""CSV seeds: small headed CSV files loaded with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def scan_csv_seed(spark: SparkSession, path: str, schema: T.StructType,
                  timestamp_format: str | None = None) -> DataFrame:
    """Read a seed: header row, explicit schema (no inference), and FAILFAST,
    so a malformed row fails the load instead of becoming NULLs.  Booleans
    accept True/False in any case; quoted fields may contain commas."""
    reader = (spark.read.option("header", True).option("mode", "FAILFAST")
              .option("quote", '"').option("escape", '"').schema(schema))
    if timestamp_format:
        reader = reader.option("timestampNTZFormat", timestamp_format)
    return reader.csv(path)


def write_csv_seed(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).option("quote", '"') \
        .option("escape", '"').csv(path)
    return path
