"""Keyed upsert of micro-batches into a Parquet table.

The table is partitioned by a hash bucket of the key; a micro-batch rewrites
only the buckets it touches (dynamic partition overwrite), from a checkpoint
of their new content, so a retried batch is idempotent and never reads the
files it overwrites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.sinks import table_exists

BUCKET = "_bucket"


def with_bucket(df: DataFrame, keys, n_buckets: int) -> DataFrame:
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(n_buckets)).cast("int"))


def upsert_by_key(batch: DataFrame, path: str, keys, n_buckets: int = 64) -> None:
    """Rows of ``batch`` replace the rows with the same key (last write wins)."""
    spark = batch.sparkSession
    keys = list(keys)
    b = with_bucket(batch, keys, n_buckets).checkpoint(eager=True)
    if not table_exists(spark, path):
        b.write.mode("overwrite").partitionBy(BUCKET).parquet(path)
        return
    old = spark.read.parquet(path)
    touched = b.select(BUCKET).distinct()
    kept = (old.join(touched, BUCKET, "left_semi")
            .join(b.select(*keys), keys, "left_anti"))
    new = kept.unionByName(b).checkpoint(eager=True)
    (new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(BUCKET).parquet(path))


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)
