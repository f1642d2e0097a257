"""Sinks: views, full-refresh tables, and where scratch tables live."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tidemark.session import scratch_path
from tidemark.sources.versioned import VersionedTable


def sink_view(df: DataFrame, name: str) -> DataFrame:
    """A lazy view: nothing is computed; readers re-plan it."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def sink_table(df: DataFrame, path: str, partition_by: str | None = None) -> DataFrame:
    """Full refresh: writes the table anew beside the old one and switches to
    it, then reads it back, so downstream work starts from the files, not the
    lineage.  A job that fails before the switch leaves the old table.  The
    folders of versions before the last two are deleted."""
    table = VersionedTable(df.sparkSession, path)
    table.exists()                       # never writes into a folder of something else
    out = table.replace(df, column=partition_by)
    table.vacuum()
    return out


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table written by :func:`sink_table`."""
    return VersionedTable(spark, path).read()


def scratch_table_path(spark: SparkSession, name: str) -> str:
    """A fresh location in the shared checkpoint folder."""
    return scratch_path(spark, name)


def table_exists(spark: SparkSession, path: str) -> bool:
    """False only if there is nothing at ``path``; any other error (storage,
    damaged files) is raised, so that a table is never taken for missing and
    overwritten."""
    try:
        spark.read.parquet(path).schema
        return True
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
