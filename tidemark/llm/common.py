"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def python_tasks(spark: SparkSession, batch_rows: int = 250) -> None:
    """Prepare a session for operators whose tasks run Python: executors get
    this package, and Arrow batches hold at most ``batch_rows`` rows (documents
    can be long, and a task holds one batch of texts at a time)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="tidemark-py-"), "tidemark.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(package):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared checkpoint folder and read back: cuts the
    lineage, and survives the loss of any executor."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame) -> Column:
    """The whole row as one struct, so that no column of it can clash with
    the names an operator uses."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def unpacked(row: str, docs: DataFrame) -> list[Column]:
    """The columns of ``docs`` out of the struct made by :func:`packed`."""
    return [F.col(row).getField(c).alias(c) for c in docs.columns]


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null id: null)."""
    return F.crc32(doc_id.cast("string")) % F.lit(modulus)


def is_fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether a row belongs to the held-out fold; rows without id never do."""
    return F.coalesce(fold(doc_id, modulus) == F.lit(remainder), F.lit(False))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column,
                    rows_per_class: int, max_chars: int) -> list[tuple[str, int]]:
    """(text, label) of a bounded sample of labelled learning rows.

    Per class the ``rows_per_class`` ids with the smallest hash are taken (a
    top-k, so no sort of the whole table), then their texts.  Texts of more
    than ``max_chars`` characters are passed over; the driver so never holds
    more than 4 * rows_per_class * max_chars characters.
    """
    labels = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("_y")) \
        .where(learn & F.col("_y").isin(0, 1) & F.col("doc_id").isNotNull()) \
        .groupBy("doc_id").agg(F.max("_y").alias("_y"))
    fitting = docs.select("doc_id", "text") \
        .where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    # more ids than needed, since ids of long or missing texts drop out
    picked = None
    for y in (0, 1):
        one = (labels.where(F.col("_y") == y)
               .orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * rows_per_class))
        picked = one if picked is None else picked.unionByName(one)
    found = (fitting.join(F.broadcast(picked), "doc_id")     # at most 4 * rows_per_class ids
             .groupBy("doc_id", "_y").agg(F.min("text").alias("text"))
             .select("_y", F.xxhash64("doc_id").alias("_h"), "doc_id", "text").collect())
    out: list[tuple[str, int]] = []
    for y in (0, 1):
        out += [(r[3], y) for r in sorted(r for r in found if r[0] == y)[:rows_per_class]]
    return out
