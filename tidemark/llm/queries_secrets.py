"""Query op5."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.secrets import KINDS, find_secrets, spelled


def op5_secret_scan(spark, sf_dir):
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter(
        "base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in KINDS[:3]], F.size("added").cast("long").alias("n_entropy"),
        F.sha2(spelled(F.col("base")), 256).alias("base_sha256"),
        spelled(F.array_sort(F.concat("base", "added"))).alias("spans"))


QUERIES = {f.__name__: f for f in (op5_secret_scan,)}
ORACLE: dict[str, str] = {}
