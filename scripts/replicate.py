"""Replicate the given tables k times (ids offset per copy) into a folder, for
scale experiments with the same shapes as the driver data.

usage: python scripts/replicate.py SRC_DIR DST_DIR K [FILES]
nation and region are copied as they are; customer, orders and events get
k copies with keys shifted by copy * (max key + 1).
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    src, dst, k = sys.argv[1], sys.argv[2], int(sys.argv[3])
    files = int(sys.argv[4]) if len(sys.argv) > 4 else 16
    from pyspark.sql import functions as F

    from tidemark.session import build_session
    from tidemark.sources.bindings import read_driver_table

    spark = build_session("local[8]", 8)
    keys = {"customer": ["c_custkey"], "orders": ["o_orderkey", "o_custkey"],
            "events": ["event_id", "user_id"]}
    span = {}
    for t in ("customer", "orders", "events"):
        df = read_driver_table(spark, src, t)
        for c in keys[t]:
            span[c] = df.agg(F.max(c)).first()[0] + 1
    span["o_custkey"] = span["user_id"] = span["c_custkey"]
    for t in ("nation", "region"):
        read_driver_table(spark, src, t).write.mode("overwrite").parquet(f"{dst}/{t}.parquet")
    for t, cols in keys.items():
        df = read_driver_table(spark, src, t)
        rep = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("copy"))
        for c in cols:
            rep = rep.withColumn(c, F.col(c) + F.col("copy") * F.lit(span[c]))
        # several files, as a large table has (a single file is one scan task)
        rep.drop("copy").repartition(files).write.mode("overwrite") \
            .parquet(f"{dst}/{t}.parquet")
    spark.stop()


if __name__ == "__main__":
    main()
