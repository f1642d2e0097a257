"""Bucketed previous/next equals the plain window, hot key included."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators.neighbors import bucketed_neighbors, with_neighbors


def test_bucketed_equals_window(spark):
    base = spark.range(0, 5000).select(
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 50).alias("k"),
        (F.lit("2024-01-01").cast("timestamp_ntz")
         + F.make_dt_interval(secs=(F.col("id") * 7919) % (86400 * 40))).alias("t"),
        F.col("id").alias("i"), (F.col("id") % 97).alias("v"))
    # ties in t broken by i; empty days between rows of a key
    w = Window.partitionBy("k").orderBy("t", "i")
    want = sorted(tuple(r) for r in base.select(
        "k", "t", "i", "v", F.lag("v").over(w).alias("prev_v"),
        F.lead("t").over(w).alias("next_t")).collect())
    got = bucketed_neighbors(base, "k", ["t", "i"], F.to_date("t"), ["v"], ["t"])
    assert sorted(tuple(r) for r in got.select("k", "t", "i", "v", "prev_v", "next_t")
                  .collect()) == want
    plain = with_neighbors(base, "k", ["t", "i"], F.to_date("t"), ["v"], ["t"])
    assert sorted(tuple(r) for r in plain.select("k", "t", "i", "v", "prev_v", "next_t")
                  .collect()) == want
    small_bound = with_neighbors(base, "k", ["t", "i"], F.to_date("t"), ["v"], ["t"],
                                 max_group_rows=10)
    assert sorted(tuple(r) for r in small_bound.select("k", "t", "i", "v", "prev_v",
                                                       "next_t").collect()) == want
