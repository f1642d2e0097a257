"""Connected components of a link table, as rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialize


def connected_components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """``links(a, b)`` -> ``(node, component)``; a component is its smallest node.

    Alternating large-star and small-star steps: every step relinks nodes to
    the smallest neighbour, the number of rounds grows with the logarithm of
    the longest path, and a node with very many links is a skewed join key
    that adaptive execution splits.  Each round is written to the shared
    checkpoint folder; only a one-row digest reaches the driver.  Nodes
    without links, self links and null ends give no rows.
    """
    links = links.select("a", "b").where(F.col("a") != F.col("b"))
    edges = materialize(spark, _larger_first(links).distinct(), "links")
    before = None
    while True:
        digest = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).head()
        if digest[0] == 0 or digest == before:
            break
        before = digest
        edges = materialize(spark, _small_star(_large_star(edges)), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select("b", "b").distinct())


def _larger_first(e: DataFrame) -> DataFrame:
    return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _large_star(e: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour."""
    both = e.union(e.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")) \
        .select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return (both.where(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("u"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where(F.col("a") != F.col("b")).distinct())


def _small_star(e: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = e.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
    moved = e.join(least, F.col("a") == F.col("u")).select("b", "m")
    return (moved.where(F.col("b") != F.col("m")).toDF("a", "b")
            .union(least.select("u", "m")).distinct())
