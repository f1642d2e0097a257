"""Benchmark decontamination by size-partitioned MinHash containment search.

Finds test items inside documents.  Items are sets of word n-grams (five
words, lower case).  They are partitioned by size; for every item each of the
MinHash functions of its size class names one shingle, the one with the
smallest value.  The chance that a document holds that shingle is the share of
the item it contains, however long the document is: equal minima of ``k``
functions estimate containment, and an item of which a share of ``threshold``
is in the document goes unseen with probability (1 - threshold) ** k at most
(larger classes use more functions).  Documents with fewer shingles than the
smallest item of a class could need are not compared with that class.
Candidates are verified exactly on all shingles.

DataFrame functions only.  Documents are streamed once past the table of
minima, which is broadcast after a check of its size and joined by shuffle
beyond it; texts are read again only for candidate documents.  A third of all
rows holding the same item is a partial aggregate per task.

Defined results: null texts and texts of fewer than five words have no
shingles, and so do items: they never match.  Rows that share a ``doc_id``
(or have none) are one document in ``contaminated``, the union of their
shingles; repeated items of one id likewise.  ``drop_contaminated`` judges each
row by its own text.  Other columns are ignored.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, packed, unpacked

BROADCAST_ROWS = 500_000          # rows of two or three longs: some 20 MB


def shingle_hashes(text: Column, n: int) -> Column:
    """array<bigint>: a hash of each run of n words, in order."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    cut = lambda w: F.transform(
        F.sequence(F.lit(1), F.size(w) - (n - 1)),
        lambda i: F.xxhash64(*[F.element_at(w, i + j) for j in range(n)]))
    return F.transform(F.array(words), lambda w: F.when(F.size(w) >= n, cut(w)))[0]


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a table of at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def item_shingles(benchmark: DataFrame, n: int) -> DataFrame:
    """item_id, h, n_item: the distinct shingles of each item and their number."""
    cut = (benchmark.select("item_id", F.explode(shingle_hashes(F.col("text"), n)).alias("h"))
           .where(F.col("item_id").isNotNull()).distinct())
    size = cut.groupBy("item_id").agg(F.count("*").alias("n_item"))
    return cut.join(size, "item_id")


def minima(items: DataFrame, threshold: float, miss: float) -> DataFrame:
    """h, item_id, cls, least: the shingles named by the MinHash functions of
    each item, and the fewest shingles a document needs for the item's class.

    Class c holds items of 2**c to 2**(c+1)-1 shingles and has enough functions
    for a miss of at most ``miss``, and 2 more per class.
    """
    base = ceil(log(miss) / log(1 - threshold))
    cls = F.floor(F.log2("n_item")).cast("int")
    per = (items.withColumn("cls", cls)
           .withColumn("f", F.explode(F.sequence(F.lit(1), F.lit(base) + 2 * F.col("cls"))))
           .groupBy("item_id", "cls", "f")
           .agg(F.min_by("h", F.xxhash64("h", "f")).alias("h")))
    least = F.ceil(F.pow(F.lit(2.0), F.col("cls")) * threshold - F.lit(1e-9))
    return per.select("h", "item_id", "cls", least.cast("int").alias("least")).distinct()


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, n: int = 5,
                 threshold: float = 0.8, miss: float = 1e-7) -> DataFrame:
    """``doc_id, item_id, n_item, n_shared, containment`` of all pairs in which
    the document holds at least ``threshold`` of the item's shingles."""
    items = materialize(spark, item_shingles(benchmark, n), "items")
    named = materialize(spark, minima(items, threshold, miss), "minima")
    n_items, n_named = items.count(), named.count()

    docs = docs.select("doc_id", "text")
    hashes = docs.select("doc_id", shingle_hashes(F.col("text"), n).alias("hs"))
    seen = hashes.select("doc_id", F.size("hs").alias("n_doc"), F.explode("hs").alias("h"))
    cand = (seen.join(_sized(named, n_named), "h")
            .groupBy("doc_id", "item_id", "least").agg(F.sum("n_doc").alias("n_doc"))
            # summed over equal minima (and rows of one id): never too small
            .where(F.col("n_doc") >= F.col("least")).select("doc_id", "item_id"))
    cand = materialize(spark, cand, "candidates")

    ids = cand.select(F.col("doc_id").alias("_id")).distinct()
    again = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    held = again.select("doc_id", F.explode(shingle_hashes(F.col("text"), n)).alias("h"))
    shared = (held.join(_sized(items, n_items), "h").select("doc_id", "item_id", "n_item", "h")
              .distinct().groupBy("doc_id", "item_id", "n_item")
              .agg(F.count("*").alias("n_shared"))
              .where(F.col("n_shared") >= threshold * F.col("n_item") - 1e-9))
    pairs = cand.select(F.col("doc_id").alias("_id"), F.col("item_id").alias("_item"))
    return (shared.join(pairs, F.col("doc_id").eqNullSafe(F.col("_id"))
                        & (F.col("item_id") == F.col("_item")), "left_semi")
            .withColumn("containment", F.col("n_shared") / F.col("n_item")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame,
                      **options) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item.

    Rows are judged one by one, by id and text: those that share an id or have
    none do not share what they hold.
    """
    key = F.unhex(F.md5(F.concat_ws("\n", F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                                    F.coalesce("text", F.lit("")))))
    bad = (contaminated(spark, docs.select(key.alias("doc_id"), "text"), benchmark, **options)
           .select(F.col("doc_id").alias("key")).distinct())
    return (docs.select(key.alias("key"), packed(docs).alias("row"))
            .join(bad, "key", "left_anti").select(*unpacked("row", docs)))
