"""Importance resampling towards a target distribution, by bit-sliced sums.

Features are runs of 1 to 3 words, hashed into 10,000 buckets.  Counts of the
target's and of the corpus' features per bucket give each bucket an integer
gain.  A document's weight is the sum of the gains of its features: its bucket
counts become 10,000-bit planes (plane j holds bit j of every count), the gains
are planes in two's complement, and the weight is the sum over pairs of planes
of popcount(count plane AND gain plane) times a power of two, negative for the
sign plane.  All sums are integers, so weights are exact.

A Gumbel noise that depends on the id alone is added, and the highest scores
are drawn: sampling without replacement with odds by weight.

Scale: two passes over the texts without shuffling any of them.  The first
sends at most 10,000 counts a task through one aggregation; only the 10,000
totals reach the driver, and the gain planes (under 30 KB) travel with the
tasks.  Ranks come from a range partitioning of (score, id) rows and one count
per partition, no task sorts more than its range; rows that are equal in both
are spread by their place in the table.

Defined results: a null text has no words.  Rows without id take the noise of
an empty id and come after rows with an id among equal scores; rows that repeat
an id and a score have different ranks.  An empty table gives no rows, an empty
target gains from its counts of zero.  Extra columns pass unchanged.
"""

from __future__ import annotations

import math
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import materialize, python_tasks
from tidemark.llm.streams import lean

BUCKETS = 10_000
LONGEST = 3
# UTF-8 bytes of a word, after A-Z are lower-cased: 0-9, a-z and all of no ASCII
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BLOCK = 64                       # documents whose planes are built at a time


def feature_buckets(text: bytes, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every feature of a text (its UTF-8
    bytes).  The checksum of a longer run continues that of the shorter one."""
    words = WORD.findall(text.lower())
    sums = [crc32(w) for w in words]
    every = list(sums)
    spaced = [b" " + w for w in words]
    for n in range(1, LONGEST):
        sums = list(map(crc32, spaced[n:], sums))
        every += sums
    return len(words), np.array(every, dtype=np.int64) % buckets


def _texts(batch) -> list[bytes]:
    column = batch.column(batch.schema.names.index("text")).cast(pa.binary())
    return [t or b"" for t in column.to_pylist()]


def bucket_counts(spark: SparkSession, docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of the whole table per bucket: one count vector a task, summed."""
    python_tasks(spark)

    def count(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for t in _texts(batch):
                total += np.bincount(feature_buckets(t, buckets)[1], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(total)],
                                         names=["bucket", "n"])
    rows = (docs.select("text").mapInArrow(lean(count), "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    out = np.zeros(buckets, dtype=np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log odds) of each bucket, target against source, smoothed."""
    s_all = float(source.sum()) + len(source)
    t_all = float(target.sum()) + len(target)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * s_all / ((float(s) + 1) * t_all)))
                     for s, t in zip(source, target)], dtype=np.int64)


def bit_planes(values: np.ndarray, n: int) -> np.ndarray:
    """Planes [row, bit, 64-bit word] of non-negative values [row, bucket]."""
    rows, buckets = values.shape
    out = np.zeros((rows, n, -(-buckets // 64) * 8), dtype=np.uint8)
    for j in range(n):
        packed = np.packbits(((values >> j) & 1).astype(bool), axis=1)
        out[:, j, :packed.shape[1]] = packed
    return out.view(np.uint64)


class GainPlanes:
    """Gains in two's complement, a plane per bit; the last one is the sign."""

    def __init__(self, gains: np.ndarray):
        self.buckets = len(gains)
        self.bits = int(np.abs(gains).max(initial=0)).bit_length() + 1
        self.planes = bit_planes((gains & ((1 << self.bits) - 1))[None, :], self.bits)[0]
        self.worth = np.array([1 << k for k in range(self.bits)], dtype=np.int64)
        self.worth[-1] *= -1

    def weights(self, counts: np.ndarray) -> np.ndarray:
        """Exact weight of each row of bucket counts."""
        out = np.zeros(len(counts), dtype=np.int64)
        depth = int(counts.max(initial=0)).bit_length()
        for j in range(depth):
            plane = bit_planes((counts >> j) & 1, 1)              # [row, 1, word]
            ones = np.bitwise_count(plane & self.planes[None]).sum(axis=2, dtype=np.int64)
            out += (ones @ self.worth) << j
        return out


def weigh(spark: SparkSession, docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """``docs`` (without columns of these names) plus ``n_words, n_features, weight``."""
    python_tasks(spark)
    planes = GainPlanes(gains)
    size = planes.buckets

    def score(batches):
        for batch in batches:
            texts = _texts(batch)
            n_words, n_features, weight = (np.zeros(len(texts), dtype=np.int64) for _ in range(3))
            for lo in range(0, len(texts), BLOCK):
                some = texts[lo:lo + BLOCK]
                counts = np.zeros((len(some), size), dtype=np.int64)
                for i, t in enumerate(some):
                    n_words[lo + i], found = feature_buckets(t, size)
                    n_features[lo + i] = len(found)
                    counts[i] = np.bincount(found, minlength=size)
                weight[lo:lo + len(some)] = planes.weights(counts)
            keep = [c for c, n in zip(batch.columns, batch.schema.names) if n != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(n_words), pa.array(n_features), pa.array(weight)],
                names=[*names, "n_words", "n_features", "weight"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields
              if f.name != "text"]
    return docs.mapInArrow(lean(score), ", ".join(
        [*fields, "n_words long, n_features long, weight long"]))


def noise(doc_id, seed: int = 42):
    """floor(1000 * Gumbel noise) of an id: the first 32 bits of a hash as a quantile."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    u = (h + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def ranked(spark: SparkSession, rows: DataFrame, order: list, name: str,
           partitions: int | None = None) -> DataFrame:
    """``rows`` plus ``rank`` 1, 2, 3 ... in ``order`` (which has no ties), over
    the whole table: rows are dealt out by ranges and written sorted; a
    partition's first rank is the number of rows in the ranges before it."""
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = "_place"
    dealt = materialize(
        spark, rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
        .withColumn(place, F.monotonically_increasing_id()), name)
    part, inside = F.shiftright(place, 33), F.col(place).bitwiseAND((1 << 33) - 1)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select(                       # one row a partition
        "_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return (dealt.withColumn("_part", part).join(F.broadcast(before), "_part")
            .withColumn("rank", F.col("_before") + inside + 1)
            .drop("_part", "_before", place))


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, percent: int = 5,
             least_words: int = 20, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every document;
    ``rank`` is null but for the ``percent`` of the documents with at least
    ``least_words`` words that are drawn."""
    gains = bucket_gains(bucket_counts(spark, docs, buckets), bucket_counts(spark, target, buckets))
    scored = (weigh(spark, docs.select("doc_id", "text"), gains)
              .withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
              .withColumn("_row", F.monotonically_increasing_id()))
    scored = materialize(spark, scored, "importance")
    able = scored.where(F.col("n_words") >= least_words)
    draw = able.count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row").asc()]
    place = ranked(spark, able, order, "importance_ranks").withColumn(
        "rank", F.when(F.col("rank") <= draw, F.col("rank")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return place.unionByName(rest).drop("_row")
