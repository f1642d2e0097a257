"""Removal of cross-site boilerplate lines by distinct-site spread.

Every line that is not blank (split at new lines, outer spaces trimmed, at
least ``min_words`` words) has a hash; a HyperLogLog sketch of the sites it
occurs on is built per hash, partially in every task and merged by
aggregation.  A line whose estimate is clearly above ``min_sites`` is
boilerplate, one clearly below is not, and lines near the threshold get an
exact distinct count.  Boilerplate is removed from all documents but the first
that has it, which keeps its first occurrence, so no content is lost
altogether.

A document is its id, site and text together: the first one is that of the
smallest id, then site, then text hash.  Rows that share an id, or have none,
are told apart by site and text; only rows equal in all three are one document
and keep the same lines.

DataFrame functions only.  A line on a third of all documents is one partial
sketch per task; hashes that may be boilerplate are broadcast if a count of
them says that they are few, joined by a shuffle beyond that, and the places
where they occur are written once; texts are shuffled once, to meet the places
to drop from them.

Defined results: null or empty texts stay as they are; null sites do not count
as a site; rows without id come after those with one.  ``n_chars``, if
present, is set to the new length of changed texts.  Other columns pass
unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, packed
from tidemark.operators.joins import join_dimension

BROADCAST_LINES = 100_000


def _document() -> list[Column]:
    """128 bits that name a document: two hashes of its id, site and text."""
    parts = F.col("doc_id"), F.col("source"), F.col("text")
    return [F.xxhash64(F.lit(n), F.col("doc_id").isNull(), F.col("source").isNull(),
                       *parts).alias(f"d{n}") for n in (1, 2)]


def _lines(docs: DataFrame, min_words: int, *columns) -> DataFrame:
    """``pos, h`` and some columns of the documents: one row per line that is
    looked at."""
    cut = docs.where(F.col("text").isNotNull()).select(
        *columns, F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = F.trim("line")
    long_enough = line != "" if min_words <= 1 else (line != "") & (
        F.size(F.split(line, " ")) >= min_words)
    return cut.where(long_enough).withColumn("h", F.xxhash64(line)).drop("line")


def boilerplate_hits(docs: DataFrame, min_sites: int = 5, min_words: int = 1,
                     lg_k: int = 12) -> DataFrame:
    """``h, sites, doc_id, site, d1, d2, pos``: every occurrence of a line on at
    least ``min_sites`` sites."""
    site = F.col("source").alias("site")
    # three standard errors of the sketch, one site at least
    band = max(1.0, 3 * 1.04 / 2 ** (lg_k / 2) * min_sites)
    sketched = (_lines(docs, min_words, site).groupBy("h")
                .agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
                .select("h", F.hll_sketch_estimate("sketch").alias("sites"))
                .where(F.col("sites") >= min_sites - band))
    near_or_far = materialize(docs.sparkSession, sketched, "spread_lines")
    hits = materialize(docs.sparkSession, join_dimension(
        _lines(docs, min_words, "doc_id", site, *_document()), near_or_far, "h",
        max_rows=BROADCAST_LINES), "line_hits")
    near = F.col("sites") <= min_sites + band
    exact = (hits.where(near).groupBy("h").agg(F.countDistinct("site").alias("sites"))
             .where(F.col("sites") >= min_sites))
    return hits.where(~near).unionByName(
        join_dimension(hits.where(near).drop("sites"), exact, "h", max_rows=BROADCAST_LINES))


def lines_to_drop(docs: DataFrame, min_sites: int = 5, min_words: int = 1,
                  lg_k: int = 12) -> DataFrame:
    """``d1, d2, places``: positions of the lines that go, per document."""
    hits = boilerplate_hits(docs, min_sites, min_words, lg_k)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.col("site").isNull(), "site", "d1", "d2")
    first = hits.groupBy("h").agg(F.min(order).alias("first"))
    # places of one line in one document; rows that repeat a document add nothing
    per_line = hits.groupBy("d1", "d2", "h").agg(F.collect_set("pos").alias("at"))
    keeps = (F.col("first.d1") == F.col("d1")) & (F.col("first.d2") == F.col("d2"))
    gone = F.when(keeps, F.array_remove("at", F.array_min("at"))).otherwise(F.col("at"))
    return (join_dimension(per_line, first, "h", max_rows=BROADCAST_LINES)
            .select("d1", "d2", gone.alias("gone")).where(F.size("gone") > 0)
            .groupBy("d1", "d2").agg(F.flatten(F.collect_list("gone")).alias("places")))


def drop_boilerplate(docs: DataFrame, min_sites: int = 5, min_words: int = 1,
                     lg_k: int = 12, counts: bool = False) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text``.  With ``counts``
    the columns ``n_lines`` and ``n_removed`` are appended."""
    drop = lines_to_drop(docs, min_sites, min_words, lg_k).toDF("of1", "of2", "places")
    rows = docs.select(*_document(), packed(docs).alias("row"))
    joined = rows.join(drop, (F.col("d1") == F.col("of1")) & (F.col("d2") == F.col("of2"))
                       & F.col("row.text").isNotNull(), "left")
    every = F.split("row.text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.col("places"))
    changed = F.col("places").isNotNull()
    text = F.when(changed, F.array_join(F.transform(left, lambda i: F.get(every, i)), "\n")) \
        .otherwise(F.col("row.text"))
    out = []
    for name in docs.columns:
        column = F.col("row").getField(name)
        if name == "text":
            column = text
        elif name == "n_chars":
            column = F.when(changed, F.length(text).cast(docs.schema[name].dataType)) \
                .otherwise(column)
        out.append(column.alias(name))
    if counts:
        n = F.when(F.col("row.text").isNull(), F.lit(0)).otherwise(F.size(every)).cast("long")
        out += [n.alias("n_lines"),
                F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_removed")]
    return joined.select(*out)
