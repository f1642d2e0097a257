"""Interaction audit of corpus filters: what every filter takes in every order.

Five filters (A to E) judge whole texts; a document's failures are a mask of
five bits.  Documents are counted per cell of part (language) and mask, 32
cells a part at most.  Each cell then folds across the array of all 120 orders
(a literal that travels with the plan): ``transform`` walks the orders and
``aggregate`` the five steps of one, which gives 600 structs weighted by the
counts of the cell.  The cells of a part are merged by elementwise sums.

Duplicates (filter E) are found table-wide without collecting a group: rows
with the same text, id, part and mask are counted as one, the smallest id of
each text (its SHA-256) is an aggregate, and whether a row has that id is a
join on (text, id), a key of which no value is frequent.  Everything that is
shuffled is narrow: the texts are read once and stay where they are.

Defined results: a null text is empty (0 words: it fails A only, and E where a
smaller id is empty too); a null part is the empty string.  Rows without id
have no smaller id and are no smaller id; rows that repeat an id and a text
do not fail E for each other.  A document is good or toxic if any label row of
its id says so.  An empty table has no parts and no rows.  Extra columns are
not looked at.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
STEP = "struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">"


def text_mask(text: Column) -> Column:
    """Failures of A to D as bits; ``text`` is not null."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * n,
        "C": F.lit(100).cast("long") * capitals > F.lit(10).cast("long") * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }
    return sum((F.when(fails[f], BIT[f]).otherwise(0) for f in "ABCD"), F.lit(0))


def document_masks(spark: SparkSession, docs: DataFrame, part: str = "lang") -> DataFrame:
    """``text_hash, doc_id, part, mask, n``: rows that share all of the first
    four are one row with their number."""
    text = F.coalesce(F.col("text"), F.lit(""))
    judged = docs.select(
        F.unhex(F.sha2(text, 256)).alias("text_hash"), "doc_id",
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        text_mask(text).alias("mask"))
    # written once, so that no text is read again for the smallest ids
    same = materialize(spark, judged.groupBy("text_hash", "doc_id", "part", "mask")
                       .agg(F.count("*").alias("n")), "filter_masks")
    first = (same.where(F.col("doc_id").isNotNull()).groupBy("text_hash")
             .agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True)))
    later = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return (same.join(first, ["text_hash", "doc_id"], "left")
            .select("text_hash", "doc_id", "part", "n",
                    (F.col("mask") + F.when(later, BIT["E"]).otherwise(0)).alias("mask")))


def mask_cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents of each cell."""
    # rows without id get keys of their own, or they would all meet in one task
    told = (labels.where(F.col("doc_id").isNotNull())
            .groupBy(F.concat(F.lit("i"), F.col("doc_id").cast("string")).alias("key"))
            .agg(F.max((F.col("quality") == 1).cast("long")).alias("good"),
                 F.max((F.col("toxic") == 1).cast("long")).alias("toxic")))
    key = F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")),
                     F.concat(F.lit("n"), F.hex("text_hash")))
    weight = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0).cast("long")))
    return (masks.withColumn("key", key).join(told, "key", "left").groupBy("part", "mask")
            .agg(F.sum("n").alias("n"), weight("good").alias("good"),
                 weight("toxic").alias("toxic")))


def fold_cell(orders: Column) -> Column:
    """600 structs of one cell: step by step through every order."""
    zero = F.lit(0).cast("long")

    def step(acc, bit):
        fails = F.col("mask").bitwiseAND(bit) != 0
        goes = fails & ~acc["gone"]
        when = lambda c, x: F.when(c, F.col(x)).otherwise(zero)
        made = F.struct(
            when(~acc["gone"] & ~fails, "n").alias("kept"),
            when(goes, "n").alias("removed"),
            when(fails & acc["gone"], "n").alias("redundant"),
            when(F.col("mask") == bit, "n").alias("unique_fails"),
            when(goes, "good").alias("good_lost"),
            when(goes, "toxic").alias("toxic_lost"))
        return F.struct((acc["gone"] | fails).alias("gone"),
                        F.concat(acc["steps"], F.array(made)).alias("steps"))

    start = F.struct(F.lit(False).alias("gone"), F.array().cast(f"array<{STEP}>").alias("steps"))
    return F.flatten(F.transform(
        orders, lambda order: F.aggregate(order, start, step, lambda acc: acc["steps"])))


def added(a: Column, b: Column) -> Column:
    """Elementwise sums of two arrays of step structs."""
    return F.zip_with(a, b, lambda x, y: F.struct(*[(x[m] + y[m]).alias(m) for m in MEASURES]))


def audit_filters(spark: SparkSession, docs: DataFrame, labels: DataFrame,
                  part: str = "lang") -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley``: 600 rows per part."""
    names = ["".join(p) for p in permutations(FILTERS)]
    size = len(names) * len(FILTERS)
    orders = F.array(*[F.array(*[F.lit(BIT[f]) for f in o]) for o in names])
    nothing = F.array_repeat(F.struct(*[F.lit(0).cast("long").alias(m) for m in MEASURES]), size)
    cells = (mask_cells(document_masks(spark, docs, part), labels)
             .select("part", fold_cell(orders).alias("cell")))
    # at most 32 cells of 600 structs a part
    merged = cells.groupBy("part").agg(F.collect_list("cell").alias("cells")).select(
        "part", F.aggregate("cells", nothing, added).alias("total"))
    steps = merged.select("part", F.posexplode("total").alias("at", "x")).select(
        "part",
        F.element_at(F.array(*map(F.lit, names)),
                     (F.floor(F.col("at") / len(FILTERS)) + 1).cast("int")).alias("filter_order"),
        (F.col("at") % len(FILTERS) + 1).cast("int").alias("step"), "x.*")
    at_step = F.substring("filter_order", F.col("step"), F.lit(1))
    share = (steps.groupBy("part", at_step.alias("filter"))
             .agg(F.sum("removed").alias("shapley")))
    return (steps.withColumn("filter", at_step).join(share, ["part", "filter"])
            .select("part", "filter_order", "step", *MEASURES, "shapley"))
