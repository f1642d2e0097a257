"""Each document together with the document that follows it in descending id.

The order is cut into ranges of about ``RANGE_BYTES`` of text (as many as there
are shuffle partitions at least), at keys (id and hash of the text) drawn from
a random sample of the rows.  Rows are dealt out by range, so a task walks one
range in order, however large the table is.  Every bound is the key of a row, so
the text behind a range is that of the next bound; these texts are found by one
join with the list of bounds and sent along.  The last document of all is
followed by the first.  Only the sample's keys (some twenty a range) reach the
driver; the list of bounds travels with the tasks.

Rows of the same id follow one another in the order of the hash of their text;
rows without id come last, in the order of that hash, too.  Rows equal in both
may fill several ranges: they are dealt among these at random, as each is
followed by its like, but for the last.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import python_tasks
from tidemark.llm.streams import lean

RANGE_BYTES = 16_000_000
SAMPLED = 20                    # keys of the sample a range


def _keys(no_id, inverted, h) -> np.ndarray:
    """Keys that compare as bytes do: rows without id last, then descending id
    (``inverted``: its bits), then hash."""
    out = np.zeros((len(h), 17), dtype=np.uint8)
    out[:, 0] = np.asarray(no_id, dtype=np.uint8)
    for at, values in ((1, inverted), (9, h)):
        unsigned = np.asarray(values, dtype=np.int64).view(np.uint64) ^ np.uint64(1 << 63)
        out[:, at:at + 8] = unsigned.astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.reshape(-1).view("S17")


def _range_finder(bounds: np.ndarray):
    def find(no_id: pd.Series, inverted: pd.Series, h: pd.Series, chance: pd.Series) -> pd.Series:
        key = _keys(no_id, inverted, h)
        lo, hi = (np.searchsorted(bounds, key, side) for side in ("left", "right"))
        # a key at one bound or none has one range, one at several bounds several
        spread = lo + 1 + (chance.to_numpy() * (hi - lo)).astype(np.int64)
        return pd.Series(np.where(hi - lo > 1, spread, hi).astype(np.int32))
    return find


def _bounds(keyed: DataFrame, ranges: int | None, least_ranges: int):
    """First key of all, and keys at which the ranges after the first begin, as
    (no_id, inverted, h) arrays; None without rows."""
    first = F.min(F.struct("no_id", "inverted", "h"))
    rows, size, least = keyed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), first).head()
    if not rows:
        return None
    ranges = ranges or max(least_ranges, -(-size // RANGE_BYTES))
    share = min(1.0, SAMPLED * ranges / rows)
    sample = (keyed.select("no_id", "inverted", "h").sample(fraction=share, seed=17).toPandas()
              if ranges > 1 else keyed.select("no_id", "inverted", "h").limit(0).toPandas())
    sample = sample.sort_values(["no_id", "inverted", "h"], ignore_index=True)
    at = np.unique(np.arange(1, ranges) * len(sample) // ranges) if len(sample) else []
    picked = sample.iloc[list(at)]
    start = pd.DataFrame([tuple(least)], columns=["no_id", "inverted", "h"])
    return pd.concat([start, picked], ignore_index=True).astype(
        {"no_id": "int32", "inverted": "int64", "h": "int64"})


def with_next_text(spark: SparkSession, docs: DataFrame, work, schema: str,
                   ranges: int | None = None) -> DataFrame:
    """Apply ``work(frame)`` to runs of rows; ``frame`` has ``doc_id, text`` (null
    texts: empty) and ``next``, the text of the row that follows."""
    python_tasks(spark)
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    keyed = docs.select(
        "doc_id", "text", F.octet_length("text").alias("size"),
        F.col("doc_id").isNull().cast("int").alias("no_id"),
        F.bitwise_not(F.coalesce("doc_id", F.lit(0))).alias("inverted"),
        F.xxhash64("text").alias("h"))
    bounds = _bounds(keyed, ranges, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if bounds is None:
        return spark.createDataFrame([], schema)
    n = len(bounds)
    cuts = _keys(bounds["no_id"][1:], bounds["inverted"][1:], bounds["h"][1:])
    number = F.pandas_udf(_range_finder(cuts), "int")
    placed = keyed.select("doc_id", "text", "h",
                          number("no_id", "inverted", "h", F.rand(7)).alias("range"),
                          F.lit(False).alias("guest"))
    # the text at the start of each range goes to the range before (one row a range)
    before = bounds.assign(range=(np.arange(n) - 1) % n)
    wanted = spark.createDataFrame(before, "no_id int, inverted long, h long, range int")
    guests = (keyed.select("text", "no_id", "inverted", "h")
              .join(F.broadcast(wanted), ["no_id", "inverted", "h"])
              .groupBy("range").agg(F.min("text").alias("text"))
              .select(F.lit(None).cast("long").alias("doc_id"), "text",
                      F.lit(0).cast("long").alias("h"), "range", F.lit(True).alias("guest")))
    # one range a task
    dealt = (placed.unionByName(guests).repartitionById(n, "range")
             .sortWithinPartitions("range", "guest", F.desc_nulls_last("doc_id"), "h", "text"))

    def walk(batches):
        waiting = None                                 # last row so far, without its successor
        done = None                                    # range whose successor has been found
        for b in batches:
            rows = list(zip(b["range"], b["guest"], b["doc_id"], b["text"]))
            ids, texts, follow = [], [], []
            for r, guest, i, t in rows:
                if waiting is not None and waiting[0] == r:
                    ids.append(waiting[1])
                    texts.append(waiting[2])
                    follow.append(t)
                    waiting = None
                if guest:
                    done = r                           # later guests are not needed
                elif r != done:
                    waiting = (r, i, t)
            if ids:
                yield from work(pd.DataFrame({
                    "doc_id": pd.array([None if pd.isna(i) else int(i) for i in ids], "Int64"),
                    "text": texts, "next": follow}))
    return dealt.select("range", "guest", "doc_id", "text").mapInPandas(lean(walk), schema)


def edited(text: str, following: str) -> str:
    """The last third of a text replaced by the first characters of the next."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


