"""Previous / next row of the same key, without gathering a key's rows.

``lag``/``lead`` over ``Window.partitionBy(key)`` sorts every row of a key in
one task, so a key holding a third of the data becomes one straggler.  Here
the window runs per (key, time bucket) -- a hot key is spread over its
buckets -- and the rows at bucket edges take their neighbour from the
adjacent non-empty bucket: a second window over one row per (key, bucket),
whose size per key is bounded by the time span divided by the bucket width,
not by the number of rows.  The result equals the plain window exactly when
``bucket`` is non-decreasing in the order columns.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_MAX_GROUP_ROWS = 1_000_000
_CONF_KEY = "spark.tidemark.windowMaxGroupRows"
_MEMO_SECONDS = 300.0
_memo: dict[tuple, tuple[float, int]] = {}


def largest_group(df: DataFrame, key: str) -> int:
    """Rows of the most frequent key (a partial + final aggregate; one row
    reaches the driver).  Remembered per plan for a short while."""
    memo_key = (id(df.sparkSession), df.semanticHash(), key)
    hit = _memo.get(memo_key)
    now = time.monotonic()
    if hit is not None and now - hit[0] < _MEMO_SECONDS:
        return hit[1]
    row = df.groupBy(key).count().agg(F.max("count").alias("m")).first()
    n = int(row["m"] or 0)
    _memo[memo_key] = (now, n)
    return n


def with_neighbors(df: DataFrame, key: str, order: list[str], bucket: Column,
                   prev_cols: list[str] = (), next_cols: list[str] = (),
                   max_group_rows: int | None = None) -> DataFrame:
    """``df`` plus ``prev_<c>`` for c in prev_cols and ``next_<c>`` for c in
    next_cols: the value in the previous / next row of the same key, rows
    ordered by ``order`` (which must break ties).

    When the largest key is proven to hold at most ``max_group_rows`` rows
    (default 1 M, ``spark.tidemark.windowMaxGroupRows``) a plain window per
    key is used -- one bounded group per task; otherwise the bucketed form."""
    if max_group_rows is None:
        conf = df.sparkSession.conf.get(_CONF_KEY, None)
        max_group_rows = int(conf) if conf else DEFAULT_MAX_GROUP_ROWS
    if max_group_rows > 0 and largest_group(df, key) <= max_group_rows:
        w = Window.partitionBy(key).orderBy(*order)
        return df.select("*", *[F.lag(c).over(w).alias(f"prev_{c}") for c in prev_cols],
                         *[F.lead(c).over(w).alias(f"next_{c}") for c in next_cols])
    return bucketed_neighbors(df, key, order, bucket, prev_cols, next_cols)


def bucketed_neighbors(df: DataFrame, key: str, order: list[str], bucket: Column,
                       prev_cols: list[str] = (), next_cols: list[str] = ()) -> DataFrame:
    """The skew-proof form: windows per (key, bucket) plus a window over one
    row per (key, bucket)."""
    cols = list(dict.fromkeys([*prev_cols, *next_cols]))
    d = df.withColumn("_bk", bucket)
    inner = Window.partitionBy(key, "_bk").orderBy(*order)
    whole = Window.partitionBy(key, "_bk")
    local = d.select(
        "*",
        *[F.lag(c).over(inner).alias(f"_lp_{c}") for c in prev_cols],
        *[F.lead(c).over(inner).alias(f"_ln_{c}") for c in next_cols],
        F.row_number().over(inner).alias("_rn"),
        F.count(F.lit(1)).over(whole).alias("_cnt"))
    okey = F.struct(*order)
    edges = d.groupBy(key, "_bk").agg(
        F.min_by(F.struct(*cols), okey).alias("_first"),
        F.max_by(F.struct(*cols), okey).alias("_last"))
    across = Window.partitionBy(key).orderBy("_bk")
    edges = edges.select(key, "_bk",
                         F.lag("_last").over(across).alias("_prev_last"),
                         F.lead("_first").over(across).alias("_next_first"))
    j = local.join(edges, [key, "_bk"], "left")
    out = [F.col(c) for c in df.columns]
    out += [F.when(F.col("_rn") == 1, F.col(f"_prev_last.{c}"))
            .otherwise(F.col(f"_lp_{c}")).alias(f"prev_{c}") for c in prev_cols]
    out += [F.when(F.col("_rn") == F.col("_cnt"), F.col(f"_next_first.{c}"))
            .otherwise(F.col(f"_ln_{c}")).alias(f"next_{c}") for c in next_cols]
    return j.select(*out)
