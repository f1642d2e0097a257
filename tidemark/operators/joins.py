"""Joining a large fact to a per-key dimension.

A dimension side is broadcast only after its size has been proven to be under
two bounds, of rows and of bytes (one aggregate over at most bound + 1 rows);
beyond either the join is a shuffle join, and adaptive execution splits
partitions of hot keys (see ``session.SQL_DEFAULTS``).
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_MAX_BROADCAST_ROWS = 2_000_000
DEFAULT_MAX_BROADCAST_BYTES = 256_000_000
_CONF_KEY = "spark.tidemark.broadcastMaxRows"
_BYTES_KEY = "spark.tidemark.broadcastMaxBytes"
# A proven size is remembered per plan and files for a short while, so the many
# operators of one report run do not each re-count the same dimension.
_MEMO_SECONDS = 300.0
_memo: dict[tuple, tuple[float, bool]] = {}


def broadcast_bound(df: DataFrame) -> int:
    conf = df.sparkSession.conf.get(_CONF_KEY, None)
    return int(conf) if conf else DEFAULT_MAX_BROADCAST_ROWS


def _row_bytes(df: DataFrame):
    """Bytes of a row as it is broadcast: 16 a column, and what texts, binaries
    and collections hold."""
    out = F.lit(16 * max(len(df.columns), 1)).cast("long")
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            out += F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            out += F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return out


def fits_broadcast(df: DataFrame, max_rows: int | None = None) -> bool:
    bound = broadcast_bound(df) if max_rows is None else max_rows
    if bound <= 0:
        return False
    conf = df.sparkSession.conf.get(_BYTES_KEY, None)
    most = int(conf) if conf else DEFAULT_MAX_BROADCAST_BYTES
    # a table that was written anew at the same path has other files
    key = (id(df.sparkSession), df.semanticHash(), hash(tuple(df.inputFiles())), bound, most)
    now = time.monotonic()
    hit = _memo.get(key)
    if hit is not None and now - hit[0] < _MEMO_SECONDS:
        return hit[1]
    rows, size = df.limit(bound + 1).agg(
        F.count(F.lit(1)), F.coalesce(F.sum(_row_bytes(df)), F.lit(0))).head()
    ok = rows <= bound and size <= most
    _memo[key] = (now, ok)
    return ok


def join_dimension(fact: DataFrame, dim: DataFrame, on, how: str = "inner",
                   max_rows: int | None = None) -> DataFrame:
    """``fact JOIN dim`` with a size-checked broadcast of ``dim``."""
    side = F.broadcast(dim) if fits_broadcast(dim, max_rows) else dim
    return fact.join(side, on, how)
