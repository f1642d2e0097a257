"""Structured Streaming forms of the incremental operators.

  event_fact_stream      events -> foreachBatch keyed load of the event fact
  funnel_snapshot_stream events JOIN static users -> stateful per-user
                         milestone minimums, update mode -> keyed upsert
  funnel_snapshot_join_stream
                         events and signups as two streams -> one keyed state
                         of all users, update mode -> keyed upsert
  weekly_signups_stream  users -> 7-day tumbling windows that
                         start on Mondays, update mode -> keyed upsert

Each takes a streaming DataFrame, writes to a sink path with its own
checkpoint location, and runs with ``availableNow`` (process what is there,
then stop) unless a processing-time trigger is given.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.timeops import add_days
from tidemark.operators.engagement import FunnelSpec
from tidemark.operators.event_table import EventTable
from tidemark.operators.joins import join_dimension
from tidemark.streaming.sinks import read_upserted, upsert_by_key

LTZ = T.TimestampType()


def read_stream(spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None,
                max_files_per_trigger: int | None = None, fmt: str = "parquet") -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def _run(writer, checkpoint: str, processing_time: str | None):
    writer = writer.option("checkpointLocation", checkpoint)
    writer = (writer.trigger(processingTime=processing_time) if processing_time
              else writer.trigger(availableNow=True))
    q = writer.start()
    if not processing_time:
        q.awaitTermination()
    return q


def event_fact_stream(events: DataFrame, users: DataFrame, target: str, checkpoint: str,
                      mode: str = "keyed", lookback_days: int = 3,
                      processing_time: str | None = None, compact_every: int = 50):
    """I1/I2 as a stream.  By default every event counts, whatever its time and
    the order of the files: a micro-batch is appended to the event table and
    replaces events of the same id when the table is read; every
    ``compact_every`` micro-batches the appended ones are folded in.  A retried
    micro-batch is recognised and changes nothing.  ``strict`` and ``lookback``
    load each micro-batch as the batch runs of that name do, and drop late rows
    as they do."""
    table = EventTable(events.sparkSession, target)

    def load(batch: DataFrame, epoch_id: int) -> None:
        if mode != "keyed":
            table.load(users, batch, mode, lookback_days)
            return
        table.append(users, batch, checkpoint, epoch_id)
        if table.n_deltas() >= compact_every:
            table.compact()

    return _run(events.writeStream.foreachBatch(load), checkpoint, processing_time)


SNAPSHOT_STREAM_COLUMNS = ("user_id", "created_first_board_at", "invited_first_member_at",
                           "active_in_week_2_at")


def funnel_snapshot_stream(events: DataFrame, users: DataFrame, target: str, checkpoint: str,
                           spec: FunnelSpec = FunnelSpec(),
                           processing_time: str | None = None):
    """Accumulating snapshot kept current as events arrive: the state is one
    row per user (it grows with users, not events)."""
    su = users.select("user_id", "signed_up_at")
    # stream-static join: adaptive execution does not run inside micro-batches,
    # so the static side is broadcast here after its size check
    j = join_dimension(events, su, "user_id")
    ts, s, t = F.col("event_timestamp"), F.col("signed_up_at"), F.col("event_type")
    in_w2 = (ts >= add_days(s, spec.week2_from_days)) & (ts < add_days(s, spec.week2_to_days))
    agg = j.groupBy("user_id").agg(
        F.min(F.when(t == spec.board_event, ts)).alias("created_first_board_at"),
        F.min(F.when(t == spec.invite_event, ts)).alias("invited_first_member_at"),
        F.min(F.when(in_w2, ts)).alias("active_in_week_2_at"))

    def upsert(batch: DataFrame, epoch_id: int) -> None:
        upsert_by_key(batch, target, ["user_id"])

    return _run(agg.writeStream.outputMode("update").foreachBatch(upsert), checkpoint,
                processing_time)


_STATE = "users binary, waiting binary"
_MICROS = ("signed_up", "board", "invite", "week2")
_DAY = 86_400_000_000
_NEVER = (1 << 63) - 1                  # stands for no time: the least of times passes over it


def _milestones(spec: FunnelSpec, most: int = 50_000):
    """State of one bucket of users: per user times in microseconds; until the
    signup is known, the times of all events, as any may turn out to be in
    week 2.  About ``most`` rows of a micro-batch are held at once, beside the
    distinct ones.  Tasks get it whole, with nothing of this package."""
    lo, hi = spec.week2_from_days * _DAY, spec.week2_to_days * _DAY

    def to_bytes(frame):
        table = pa.Table.from_pandas(frame, preserve_index=False)
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema) as writer:
            writer.write_table(table)
        return out.getvalue().to_pybytes()

    def from_bytes(data):
        return pa.ipc.open_stream(data).read_all().to_pandas()

    def least(frames):
        return pd.concat(frames).groupby("user_id", sort=False, dropna=False, as_index=False).min()

    def step(key, frames, state):
        users, waiting = (from_bytes(x) for x in state.get) if state.exists else (None, None)
        found, times, held = [], [], []

        def fold():
            rows = pd.concat(held)
            held.clear()
            found[:] = [least(found + [rows[["user_id", "signed_up", "board", "invite"]]])]
            seen = rows.loc[rows["at"] != _NEVER, ["user_id", "at"]]
            times[:] = [pd.concat(times + [seen]).drop_duplicates()]
        for pdf in frames:
            held.append(pdf)
            if sum(map(len, held)) >= most:
                fold()
        if held:
            fold()
        new = found[0].assign(week2=_NEVER)
        touched = new["user_id"]
        if users is not None:
            # a user sent again keeps the first signup
            have = users.loc[users["signed_up"] != _NEVER, "user_id"]
            new.loc[touched.isin(have), "signed_up"] = _NEVER
            times.insert(0, waiting)
            new = least([users, new])
        seen = pd.concat(times).drop_duplicates().merge(new[["user_id", "signed_up"]], "left",
                                                        "user_id")
        known = seen["signed_up"] != _NEVER
        after = seen["at"][known] - seen["signed_up"][known]
        in_week2 = seen[known][(after >= lo) & (after < hi)]
        if len(in_week2):
            new = least([new, in_week2[["user_id"]].assign(
                signed_up=_NEVER, board=_NEVER, invite=_NEVER, week2=in_week2["at"])])
        state.update((to_bytes(new), to_bytes(seen.loc[~known, ["user_id", "at"]])))
        yield new[new["user_id"].isin(touched) & (new["signed_up"] != _NEVER)][
            ["user_id", *_MICROS]]
    return step


def funnel_snapshot_join_stream(events: DataFrame, signups: DataFrame, target: str,
                                checkpoint: str, spec: FunnelSpec = FunnelSpec(),
                                processing_time: str | None = None, buckets: int = 1024):
    """The accumulating snapshot of two streams: users arrive as a stream, too,
    before or after their events.  Both are one keyed state, so there is no
    static side that goes stale or grows; a user has a row from signup on, with
    or without events.  The state of a user is four times, and the times of the
    events that came before the user did; a user sent again keeps the first
    signup.  Events of users that never arrive stay in the state.

    Users are dealt into ``buckets`` by a hash of their id, and a bucket's are
    brought up to date together: a Python call per user costs milliseconds.
    The number belongs to the checkpoint, as the state is kept by bucket."""
    micros = lambda c: F.coalesce(F.unix_micros(c.cast(LTZ)), F.lit(_NEVER))  # noqa: E731  (UTC session)
    never = F.lit(_NEVER)
    at, kind = F.col("event_timestamp"), F.col("event_type")
    rows = signups.select("user_id", micros(F.col("signed_up_at")).alias("signed_up"),
                          never.alias("board"), never.alias("invite"), never.alias("at")) \
        .unionByName(events.select(
            "user_id", never.alias("signed_up"),
            micros(F.when(kind == spec.board_event, at)).alias("board"),
            micros(F.when(kind == spec.invite_event, at)).alias("invite"),
            micros(at).alias("at"))) \
        .where(F.col("user_id").isNotNull()) \
        .withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(buckets)))
    user_type = dict(rows.dtypes)["user_id"]
    out = ", ".join([f"user_id {user_type}", *(f"{c} long" for c in _MICROS)])
    found = rows.groupBy("bucket").applyInPandasWithState(_milestones(spec), out, _STATE, "update",
                                                          "NoTimeout")
    time = lambda c: F.timestamp_micros(F.nullif(c, never)).cast("timestamp_ntz")
    snapshot = found.select("user_id", time(F.col("board")).alias("created_first_board_at"),
                            time(F.col("invite")).alias("invited_first_member_at"),
                            time(F.col("week2")).alias("active_in_week_2_at"))

    def upsert(batch: DataFrame, epoch_id: int) -> None:
        upsert_by_key(batch, target, ["user_id"])

    return _run(snapshot.writeStream.outputMode("update").foreachBatch(upsert), checkpoint,
                processing_time)


def weekly_signups_stream(users: DataFrame, target: str, checkpoint: str,
                          processing_time: str | None = None):
    """Signups per Monday-starting week (the epoch is a Thursday, hence the
    4-day offset).  No watermark, so no late signup is lost; the state is one
    row per week."""
    u = users.withColumn("_t", F.col("signed_up_at").cast(LTZ))
    agg = (u.groupBy(F.window("_t", "7 days", startTime="4 days").alias("w"))
           .agg(F.count(F.lit(1)).alias("signups"))
           .select(F.to_date(F.col("w.start")).alias("signup_week"), "signups"))

    def upsert(batch: DataFrame, epoch_id: int) -> None:
        upsert_by_key(batch, target, ["signup_week"])

    return _run(agg.writeStream.outputMode("update").foreachBatch(upsert), checkpoint,
                processing_time)


def read_result(spark: SparkSession, target: str, keyed: bool = True) -> DataFrame:
    return read_upserted(spark, target) if keyed else EventTable(spark, target).read()
