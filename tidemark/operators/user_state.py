"""The accumulating snapshot, kept up to date batch by batch.

What events say about a user is a state that can be merged: per (user, date)
the first board, invitation and week-2 event, the counts of the first week and
the retention flags.  A batch is reduced to such rows and merged with the rows
of its own users; events that were loaded before are never read again.

One versioned table (``sources.versioned``), its relations cut by a hash of the
user so that a batch reads and writes the buckets of its users only:

  users    user_id, signed_up_at of every user seen
  days     the mergeable state, one row per (user, date)
  waiting  events whose user is not known yet, as they came

Waiting events are offered again when their user arrives, so signups and
events may come in any order.  All relations switch together; a batch that is
sent again is recognised by its source and number.

Defined results: a user sent again keeps the signup time they came with first.
Every event counts, also one of an id that came before: replacing events is the
event table's part.  Events and users without a user id are dropped.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.engagement import (
    WINDOWS, ActivationSpec, FunnelSpec, daily_activity, merge_days, rollup_days,
)
from tidemark.operators.marts import funnel_snapshot
from tidemark.session import checkpoint_root
from tidemark.sources.versioned import Folder, Relation, VersionedTable, relation_schema

BUCKET = "bucket"
USER_BUCKETS = 64
EVENT_COLUMNS = ("user_id", "event_type", "event_timestamp")


class UserStateTable:
    def __init__(self, spark: SparkSession, path: str, buckets: int = USER_BUCKETS,
                 funnel: FunnelSpec = FunnelSpec(), activation: ActivationSpec = ActivationSpec(),
                 windows=WINDOWS):
        self.spark, self.buckets = spark, buckets
        self.table = VersionedTable(spark, path)
        self.specs = funnel, activation, windows

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.where(F.col("user_id").isNotNull()).withColumn(
            BUCKET, F.pmod(F.xxhash64("user_id"), F.lit(self.buckets)).cast("int"))

    def update(self, users: DataFrame, events: DataFrame, source: str, number: int) -> bool:
        """Take in the users and events of batch ``number`` of ``source``.  False
        if the table has it already."""
        checkpoint_root(self.spark)
        base = self.table.current() if self.table.exists() else None
        relations = self.table.relations(base) if base else {}
        done = json.loads(relations["days"].note or "{}") if relations else {}
        if number <= done.get(source, -1):
            return False
        new_users = self._bucketed(users.select("user_id", "signed_up_at")) \
            .groupBy("user_id", BUCKET).agg(F.min("signed_up_at").alias("signed_up_at")) \
            .checkpoint(eager=True)
        new_events = self._bucketed(events.select(*EVENT_COLUMNS)).checkpoint(eager=True)
        # no more values than there are buckets
        touched = {r[0] for r in new_users.select(BUCKET).union(new_events.select(BUCKET))
                   .distinct().collect()}
        parts = {f"{BUCKET}={b}" for b in touched}

        def old(name: str, like: DataFrame) -> DataFrame:
            """Rows of the touched buckets, in the columns of ``like``."""
            if name not in relations:
                return like.limit(0)
            r = relations[name]
            return self.table.frame(name, r, [f for f in r.folders if f.part in parts]) \
                .select(*like.columns)

        known = old("users", new_users)
        arrived = new_users.join(known.select("user_id"), "user_id", "left_anti")
        users_now = known.unionByName(arrived.select(*known.columns))
        offered = new_events.unionByName(old("waiting", new_events))
        funnel, activation, windows = self.specs
        keyed = ["user_id", BUCKET]
        counted = daily_activity(offered.join(users_now, keyed).select(
            *EVENT_COLUMNS, "signed_up_at"), funnel, activation, windows)
        days = merge_days(counted.unionByName(old("days", counted)), windows)
        waiting = offered.join(users_now.select(*keyed), keyed, "left_anti")

        done[source] = number
        self.table.commit({
            "users": self._replaced(relations, "users", users_now, parts),
            "days": self._replaced(relations, "days", self._bucketed(days), parts,
                                   json.dumps(done)),
            "waiting": self._replaced(relations, "waiting",
                                      waiting.select(*EVENT_COLUMNS, BUCKET), parts)}, base)
        return True

    def _replaced(self, relations: dict[str, Relation], name: str, rows: DataFrame,
                  parts: set[str], note: str | None = None) -> Relation:
        kept: list[Folder] = [f for f in relations[name].folders if f.part not in parts] \
            if name in relations else []
        staged = self.table.stage(rows.repartition(BUCKET), name, BUCKET)
        return Relation(relation_schema(rows), BUCKET, kept + staged, note)

    def activity(self) -> DataFrame:
        """``event_rollup`` of everything taken in."""
        return rollup_days(self.table.read("days"), self.specs[2])

    def snapshot(self, users: DataFrame, subs: DataFrame) -> DataFrame:
        """The accumulating snapshot of ``users``, without a look at events."""
        funnel, activation, _ = self.specs
        return funnel_snapshot(users, None, subs, funnel, activation, rollup=self.activity())
