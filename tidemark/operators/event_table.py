"""The event fact as a table that is kept up to date.

One versioned table (``sources.versioned``) with three relations:

  rows    the fact, one folder per load and ``event_date``, files sorted by time
  ids     which dates hold an event id: (event_id, event_date) by id bucket
  deltas  appended micro-batches that are not folded in yet

A load finds the dates that hold a replaced id in the buckets of its own ids,
rewrites those dates and the ones it adds rows to, and switches the version
once: dates that lose all rows drop out of it.  Rows of other dates are not
read.  The high-water mark comes from the version itself.

``append`` only writes the micro-batch: its cost does not grow with the table.
Readers take the newest delta of an id over older ones and over the rows;
``compact`` folds the deltas in as one load.  A micro-batch that is sent again
is recognised by its source and number.

``ids`` only grows by a load's own ids; an entry that a later load made stale
costs a needless look at a date, never a row.  ``compact_ids`` rewrites it.
"""

from __future__ import annotations

import datetime as _dt
import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.incremental import (
    _dedupe_latest, first_batch, select_batch,
)
from tidemark.operators.joins import join_dimension
from tidemark.operators.marts import FCT_EVENT_COLUMNS, fct_user_events
from tidemark.session import checkpoint_root
from tidemark.sources.versioned import Folder, Relation, VersionedTable, relation_schema

ID_BUCKETS = 64


def _date_folder(value) -> str:
    return f"event_date={'__HIVE_DEFAULT_PARTITION__' if value is None else value.isoformat()}"


class EventTable:
    def __init__(self, spark: SparkSession, path: str, id_buckets: int = ID_BUCKETS):
        self.spark, self.id_buckets = spark, id_buckets
        self.table = VersionedTable(spark, path)

    def exists(self) -> bool:
        return self.table.exists()

    # ---- reading ----------------------------------------------------------------
    def read(self, between: tuple[str, str] | None = None) -> DataFrame:
        """The fact.  With ``between`` (timestamps as text, both inclusive) only
        folders whose time range meets it are read; their rows are not filtered."""
        relations = self.table.relations()

        def meets(f: Folder) -> bool:
            return between is None or (f.low is not None and f.low <= between[1]
                                       and f.high >= between[0])
        rows, deltas = relations["rows"], relations["deltas"]
        base = self.table.frame("rows", rows, [f for f in rows.folders if meets(f)])
        if not deltas.folders:
            return base
        # a delta outside the range may still replace a row inside it
        newest = self._newest(deltas)
        return _without_ids(base, newest).unionByName(newest)

    def _newest(self, deltas: Relation) -> DataFrame:
        """One row per id of the deltas: that of the last one."""
        number = F.create_map(*[F.lit(x) for n, f in enumerate(deltas.folders)
                                for x in (f.load, n)])
        every = self.table.frame("deltas", deltas, deltas.folders, with_load=True)
        n = F.element_at(number, F.col("_load"))
        others = [c for c in FCT_EVENT_COLUMNS if c != "event_id"]
        # rows without id replace nothing and are not replaced
        return (every.withColumn("_n", n)
                .groupBy("event_id", F.when(F.col("event_id").isNull(), F.col("_n")).alias("_k"))
                .agg(F.max_by(F.struct(*others), "_n").alias("r"))
                .select("event_id", *[F.col(f"r.{c}").alias(c) for c in others])
                .select(*FCT_EVENT_COLUMNS))

    def high_water_mark(self) -> _dt.datetime | None:
        marks = [f.high for f in self.table.relations()["rows"].folders if f.high]
        return _dt.datetime.fromisoformat(max(marks)) if marks else None

    # ---- loads ------------------------------------------------------------------
    def load(self, users: DataFrame, events: DataFrame, mode: str = "strict",
             lookback_days: int = 3) -> DataFrame:
        """One incremental run (see ``incremental`` for the modes)."""
        checkpoint_root(self.spark)
        if not self.exists():
            return self._first(fct_user_events(users, first_batch(events, mode)))
        if self.table.relations()["deltas"].folders:
            self.compact()
        mark = None if mode == "keyed" else self.high_water_mark()
        batch = fct_user_events(users, select_batch(events, mark, mode, lookback_days))
        base = self.table.current()
        self.table.commit(self._merged(self.table.relations(base), batch), base)
        return self.read()

    def _first(self, full: DataFrame) -> DataFrame:
        schema = relation_schema(full.select(*FCT_EVENT_COLUMNS))
        folders = self.table.stage(_clustered(full), "rows", "event_date", "event_timestamp")
        written = self.table.frame("rows", Relation(schema), folders)
        relations = {
            "rows": Relation(schema, "event_date", folders),
            "ids": self._with_ids(None, written),
            "deltas": Relation(schema)}
        self.table.commit(relations, None)
        return self.read()

    def _merged(self, relations: dict[str, Relation], batch: DataFrame) -> dict[str, Relation]:
        """``relations`` with a batch (one row per id, or the strict mode's rows)
        that replaces the rows of its ids.  Nothing is switched yet."""
        rows = relations["rows"]
        batch = batch.checkpoint(eager=True)
        dates = {r[0] for r in batch.select("event_date").distinct().collect()}
        dates |= {r[0] for r in self.dates_of(relations["ids"], batch).collect()}
        touched = {_date_folder(d) for d in dates}              # no more than there are folders
        old = self.table.frame("rows", rows, [f for f in rows.folders if f.part in touched])
        kept = _without_ids(old, batch)
        staged = self.table.stage(_clustered(kept.unionByName(batch)), "rows", "event_date",
                                  "event_timestamp")
        return relations | {
            "rows": replace(rows, folders=[f for f in rows.folders if f.part not in touched]
                            + staged),
            "ids": self._with_ids(relations["ids"], batch)}

    # ---- the index of ids ---------------------------------------------------------
    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.where(F.col("event_id").isNotNull()).select(
            "event_id", "event_date",
            F.pmod(F.xxhash64("event_id"), F.lit(self.id_buckets)).cast("int").alias("bucket"))

    def _with_ids(self, ids: Relation | None, rows: DataFrame) -> Relation:
        entries = self._bucketed(rows).distinct()
        staged = self.table.stage(
            entries.repartition("bucket").sortWithinPartitions("bucket", "event_id"),
            "ids", "bucket")
        if ids is None:
            return Relation(relation_schema(entries), "bucket", staged)
        return replace(ids, folders=ids.folders + staged)

    def dates_of(self, ids: Relation, batch: DataFrame) -> DataFrame:
        """``event_date``: dates that may hold an id of ``batch``, from the buckets
        of its ids only."""
        mine = self._bucketed(batch).select("event_id", "bucket").distinct()
        wanted = {f"bucket={r[0]}" for r in mine.select("bucket").distinct().collect()}
        index = self.table.frame("ids", ids, [f for f in ids.folders if f.part in wanted])
        return join_dimension(index, mine.select("event_id"), "event_id", "left_semi") \
            .select("event_date").distinct()

    def compact_ids(self) -> None:
        """Rewrite the index without stale and repeated entries."""
        base = self.table.current()
        relations = self.table.relations(base)
        self.table.commit(relations | {"ids": self._with_ids(
            replace(relations["ids"], folders=[]), self.table.read("rows", base))}, base)

    # ---- micro-batches --------------------------------------------------------------
    def append(self, users: DataFrame, events: DataFrame, source: str, number: int) -> bool:
        """Add micro-batch ``number`` of ``source``; events replace those of the
        same id that came before.  False if it is there already."""
        if not self.exists():
            checkpoint_root(self.spark)
            self._first(fct_user_events(users, events.limit(0)))
        base = self.table.current()
        relations = self.table.relations(base)
        deltas = relations["deltas"]
        tag = json.dumps([source, number])
        if number <= _folded(deltas).get(source, -1) or any(f.tag == tag for f in deltas.folders):
            return False
        batch = fct_user_events(users, _dedupe_latest(events))
        staged = self.table.stage(batch, "deltas", None, "event_timestamp", tag)
        self.table.commit(relations | {"deltas": replace(
            deltas, folders=deltas.folders + staged)}, base)
        return True

    def compact(self) -> None:
        """Fold the deltas into the rows, as one load."""
        base = self.table.current()
        relations = self.table.relations(base)
        deltas = relations["deltas"]
        if not deltas.folders:
            return
        done = _folded(deltas)
        for f in deltas.folders:
            source, number = json.loads(f.tag)
            done[source] = max(done.get(source, -1), number)
        checkpoint_root(self.spark)
        merged = self._merged(relations, self._newest(deltas))
        self.table.commit(merged | {"deltas": replace(
            deltas, folders=[], note=json.dumps(done))}, base)

    def n_deltas(self) -> int:
        return len(self.table.relations()["deltas"].folders) if self.exists() else 0


def _folded(deltas: Relation) -> dict[str, int]:
    """Last micro-batch of each source that the rows hold."""
    return json.loads(deltas.note) if deltas.note else {}


def _without_ids(rows: DataFrame, batch: DataFrame) -> DataFrame:
    return join_dimension(rows, batch.select("event_id").distinct(), "event_id", "left_anti") \
        .select(*FCT_EVENT_COLUMNS)


def _clustered(rows: DataFrame) -> DataFrame:
    """Rows dealt out by ranges of time, so that a file holds a stretch of one or
    few dates and a busy date is spread over several tasks."""
    order = ["event_date", "event_timestamp", "event_id"]
    return rows.select(*FCT_EVENT_COLUMNS).repartitionByRange(*order).sortWithinPartitions(*order)
