"""The versioned event table: what a killed job leaves, what a load reads, deltas."""

import random

import pytest

from helpers import events_df, users_df
from tidemark.operators import incremental as I
from tidemark.operators.event_table import EventTable
from tidemark.sources import files
from tidemark.sources.sinks import read_table, sink_table
from tidemark.sources.versioned import VersionConflict, VersionedTable


def users(spark):
    return users_df(spark, [("a", "2024-01-01"), ("b", "2024-01-02")])


def rows_of(df):
    return sorted((r.event_id or "", r.user_id, r.event_type, str(r.event_timestamp))
                  for r in df.collect())


def days(spark, n, per_day=4, start=1):
    return events_df(spark, [(f"{d}-{k}", "ab"[k % 2], "x", f"2024-01-{d:02d} 0{k}:00:00")
                             for d in range(start, start + n) for k in range(per_day)])


def killed(monkeypatch, where):
    def stop(*args, **kwargs):
        raise KeyboardInterrupt("killed")
    monkeypatch.setattr(*where, stop)


@pytest.mark.parametrize("where", [(files, "replace_text"), (VersionedTable, "commit"),
                                   (EventTable, "_with_ids")])
def test_a_killed_load_leaves_the_old_table(spark, tmp_table, monkeypatch, where):
    t = EventTable(spark, tmp_table)
    t.load(users(spark), days(spark, 5))
    before = rows_of(t.read())
    moved = events_df(spark, [(f"3-{k}", "a", "y", f"2024-01-09 0{k}:00:00") for k in range(4)])
    with monkeypatch.context() as m:
        killed(m, where)
        with pytest.raises(KeyboardInterrupt):
            t.load(users(spark), moved, "keyed")
    assert rows_of(EventTable(spark, tmp_table).read()) == before
    # the next run is whole, and what the killed one wrote can be cleared away
    t.load(users(spark), moved, "keyed")
    after = rows_of(t.read())
    assert len(after) == 20 and sum(r[2] == "y" for r in after) == 4
    t.table.vacuum(keep=1)
    assert rows_of(EventTable(spark, tmp_table).read()) == after


def test_a_killed_refresh_leaves_the_old_table(spark, tmp_table, monkeypatch):
    sink_table(spark.range(5), tmp_table)
    with monkeypatch.context() as m:
        killed(m, (files, "replace_text"))
        with pytest.raises(KeyboardInterrupt):
            sink_table(spark.range(9), tmp_table)
    assert read_table(spark, tmp_table).count() == 5
    old = read_table(spark, tmp_table)
    assert sink_table(spark.range(7), tmp_table).count() == 7
    assert old.count() == 5                       # a reader keeps the version it planned with
    for n in range(4):
        sink_table(spark.range(n).withColumnRenamed("id", f"c{n}"), tmp_table)
    assert read_table(spark, tmp_table).columns == ["c3"]
    assert len(files.names(spark, f"{tmp_table}/versions")) == 2
    assert sink_table(spark.range(0), tmp_table).count() == 0


def test_partitioned_refresh_with_null_and_odd_values(spark, tmp_table):
    df = spark.createDataFrame([(1, "x/y=z"), (2, None), (3, "a b"), (4, "")], "i int, p string")
    got = {r.i: r.p for r in sink_table(df, tmp_table, "p").collect()}
    assert got == {1: "x/y=z", 2: None, 3: "a b", 4: None}     # as Spark's own partitions


def test_two_writers(spark, tmp_table):
    t = VersionedTable(spark, tmp_table)
    t.replace(spark.range(3))
    base = t.current()
    mine = t.relations(base)
    t.replace(spark.range(4))
    with pytest.raises(VersionConflict):
        t.commit(mine, base)
    assert t.read().count() == 4


def test_emptied_dates_leave_the_version(spark, tmp_table):
    t = EventTable(spark, tmp_table)
    t.load(users(spark), days(spark, 3))
    t.load(users(spark), events_df(spark, [(f"2-{k}", "a", "y", "2024-01-20 00:00:00")
                                           for k in range(4)]))
    folders = t.table.relations()["rows"].folders
    assert [f.part for f in sorted(folders, key=lambda f: f.part)] == [
        f"event_date=2024-01-{d}" for d in ("01", "03", "20")]
    assert sum(f.rows for f in folders) == 12


def test_a_small_load_reads_its_dates_and_buckets_only(spark, tmp_table, monkeypatch):
    t = EventTable(spark, tmp_table, id_buckets=64)
    t.load(users(spark), days(spark, 20))
    untouched = {f.part: f.load for f in t.table.relations()["rows"].folders}
    seen = []
    frame = VersionedTable.frame

    def watched(self, relation, r, picked, **kw):
        seen.append((relation, [f.part for f in picked], len(r.folders)))
        return frame(self, relation, r, picked, **kw)
    monkeypatch.setattr(VersionedTable, "frame", watched)
    # id 4-1 moves from the 4th to the 9th; a new id comes on the 11th
    t.load(users(spark), events_df(spark, [("4-1", "a", "y", "2024-01-09 00:30:00"),
                                           ("new", "b", "y", "2024-01-11 00:30:00")]), "keyed")
    (ids,) = [s for s in seen if s[0] == "ids"]
    assert len(ids[1]) <= 2 < ids[2]
    assert seen[1][0] == "rows" and sorted(seen[1][1]) == [
        f"event_date=2024-01-{d}" for d in ("04", "09", "11")]
    now = {f.part: f.load for f in t.table.relations()["rows"].folders}
    assert {p for p in now if now[p] != untouched[p]} == set(seen[1][1])
    monkeypatch.undo()
    assert len(rows_of(t.read())) == 81


def test_reads_of_a_time_range_list_its_folders_only(spark, tmp_table):
    t = EventTable(spark, tmp_table)
    t.load(users(spark), days(spark, 20))
    some = t.read(("2024-01-05 00:00:00", "2024-01-07 01:00:00"))
    assert {f.split("event_date=")[1][:10] for f in some.inputFiles()} == {
        "2024-01-05", "2024-01-06", "2024-01-07"}
    assert t.high_water_mark().isoformat() == "2024-01-20T03:00:00"


def test_appends_cost_no_read_and_replays_change_nothing(spark, tmp_table, monkeypatch):
    t = EventTable(spark, tmp_table)
    t.load(users(spark), days(spark, 5))
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "frame", lambda *a, **k: pytest.fail("the table was read"))
        late = events_df(spark, [("1-1", "a", "late", "2023-12-01 00:00:00"),
                                 ("n", "a", "1st", "2024-01-03 00:00:00")])
        assert t.append(users(spark), late, "s", 0)
        assert not t.append(users(spark), late, "s", 0)
        again = events_df(spark, [("n", "a", "2nd", "2024-01-02 00:00:00"),
                                  ("n", "a", "old", "2024-01-01 00:00:00")])
        assert t.append(users(spark), again, "s", 1)
        assert t.append(users(spark), again.limit(0), "other", 0)
    before = rows_of(t.read())
    assert ("1-1", "a", "late", "2023-12-01 00:00:00") in before
    assert [r[2] for r in before if r[0] == "n"] == ["2nd"] and len(before) == 21
    t.compact()
    assert t.n_deltas() == 0 and rows_of(t.read()) == before
    assert not t.append(users(spark), again, "s", 1)              # folded in already
    t.compact_ids()
    assert rows_of(t.read()) == before
    ids = t.table.read("ids")
    assert ids.count() == 21 == ids.select("event_id").distinct().count()


def test_batches_in_any_mode_equal_the_lazy_merge(spark, tmp_path):
    rng = random.Random(3)
    for mode in ("strict", "lookback", "keyed"):
        t = EventTable(spark, str(tmp_path / mode), id_buckets=8)
        lazy = None
        for k in range(3):
            batch = events_df(spark, [
                (rng.choice([None, *map(str, range(40))]) if mode == "strict" else
                 str(rng.randrange(40)), "ab"[k % 2], f"{mode}{k}",
                 f"2024-01-{rng.randrange(1, 25):02d} {rng.randrange(24):02d}:00:{n:02d}")
                for n in range(25)])
            got = t.load(users(spark), batch, mode)
            merged = I.merge_events(lazy, users(spark), batch, mode)
            assert rows_of(got) == rows_of(merged), (mode, k)
            lazy = spark.createDataFrame(merged.collect(), merged.schema)
