"""Incremental loads (lazy merge and the Parquet write path) and data tests."""

from pyspark.sql import functions as F

from helpers import events_df, users_df
from tidemark.operators import incremental as I
from tidemark.operators import quality as Q
from tidemark.operators.event_table import EventTable


def _ids(df):
    return sorted(r.event_id for r in df.select("event_id").collect())


def _users(spark):
    return users_df(spark, [("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:00:00")])


def test_strict_merge_semantics(spark):
    users = _users(spark)
    first = I.merge_events(None, users, events_df(spark, [
        ("1", "a", "x", "2024-01-05 00:00:00"), ("2", "a", "x", "2024-01-06 00:00:00")]))
    batch = events_df(spark, [
        ("3", "a", "x", "2024-01-04 00:00:00"),   # late: skipped
        ("4", "b", "x", "2024-01-06 00:00:00"),   # tie with the maximum: skipped
        ("1", "a", "y", "2024-01-09 00:00:00"),   # re-sent id, newer, other date: replaces
        ("5", "b", "x", "2024-01-07 00:00:00"),
        ("5", "b", "x", "2024-01-07 00:00:00"),   # duplicate in one batch: both stay
    ])
    out = I.merge_events(first, users, batch, "strict")
    assert _ids(out) == ["1", "2", "5", "5"]
    moved = out.filter("event_id = '1'").first()
    assert moved.event_type == "y" and str(moved.event_date) == "2024-01-09"


def test_lookback_merge_semantics(spark):
    users = _users(spark)
    first = I.merge_events(None, users, events_df(spark, [
        ("1", "a", "x", "2024-01-05 00:00:00"), ("2", "a", "x", "2024-01-06 00:00:00")]))
    batch = events_df(spark, [
        ("3", "a", "x", "2024-01-04 00:00:00"),   # late but within 3 days: loads
        ("4", "b", "x", "2024-01-02 00:00:00"),   # too late: skipped
        ("5", "b", "x", "2024-01-07 00:00:00"),
        ("5", "b", "z", "2024-01-08 00:00:00"),   # duplicate: latest wins
    ])
    out = I.merge_events(first, users, batch, "lookback", 3)
    assert _ids(out) == ["1", "2", "3", "5"]
    assert out.filter("event_id = '5'").first().event_type == "z"


def test_empty_target_strict_loads_nothing(spark):
    users = _users(spark)
    empty = I.merge_events(None, users, events_df(spark, [
        ("1", "a", "x", "2024-01-05 00:00:00")])).filter(F.lit(False))
    batch = events_df(spark, [("2", "a", "x", "2024-01-09 00:00:00")])
    assert _ids(I.merge_events(empty, users, batch, "strict")) == []
    assert _ids(I.merge_events(empty, users, batch, "lookback")) == ["2"]


def test_load_events_write_path(spark, tmp_table):
    users = _users(spark)
    t = I.load_events(spark, tmp_table, users, events_df(spark, [
        ("1", "a", "x", "2024-01-05 00:00:00"), ("2", "a", "x", "2024-01-06 00:00:00")]))
    assert _ids(t) == ["1", "2"]
    # id 1 moves from 2024-01-05 to 2024-01-09: its old partition becomes empty
    t = I.load_events(spark, tmp_table, users, events_df(spark, [
        ("1", "a", "y", "2024-01-09 00:00:00"), ("3", "b", "x", "2024-01-06 00:00:01")]))
    assert _ids(t) == ["1", "2", "3"]
    assert t.filter("event_id = '1'").first().event_type == "y"
    # ordinary run: only the touched partition is rewritten
    t = I.load_events(spark, tmp_table, users, events_df(spark, [
        ("4", "b", "x", "2024-01-10 00:00:00")]))
    assert _ids(t) == ["1", "2", "3", "4"]


def test_replay_in_batches_equals_full_refresh(spark, tmp_table):
    users = _users(spark)
    rows = [(str(i), "ab"[i % 2], "x", f"2024-01-{1 + i:02d} 0{i % 9}:00:00") for i in range(12)]
    for k in range(0, 12, 4):
        I.load_events(spark, tmp_table, users, events_df(spark, rows[k:k + 4]))
    full = I.merge_events(None, users, events_df(spark, rows))
    got = EventTable(spark, tmp_table).read()
    cols = ["event_id", "event_timestamp", "region"]
    assert sorted(map(tuple, got.select(*cols).collect())) == \
        sorted(map(tuple, full.select(*cols).collect()))


def test_generic_tests(spark):
    df = spark.createDataFrame([("1", "a", "US"), ("1", "b", "XX"), (None, None, None),
                                ("2", "c", "XX")], "k string, v string, region string")
    assert Q.not_null(df, "k").count() == 1
    dup = Q.unique(df, "k").collect()
    assert [(r.k, r.n_records) for r in dup] == [("1", 2)]           # NULL key ignored
    bad = {r.value_field: r.n_records for r in Q.accepted_values(df, "region", ["US"]).collect()}
    assert bad == {"XX": 2}                                           # NULL passes
    parent = spark.createDataFrame([("1",)], "k string")
    assert sorted(r.k for r in Q.relationships(df, "k", parent, "k").collect()) == ["2"]
    suite = {r.test_name: (r.violations, r.passed) for r in Q.run_suite(
        [("nn", Q.not_null(df, "k")), ("ok", Q.not_null(df.filter("k = '2'"), "k"))]).collect()}
    assert suite == {"nn": (1, False), "ok": (0, True)}


def test_retention_boolean_null_passes(spark):
    flags = spark.createDataFrame([("a", 1, 1), ("a", 7, None), ("a", 14, 2)],
                                  "user_id string, retention_day int, is_retained int")
    assert [r.is_retained for r in Q.retention_boolean(flags).collect()] == [2]


def test_count_checks_share_passes(spark):
    """Each generic check counts as its own frame would; names without rows pass."""
    schema = "k string, n int, v string"
    child = spark.createDataFrame([("1", 1, "x"), ("2", 1, "y"), ("2", None, "y"),
                                   (None, 2, None), ("3", 3, "z")], schema)
    parent = spark.createDataFrame([("1",), ("1",), (None,)], "k string")
    checks = [Q.Check("rel", "child", "relationships", "k", parent="parent", parent_column="k"),
              Q.Check("rel_self", "parent", "relationships", "k", parent="parent",
                      parent_column="k"),
              Q.Check("uq_k", "child", "unique", "k"), Q.Check("uq_n", "child", "unique", "n"),
              Q.Check("uq_v", "child", "unique", "v"),
              Q.Check("nn_k", "child", "not_null", "k"), Q.Check("nn_n", "child", "not_null", "n"),
              Q.Check("in_v", "child", "accepted_values", "v", values=("x",)),
              Q.Check("uq_p", "parent", "unique", "k")]
    names = [c.name for c in checks]

    def counts(c, p):
        rows = Q.run_suite([], Q.count_checks(checks, {"child": c, "parent": p}), names)
        return {r.test_name: r.violations for r in rows.collect()}
    assert counts(child, parent) == {"rel": 3, "rel_self": 0, "uq_k": 1, "uq_n": 1, "uq_v": 1,
                                     "nn_k": 1, "nn_n": 1, "in_v": 2, "uq_p": 1}
    assert counts(child.limit(0), parent.limit(0)) == dict.fromkeys(names, 0)

