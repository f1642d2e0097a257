"""Streams over several files that each span the whole time range, and over folders."""

import shutil

import pytest

from helpers import events_df, users_df
from tidemark.operators import incremental as I
from tidemark.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def test_streams_over_folders_of_interleaved_files(spark, tmp_path):
    for t in ("events", "customer"):
        (spark.read.parquet(f"{SF}/{t}.parquet").repartition(4)
         .write.parquet(f"{tmp_path}/{t}.parquet"))
    for t in ("nation", "region", "orders", "supplier"):
        shutil.copy(f"{SF}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    for key in ("stream_user_events", "stream_weekly_signups", "stream_funnel_snapshot"):
        one = sorted(map(tuple, QUERIES[key](spark, SF).collect()), key=str)
        many = sorted(map(tuple, QUERIES[key](spark, str(tmp_path)).collect()), key=str)
        assert one == many, key


def test_keyed_load_keeps_late_rows_and_one_row_per_id(spark, tmp_table):
    users = users_df(spark, [("u", "2024-01-01")])
    I.load_events(spark, tmp_table, users, events_df(spark, [
        ("a", "u", "x", "2024-02-02T00:00:00"), ("a", "u", "x", "2024-02-03T00:00:00")]), "keyed")
    t = I.load_events(spark, tmp_table, users, events_df(spark, [
        ("b", "u", "x", "2024-01-05T00:00:00"), ("a", "u", "y", "2024-02-03T00:00:00")]), "keyed")
    got = {r.event_id: (r.event_type, str(r.event_date)) for r in t.collect()}
    assert t.count() == 2
    assert got == {"a": ("y", "2024-02-03"), "b": ("x", "2024-01-05")}


def test_damaged_table_is_not_replaced(spark, tmp_path):
    path = tmp_path / "table" / "event_date=2024-01-01"
    path.mkdir(parents=True)
    (path / "part-0.parquet").write_bytes(b"PAR1 cut off")
    users = users_df(spark, [("u", "2024-01-01")])
    with pytest.raises(Exception):
        I.load_events(spark, str(tmp_path / "table"), users, events_df(spark, [
            ("a", "u", "x", "2024-02-02T00:00:00")]), "keyed")
    assert (path / "part-0.parquet").read_bytes() == b"PAR1 cut off"
