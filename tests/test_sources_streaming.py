"""Contracts, seeds, sinks, broadcast bound and the streaming operators."""

import pytest
from pyspark.sql import functions as F

from helpers import events_df, users_df
from tidemark.operators import incremental as I
from tidemark.operators.joins import fits_broadcast
from tidemark.session import scratch_path
from tidemark.sources import bindings as B
from tidemark.sources.contracts import cast_to_contract
from tidemark.sources.literals import dim_features, dim_plans
from tidemark.sources.seeds import scan_csv_seed
from tidemark.streaming import queries as SQ

from conftest import SF0001


def test_cast_to_contract_fails_on_bad_value(spark):
    good = spark.createDataFrame([("u1", 10, "2024-01-01 00:00:00", "a")],
                                 "usage_id string, user_id long, used_at string, "
                                 "feature_name string").withColumn("duration_seconds", F.lit("5"))
    out = cast_to_contract(good, "feature_usage")
    assert out.schema["user_id"].dataType.simpleString() == "string"
    assert out.first().duration_seconds == 5
    bad = good.withColumn("duration_seconds", F.lit("five"))
    with pytest.raises(Exception):
        cast_to_contract(bad, "feature_usage").collect()


def test_csv_seed(spark, tmp_path):
    p = tmp_path / "products.csv"
    p.write_text('sku,name,price,perishable,opened_at\n'
                 'JAF-001,"nutellaphone, who dis?",1100,True,2016-09-01T00:00:00\n'
                 'BEV-002,tangerine,600,false,2017-03-12T00:00:00\n')
    schema = "sku string, name string, price int, perishable boolean, opened_at timestamp_ntz"
    from pyspark.sql.types import _parse_datatype_string
    st = _parse_datatype_string(schema)
    rows = scan_csv_seed(spark, str(p), st).collect()
    assert rows[0].name == "nutellaphone, who dis?" and rows[0].perishable is True
    assert rows[1].perishable is False and rows[0].price == 1100
    p.write_text("sku,name,price,perishable,opened_at\nX,y,notanumber,True,2016-01-01T00:00:00\n")
    with pytest.raises(Exception):
        scan_csv_seed(spark, str(p), st).collect()


def test_literal_dimensions(spark):
    assert dim_plans(spark).count() == 3 and len(dim_plans(spark).columns) == 11
    assert dim_features(spark).count() == 15


def test_broadcast_bound(spark):
    df = spark.range(100)
    assert fits_broadcast(df, 100) and not fits_broadcast(df, 99)


def test_bindings_figures(spark):
    users = B.users(spark, SF0001)
    assert users.count() == 150
    subs = B.subscriptions(spark, SF0001)
    per_user = subs.groupBy("user_id", "started_at").count().filter("count > 1").count()
    assert per_user == 0          # started_at unique per user


def test_stream_replay_equals_batch(spark, tmp_path):
    """Events arriving as four ordered files, one per trigger, load to the
    same table as one full refresh."""
    users = users_df(spark, [("a", "2024-01-01 00:00:00"), ("b", "2024-01-02 00:00:00")])
    rows = [(str(i), "ab"[i % 2], "board_created" if i % 3 == 0 else "task_created",
             f"2024-01-{1 + i:02d} 10:00:00") for i in range(16)]
    src = str(tmp_path / "in")
    for k in range(4):
        events_df(spark, rows[4 * k:4 * k + 4]).coalesce(1).write.mode("append").parquet(src)
    schema = events_df(spark, rows[:1]).schema
    base = scratch_path(spark, "test_stream")
    SQ.event_fact_stream(SQ.read_stream(spark, src, schema, max_files_per_trigger=1), users,
                         f"{base}/t", f"{base}/c")
    got = SQ.read_result(spark, f"{base}/t", keyed=False)
    full = I.merge_events(None, users, events_df(spark, rows))
    assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in full.collect())

    SQ.funnel_snapshot_stream(SQ.read_stream(spark, src, schema, max_files_per_trigger=1), users,
                              f"{base}/s", f"{base}/sc")
    snap = {r.user_id: r for r in SQ.read_result(spark, f"{base}/s").collect()}
    assert str(snap["a"].created_first_board_at) == "2024-01-01 10:00:00"
    assert str(snap["b"].created_first_board_at) == "2024-01-04 10:00:00"
    assert str(snap["b"].active_in_week_2_at) == "2024-01-10 10:00:00"


def test_tables_from_paths_with_contracts(spark, tmp_path):
    from tidemark.sources.tables import Tables
    users = B.users(spark, SF0001)
    events = B.user_events(spark, SF0001)
    subs = B.subscriptions(spark, SF0001)
    paths = {}
    for name, df in (("users", users), ("user_events", events), ("subscriptions", subs)):
        paths[name] = str(tmp_path / name)
        df.write.parquet(paths[name])
    t = Tables.from_paths(spark, paths)
    assert t.users.schema["user_id"].dataType.simpleString() == "string"
    assert t.subscriptions.schema["mrr"].dataType.simpleString() == "decimal(10,2)"
    assert t.user_events.count() == events.count()
    from tidemark.operators.engagement import funnel_stages
    a = sorted((str(r.user_id), r.max_funnel_stage) for r in
               funnel_stages(users, events, subs).collect())
    b = sorted((r.user_id, r.max_funnel_stage) for r in
               funnel_stages(t.users, t.user_events, t.subscriptions).collect())
    assert a == b          # string ids and integer ids give the same funnel


def test_broadcast_bound_of_bytes_and_new_files(spark, tmp_path, monkeypatch):
    from tidemark.operators import joins
    wide = spark.range(50).selectExpr("id", "repeat('x', 1000) AS t")
    assert fits_broadcast(wide, 100)
    monkeypatch.setattr(joins, "DEFAULT_MAX_BROADCAST_BYTES", 20_000)
    assert not fits_broadcast(wide, 100) and fits_broadcast(wide.select("id"), 100)
    path = str(tmp_path / "dim")
    spark.range(50).write.parquet(path)
    assert fits_broadcast(spark.read.parquet(path), 60)
    spark.range(50).write.mode("append").parquet(path)
    assert not fits_broadcast(spark.read.parquet(path), 60)
