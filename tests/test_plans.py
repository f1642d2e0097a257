"""The plans keep the properties the design relies on: pruned scans, a
size-checked broadcast of users, filters pushed into the Parquet scan."""

import __spark_entry__ as entry
from conftest import SF0001


def _plan(df, capsys):
    df.explain("formatted")
    return capsys.readouterr().out


def test_events_scan_is_pruned_and_users_broadcast(spark, capsys):
    plan = _plan(entry.queries()["funnel_by_region"](spark, SF0001), capsys)
    events_scans = [b for b in plan.split("\n\n") if "events.parquet" in b and "ReadSchema" in b]
    assert events_scans and all("props" not in b for b in events_scans)
    assert "BroadcastHashJoin" in plan


def test_activity_filter_reaches_the_scan(spark, capsys):
    plan = _plan(entry.queries()["kpi_dau_wau_mau"](spark, SF0001), capsys)
    assert "GreaterThanOrEqual(ts," in plan


def test_high_water_mark_reaches_the_scan(spark, capsys):
    plan = _plan(entry.queries()["fct_user_events_incremental"](spark, SF0001), capsys)
    assert "GreaterThan(ts," in plan
