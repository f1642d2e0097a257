"""Funnel milestones and activation score on hand-made rows."""

from helpers import by_key, events_df, subs_df, users_df
from tidemark.operators.engagement import activation_score, funnel_stages
from tidemark.operators.marts import dim_users, funnel_snapshot


def test_funnel_week2_bounds_and_stages(spark):
    users = users_df(spark, [("a", "2024-01-01 10:00:00"), ("b", "2024-01-01 10:00:00"),
                             ("c", "2024-01-01 10:00:00"), ("d", "2024-01-01 10:00:00"),
                             ("e", "2024-01-01 10:00:00")])
    events = events_df(spark, [
        ("1", "a", "task_created", "2024-01-08 10:00:00"),   # exactly +7d: in week 2
        ("2", "b", "task_created", "2024-01-15 10:00:00"),   # exactly +14d: out
        ("3", "b", "board_created", "2023-12-31 10:00:00"),  # before signup still counts
        ("4", "d", "member_invited", "2024-01-02 10:00:00"),
        ("9", "zz", "board_created", "2024-01-02 10:00:00"),  # unknown user: ignored
    ])
    subs = subs_df(spark, [("s1", "c", "pro", 29, "2024-02-01 00:00:00", None, "new")])
    f = by_key(funnel_stages(users, events, subs))
    assert f["a"]["max_funnel_stage"] == 4 and f["a"]["active_in_week_2_at"] is not None
    assert f["b"]["active_in_week_2_at"] is None and f["b"]["max_funnel_stage"] == 2
    assert f["c"]["max_funnel_stage"] == 5          # paid user without any event
    assert f["d"]["max_funnel_stage"] == 3
    assert f["e"]["max_funnel_stage"] == 1
    assert set(f) == {"a", "b", "c", "d", "e"}


def test_activation_tiers(spark):
    users = users_df(spark, [(u, "2024-01-10 00:00:00") for u in "pqrstu"])
    rows, n = [], 0

    def add(u, kind, when):
        nonlocal n
        n += 1
        rows.append((str(n), u, kind, when))

    # p: 3 invites, 5 tasks over 5 days, 1 board -> 20 + 40 + 20 + 20 = 100
    for i in range(3):
        add("p", "member_invited", f"2024-01-1{i} 09:00:00")
    for i in range(5):
        add("p", "task_created", f"2024-01-1{i} 10:00:00")
    add("p", "board_created", "2024-01-10 11:00:00")
    # q: 2 invites, 2 tasks on one date, events before signup count -> 30 + 10 = 40
    add("q", "member_invited", "2024-01-01 00:00:00")
    add("q", "member_invited", "2024-01-11 00:00:00")
    add("q", "task_created", "2024-01-11 01:00:00")
    add("q", "task_created", "2024-01-11 02:00:00")
    # r: 1 invite, 3 active days -> 15 + 10 = 25
    add("r", "member_invited", "2024-01-10 00:00:00")
    add("r", "comment_added", "2024-01-11 00:00:00")
    add("r", "comment_added", "2024-01-12 00:00:00")
    # s: activity only after week 1 (exactly +7d is outside)
    add("s", "member_invited", "2024-01-17 00:00:00")
    # t: 0 invites, 1 task
    add("t", "task_created", "2024-01-10 00:00:01")
    a = by_key(activation_score(users, events_df(spark, rows)))
    assert a["p"]["activation_score"] == 100 and a["p"]["is_activated"]
    assert a["p"]["active_days_week1"] == 5
    assert a["q"]["activation_score"] == 40 and a["q"]["is_activated"]
    assert a["q"]["active_days_week1"] == 2
    assert a["r"]["activation_score"] == 25 and not a["r"]["is_activated"]
    assert a["s"]["total_events_week1"] == 0 and a["s"]["activation_score"] == 0
    assert a["t"]["tasks_created_week1"] == 1 and a["t"]["activation_score"] == 0
    assert a["u"]["total_events_week1"] == 0 and a["u"]["is_activated"] is False


def test_snapshot_lags_and_dim_users_defaults(spark):
    users = users_df(spark, [("a", "2024-01-01 00:00:00"), ("b", "2024-01-03 00:00:00")])
    events = events_df(spark, [("1", "a", "board_created", "2024-01-02 06:00:00"),
                               ("2", "a", "member_invited", "2024-01-01 06:00:00")])
    subs = subs_df(spark, [("s1", "a", "pro", 29, "2024-01-03 00:00:00", None, "new")])
    snap = by_key(funnel_snapshot(users, events, subs))
    assert snap["a"]["hours_to_first_board"] == 30.0
    assert snap["a"]["hours_board_to_invite"] == -24.0     # may be negative
    assert snap["a"]["hours_to_conversion"] == 48.0
    assert snap["b"]["hours_to_first_board"] is None and snap["b"]["completed_board"] is False
    dim = by_key(dim_users(users, events, subs))
    assert dim["b"]["current_plan"] == "free" and float(dim["b"]["current_mrr"]) == 0.0
    assert dim["a"]["current_plan"] == "pro" and dim["a"]["lifecycle_stage"] == "converted"
    assert len(dim_users(users, events, subs).columns) == 22
    assert len(funnel_snapshot(users, events, subs).columns) == 20
