"""Random small inputs against a plain-Python brute force (no SQL engine):
funnel stage, week-1 counts, activation score and retention flags."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from helpers import events_df, subs_df, users_df
from tidemark.operators.engagement import user_journey
from tidemark.operators.retention import WINDOWS, retention_flags

BASE = dt.datetime(2024, 1, 1)
TYPES = ["board_created", "member_invited", "task_created", "comment_added"]


def brute(users, events, subs):
    out = {}
    for uid, signup in users:
        evs = [(t, ts) for _, u, t, ts in events if u == uid]
        w1 = [(t, ts) for t, ts in evs if ts < signup + dt.timedelta(days=7)]
        w2 = [ts for _, ts in evs
              if signup + dt.timedelta(days=7) <= ts < signup + dt.timedelta(days=14)]
        board = min([ts for t, ts in evs if t == "board_created"], default=None)
        invite = min([ts for t, ts in evs if t == "member_invited"], default=None)
        paid = min([s for _, u, p, _, s, _, _ in subs if u == uid and p in ("pro", "enterprise")],
                   default=None)
        stage = 5 if paid else 4 if w2 else 3 if invite else 2 if board else 1
        b = sum(t == "board_created" for t, _ in w1)
        i = sum(t == "member_invited" for t, _ in w1)
        k = sum(t == "task_created" for t, _ in w1)
        days = len({ts.date() for _, ts in w1})
        score = ((20 if b >= 1 else 0) + (40 if i >= 3 else 30 if i >= 2 else 15 if i >= 1 else 0)
                 + (20 if k >= 5 else 10 if k >= 2 else 0) + (20 if days >= 5 else 10 if days >= 3 else 0))
        flags = {}
        for day, lo, hi in WINDOWS:
            flags[day] = int(any(lo * 86400 <= (ts - signup).total_seconds() < hi * 86400
                                 for _, ts in evs))
        out[uid] = (stage, b, i, k, len(w1), days, min(100, score), i >= 2, flags)
    return out


event = st.tuples(st.integers(0, 5), st.sampled_from(TYPES), st.integers(-3 * 86400, 100 * 86400))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(evs=st.lists(event, max_size=40), signup_offsets=st.lists(st.integers(0, 5 * 86400),
                                                                  min_size=6, max_size=6),
       paid_user=st.integers(0, 6))
def test_journey_and_retention_match_brute_force(spark, evs, signup_offsets, paid_user):
    users = [(f"u{n}", BASE + dt.timedelta(seconds=o)) for n, o in enumerate(signup_offsets)]
    signup = dict(users)
    events = [(str(n), f"u{u}", t, signup[f"u{u}"] + dt.timedelta(seconds=s))
              for n, (u, t, s) in enumerate(evs)]
    subs = [("s1", f"u{paid_user}", "pro", 29, BASE + dt.timedelta(days=3), None, "new")]
    expect = brute(users, events, subs)

    udf = users_df(spark, [(u, s.isoformat(sep=" ")) for u, s in users])
    edf = events_df(spark, [(e, u, t, ts.isoformat(sep=" ")) for e, u, t, ts in events])
    sdf = subs_df(spark, [(i, u, p, m, s.isoformat(sep=" "), e, c)
                          for i, u, p, m, s, e, c in subs])
    j = {r.user_id: r for r in user_journey(udf, edf, sdf).collect()}
    flags = {}
    for r in retention_flags(udf, edf, sdf).collect():
        flags.setdefault(r.user_id, {})[r.retention_day] = r.is_retained
    for uid, (stage, b, i, k, n, days, score, act, fl) in expect.items():
        r = j[uid]
        assert (r.max_funnel_stage, r.boards_created_week1, r.members_invited_week1,
                r.tasks_created_week1, r.total_events_week1, r.active_days_week1,
                r.activation_score, r.is_activated) == (stage, b, i, k, n, days, score, act), uid
        assert flags[uid] == fl, uid
