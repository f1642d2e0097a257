"""MRR waterfall, current plan and retention flags on hand-made rows."""

import datetime as dt

from helpers import by_key, events_df, subs_df, users_df
from tidemark.operators.retention import retention_flags
from tidemark.operators.revenue import current_plan, mrr_waterfall, mrr_waterfall_delta


def _months(df):
    return {r["report_month"]: r.asDict() for r in df.collect()}


def test_waterfall_reference_rule(spark):
    subs = subs_df(spark, [
        # u1: free new (dropped), pro expansion in Feb, churn in Apr
        ("1", "u1", "free", 0, "2024-01-05 00:00:00", "2024-02-10 00:00:00", "new"),
        ("2", "u1", "pro", 29, "2024-02-10 00:00:00", "2024-04-01 00:00:00", "expansion"),
        ("3", "u1", "free", 0, "2024-04-01 00:00:00", None, "churn"),
        # u2: paid new in Jan; NULL change_type on paid plan stays (adds nothing)
        ("4", "u2", "enterprise", 99, "2024-01-20 00:00:00", None, "new"),
        ("5", "u3", "pro", 29, "2024-03-03 00:00:00", None, None),
        ("6", "u4", "free", 0, "2024-03-03 00:00:00", None, None),
        # churn without predecessor -> 0; change outside the spine vanishes
        ("7", "u5", "free", 0, "2024-03-09 00:00:00", None, "churn"),
        ("8", "u6", "pro", 29, "2023-06-01 00:00:00", None, "new"),
    ])
    m = _months(mrr_waterfall(subs, "2024-01-01", "2024-05-01"))
    jan, feb, mar, apr, may = (m[dt.date(2024, k, 1)] for k in range(1, 6))
    assert float(jan["new_mrr"]) == 99 and float(feb["expansion_mrr"]) == 29
    assert float(apr["churn_mrr"]) == 29 and float(mar["churn_mrr"]) == 0
    assert float(may["net_new_mrr"]) == 0                    # month without change kept
    assert float(may["ending_mrr"]) == 99
    assert all(float(r["contraction_mrr"]) == 0 for r in m.values())
    assert len(m) == 5


def test_waterfall_zero_length_and_two_predecessors(spark):
    subs = subs_df(spark, [
        # zero-length churn row matches itself (ended_at = started_at)
        ("1", "u1", "pro", 29, "2024-01-01 00:00:00", "2024-02-01 00:00:00", "new"),
        ("2", "u1", "free", 0, "2024-02-01 00:00:00", "2024-02-01 00:00:00", "churn"),
        # two predecessors ended at the same instant: greatest (start, id) wins
        ("3", "u2", "pro", 29, "2024-01-01 00:00:00", "2024-03-01 00:00:00", "new"),
        ("4", "u2", "enterprise", 99, "2024-01-02 00:00:00", "2024-03-01 00:00:00",
         "expansion"),
        ("5", "u2", "free", 0, "2024-03-01 00:00:00", None, "churn"),
    ])
    m = _months(mrr_waterfall(subs, "2024-01-01", "2024-03-01"))
    # the zero-length row is its own latest predecessor (mrr 0), as a
    # "limit 1" lookup may also pick
    assert float(m[dt.date(2024, 2, 1)]["churn_mrr"]) == 0
    assert float(m[dt.date(2024, 3, 1)]["churn_mrr"]) == 99


def test_waterfall_delta_ends_at_active_mrr(spark):
    subs = subs_df(spark, [
        ("1", "u1", "pro", 29, "2024-01-01 00:00:00", "2024-02-01 00:00:00", "new"),
        ("2", "u1", "enterprise", 99, "2024-02-01 00:00:00", "2024-03-01 00:00:00", "x"),
        ("3", "u1", "pro", 29, "2024-03-01 00:00:00", None, "x"),
        ("4", "u2", "pro", 29, "2024-01-15 00:00:00", "2024-02-15 00:00:00", "new"),
    ])
    m = _months(mrr_waterfall_delta(subs, "2024-01-01", "2024-04-01"))
    assert float(m[dt.date(2024, 2, 1)]["expansion_mrr"]) == 70
    assert float(m[dt.date(2024, 2, 1)]["churn_mrr"]) == 29    # u2 ends with no successor
    assert float(m[dt.date(2024, 3, 1)]["contraction_mrr"]) == 70
    assert float(m[dt.date(2024, 4, 1)]["ending_mrr"]) == 29


def test_current_plan_ties_and_nulls(spark):
    subs = subs_df(spark, [
        ("1", "a", "pro", 29, "2024-01-01 00:00:00", None, "new"),
        ("2", "a", "enterprise", 99, "2024-01-01 00:00:00", None, "new"),  # tie: greater id
        ("3", "b", "pro", 29, "2024-05-01 00:00:00", None, "new"),
        ("4", "b", "free", 0, None, None, "new"),                         # NULL start wins
    ])
    cp = by_key(current_plan(subs))
    assert cp["a"]["current_plan"] == "enterprise"
    assert cp["b"]["current_plan"] == "free"


def test_retention_windows(spark):
    users = users_df(spark, [("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:00:00"),
                             ("c", "2024-01-01 00:00:00")])
    events = events_df(spark, [
        ("1", "a", "x", "2024-01-02 00:00:00"),   # day 1.0 -> window 1
        ("2", "a", "x", "2024-01-08 12:00:00"),   # day 7.5 -> windows 1 and 7
        ("3", "a", "x", "2024-04-07 00:00:00"),   # day 97.0 -> no window (hi is open)
        ("4", "b", "x", "2024-01-09 00:00:00"),   # day 8 -> window 7 only
        ("5", "b", "x", "2024-01-15 00:00:00"),   # day 14 -> window 14
        ("6", "b", "x", "2024-04-06 23:59:59"),   # just under 97 -> window 90
    ])
    subs = subs_df(spark, [("s", "a", "pro", 29, "2024-01-01 00:00:00", None, "new")])
    f = {(r.user_id, r.retention_day): r.is_retained
         for r in retention_flags(users, events, subs).collect()}
    assert len(f) == 18
    assert f[("a", 1)] == 1 and f[("a", 7)] == 1 and f[("a", 90)] == 0
    assert f[("b", 1)] == 0 and f[("b", 7)] == 1 and f[("b", 14)] == 1 and f[("b", 90)] == 1
    assert all(f[("c", d)] == 0 for d in (1, 7, 14, 30, 60, 90))
    plans = {r.user_id: r.plan_at_latest for r in retention_flags(users, events, subs).collect()}
    assert plans == {"a": "pro", "b": "free", "c": "free"}
    elig = {(r.user_id, r.retention_day): r.eligible
            for r in retention_flags(users, events, subs, as_of="2024-01-22").collect()}
    assert elig[("a", 14)] is True and elig[("a", 30)] is False


def test_waterfalls_ties_nulls_and_repeats(spark):
    """Several rows starting and ending at one instant, a row without user,
    open starts and repeated rows, against a row-by-row brute force."""
    jan, feb, mar = "2024-01-05T00:00:00", "2024-02-05T00:00:00", "2024-03-05T00:00:00"
    rows = [("a1", "a", "pro", 29, jan, feb, "new"),
            ("a2", "a", "enterprise", 99, jan, feb, "new"),          # a2 wins the tie
            ("a3", "a", "free", 0, feb, mar, "churn"),
            ("a4", "a", "free", 0, feb, None, "churn"),              # churns twice at once
            ("a5", "a", "pro", 29, feb, mar, "contraction"),
            ("b1", "b", "pro", 29, jan, mar, "new"),                 # nothing follows
            ("c1", None, "pro", 29, jan, feb, "new"),
            ("c2", None, "free", 0, feb, None, "churn"),             # no user: meets nothing
            ("d1", "d", "pro", None, jan, feb, "new"),
            ("d2", "d", "pro", 29, feb, None, "expansion"),
            ("d2", "d", "pro", 29, feb, None, "expansion"),
            ("e1", "e", "free", 0, None, feb, "churn")]

    def prev(user, at):
        ended = [r for r in rows if user is not None and r[1] == user and r[5] == at and at]
        return (max(ended, key=lambda r: (r[4] or "", r[0]))[3] or 0) if ended else 0

    def month(at):
        return at[:7] if at else None
    rule = {m: [0, 0, 0, 0] for m in ("2024-01", "2024-02", "2024-03", None)}
    delta = {m: [0, 0, 0, 0] for m in rule}
    for _, user, plan, mrr, start, end, change in rows:
        before, mrr, m = prev(user, start), mrr or 0, month(start)
        rule[m][0] += mrr if change == "new" and plan != "free" else 0
        rule[m][1] += mrr if change == "expansion" else 0
        rule[m][3] += before if change == "churn" else 0
        delta[m][0] += mrr if before == 0 else 0
        delta[m][1] += max(mrr - before, 0) if before else 0
        delta[m][2] += max(before - mrr, 0) if before and mrr else 0
        delta[m][3] += before if mrr == 0 else 0
        if end and not any(user is not None and r[1] == user and r[4] == end for r in rows):
            delta[month(end)][3] += mrr
    for build, want in ((mrr_waterfall, rule), (mrr_waterfall_delta, delta)):
        df = build(subs_df(spark, rows), "2024-01-01", "2024-03-01")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= 3 and "SortMergeJoin" not in plan
        got = {str(r.report_month)[:7]: [int(x) for x in r[1:5]] for r in df.collect()}
        assert got == {m: v for m, v in want.items() if m}, build.__name__
        assert dict(df.dtypes)["churn_mrr"] == "decimal(20,2)"


def test_waterfall_months_of_the_data(spark):
    """Bounds of None: the months in which subscriptions start or end."""
    from tidemark.operators import revenue as RV
    subs = subs_df(spark, [
        ("1", "a", "pro", 29, "2019-05-20 00:00:00", "2035-02-03 00:00:00", "new"),
        ("2", "b", "enterprise", 99, "2024-01-05 00:00:00", None, "new")])
    for form in (RV.mrr_waterfall, RV.mrr_waterfall_delta):
        rows = form(subs, None, None).orderBy("report_month").collect()
        assert str(rows[0].report_month) == "2019-05-01" and rows[0].new_mrr == 29
        assert str(rows[-1].report_month) == "2035-02-01" and len(rows) == 190
        assert sum(r.new_mrr for r in rows) == 128
        assert form(subs.limit(0), None, None).count() == 0
        some = form(subs, "2024-01-01", None).orderBy("report_month").collect()
        assert str(some[0].report_month) == "2024-01-01" and len(some) == 134
    assert rows[-1].churn_mrr == 29 and rows[-1].ending_mrr == 99
