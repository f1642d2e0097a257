"""The snapshot kept up batch by batch, in batch and as a stream of two sources."""

import random

from helpers import events_df, subs_df, users_df
from tidemark.operators.engagement import event_rollup
from tidemark.operators.marts import funnel_snapshot
from tidemark.operators.user_state import UserStateTable
from tidemark.session import scratch_path
from tidemark.sources.versioned import VersionedTable
from tidemark.streaming import queries as SQ

KINDS = ("board_created", "member_invited", "task_created", "other", None)


def inputs(seed, n_users=12, n_events=200):
    rng = random.Random(seed)
    users = [(f"u{i}", f"2024-01-{rng.randrange(1, 8):02d} {rng.randrange(24):02d}:30:00")
             for i in range(n_users)]
    events = [(str(k), rng.choice([f"u{i}" for i in range(n_users + 2)] + ["u0"] * 6),
               rng.choice(KINDS),
               f"2024-01-{rng.randrange(1, 31):02d} {rng.randrange(24):02d}:{rng.randrange(60):02d}:00")
              for k in range(n_events)]
    return rng, users, events


def rows(df):
    return sorted(map(str, df.collect()))


def test_batches_in_any_order_equal_one_refresh(spark, tmp_path):
    rng, users, events = inputs(1)
    subs = subs_df(spark, [("s1", "u1", "pro", 29, "2024-01-09 00:00:00", None, "new")])
    state = UserStateTable(spark, str(tmp_path / "t"), buckets=4)
    whose = [rng.randrange(3) for _ in users]
    for k in range(3):
        some = users_df(spark, [u for u, w in zip(users, whose) if w == k] + users[:1])
        assert state.update(some, events_df(spark, events[k::3]), "s", k)
        assert not state.update(some, events_df(spark, events[k::3]), "s", k)
    every = users_df(spark, users)
    full = funnel_snapshot(every, events_df(spark, events), subs)
    assert rows(state.snapshot(every, subs)) == rows(full)
    assert rows(state.activity()) == rows(event_rollup(every, events_df(spark, events)))
    waiting = {r.user_id for r in state.table.read("waiting").collect()}
    assert waiting == {"u12", "u13"}                       # never signed up


def test_a_batch_reads_the_buckets_of_its_users_only(spark, tmp_path, monkeypatch):
    _, users, events = inputs(2)
    state = UserStateTable(spark, str(tmp_path / "t"), buckets=50)
    state.update(users_df(spark, users), events_df(spark, events), "s", 0)
    before = {(n, f.part): f.load for n, r in state.table.relations().items() for f in r.folders}
    seen = []
    frame = VersionedTable.frame

    def watched(self, relation, r, picked, **kw):
        seen.extend((relation, f.part) for f in picked)
        return frame(self, relation, r, picked, **kw)
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "frame", watched)
        state.update(users_df(spark, []), events_df(
            spark, [("x", "u3", "board_created", "2024-01-09 00:00:00")]), "s", 1)
    assert {p for _, p in seen} and len({p for _, p in seen}) == 1
    after = {(n, f.part): f.load for n, r in state.table.relations().items() for f in r.folders}
    assert {k for k in after if after[k] != before.get(k)} <= {(n, p) for n, p in after
                                                              if p == seen[0][1]}


def test_stream_of_signups_and_events(spark, tmp_path):
    rng, users, events = inputs(3)
    folders = {}
    for name, make, data, order in (("users", users_df, users, [1, 3, 0, 2]),
                                    ("events", events_df, events, [0, 2, 1, 3])):
        folders[name] = str(tmp_path / name)
        for k in order:                       # files arrive out of order, users late
            make(spark, data[k::4]).coalesce(1).write.mode("append").parquet(folders[name])
    base = scratch_path(spark, "two_streams")
    u, e = users_df(spark, users), events_df(spark, events)

    def run():
        SQ.funnel_snapshot_join_stream(
            SQ.read_stream(spark, folders["events"], e.schema, max_files_per_trigger=1),
            SQ.read_stream(spark, folders["users"], u.schema, max_files_per_trigger=1),
            f"{base}/t", f"{base}/c")
        return {r.user_id: tuple(r[1:4]) for r in SQ.read_result(spark, f"{base}/t").select(
            *SQ.SNAPSHOT_STREAM_COLUMNS).collect()}

    def expected(users, events):
        full = event_rollup(users, events)
        out = {r.user_id: (None, None, None) for r in users.collect()}
        out |= {r.user_id: (r.created_first_board_at, r.invited_first_member_at,
                            r.active_in_week_2_at) for r in full.collect()}
        return out
    assert run() == expected(u, e)
    # a second start of the stream: the user of events that waited, and new events
    more_u = users_df(spark, [("u12", "2024-01-02 00:00:00")])
    more_e = events_df(spark, [("n1", "u13", "board_created", "2024-01-01 00:00:00"),
                               ("n2", "u0", "board_created", "2023-12-01 00:00:00")])
    more_u.coalesce(1).write.mode("append").parquet(folders["users"])
    more_e.coalesce(1).write.mode("append").parquet(folders["events"])
    assert run() == expected(u.union(more_u), e.union(more_e))


def test_stream_state_is_kept_by_bucket(spark, tmp_path):
    """Users of a bucket are brought up to date by one call, each as if alone."""
    ids = [f"u{k}" for k in range(60)]
    late = ids[::2]
    folders = {n: str(tmp_path / n) for n in ("users", "events")}
    base = scratch_path(spark, "bucket_streams")

    def run(users, events):
        u, e = users_df(spark, users), events_df(spark, events)
        for name, df in (("users", u), ("events", e)):
            df.coalesce(1).write.mode("append").parquet(folders[name])
        q = SQ.funnel_snapshot_join_stream(
            SQ.read_stream(spark, folders["events"], e.schema),
            SQ.read_stream(spark, folders["users"], u.schema), f"{base}/t", f"{base}/c",
            buckets=4)
        rows = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress
                if p["stateOperators"]]
        assert rows and max(rows) <= 4
        return {r.user_id: r for r in SQ.read_result(spark, f"{base}/t").collect()}

    day = "2024-01-{:02d} 00:00:00".format
    got = run([(i, day(1)) for i in ids if i not in late],
              [(f"a{i}", i, "member_invited", day(9 + k % 3)) for k, i in enumerate(ids)]
              + [(f"b{i}", i, "x", day(1)) for i in ids])
    assert set(got) == set(ids) - set(late)
    # the others arrive; those of before are sent again and keep the first signup
    got = run([(i, day(1) if i in late else day(5)) for i in ids],
              [(f"c{i}", i, "board_created", day(8)) for i in ids])
    assert {(i, str(r.created_first_board_at), str(r.invited_first_member_at),
             str(r.active_in_week_2_at)) for i, r in got.items()} == {
        (i, day(8), day(9 + k % 3), day(8)) for k, i in enumerate(ids)}
