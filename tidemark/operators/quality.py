"""Data-quality tests.  Each returns the violating rows; empty means pass.

Generic tests (not_null, unique, accepted_values, relationships) take any
frame; the singular tests take the marts they check.  ``count_checks`` shares
passes between tests, ``run_suite`` reduces all of them to one row each
(name, violations, passed) in a single job.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import join_dimension


def not_null(df: DataFrame, *cols: str) -> DataFrame:
    cond = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
    return df.filter(cond)


def unique(df: DataFrame, *cols: str) -> DataFrame:
    """Keys occurring more than once, with their count (NULL keys ignored)."""
    keyed = df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))
    return (keyed.groupBy(*cols).agg(F.count(F.lit(1)).alias("n_records"))
            .filter(F.col("n_records") > 1))


def accepted_values(df: DataFrame, col: str, values) -> DataFrame:
    """Values outside the list, with their count (NULL passes)."""
    return (df.filter(F.col(col).isNotNull() & ~F.col(col).isin(*values))
            .groupBy(F.col(col).alias("value_field"))
            .agg(F.count(F.lit(1)).alias("n_records")))


def relationships(child: DataFrame, col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """Child rows whose non-NULL key has no parent row (an anti-join; the
    parent side is reduced to its distinct keys first)."""
    keys = parent.select(F.col(parent_col).alias("__parent_key")).distinct()
    kid = child.filter(F.col(col).isNotNull())
    return kid.join(keys, kid[col] == keys["__parent_key"], "left_anti")


def milestones_after_signup(snapshot: DataFrame) -> DataFrame:
    """Users with a milestone stamped before their signup."""
    s = F.col("signed_up_at")
    cols = ("created_first_board_at", "invited_first_member_at", "active_in_week_2_at",
            "upgraded_to_paid_at")
    cond = reduce(lambda a, b: a | b, [F.col(c).isNotNull() & (F.col(c) < s) for c in cols])
    return snapshot.filter(cond).select("user_id", "signed_up_at", *cols)


def mrr_reconciliation(waterfall: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Months whose ending MRR differs from the running sum of net new MRR."""
    running = Window.orderBy("report_month").rowsBetween(Window.unboundedPreceding,
                                                          Window.currentRow)
    chk = waterfall.select("report_month", "ending_mrr",
                           F.sum("net_new_mrr").over(running).alias("expected_ending_mrr"))
    diff = F.abs(F.col("ending_mrr") - F.col("expected_ending_mrr"))
    return (chk.select("*", diff.alias("difference"))
            .filter(F.col("difference") > F.lit(tolerance)))


def mrr_against_active(waterfall: DataFrame, subs: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Final ending MRR against the MRR of rows still open (one row when they
    disagree)."""
    last = waterfall.agg(F.max_by("ending_mrr", "report_month").cast("double").alias("e"),
                         F.lit(None).cast("double").alias("a"))
    active = subs.filter(F.col("ended_at").isNull()).agg(
        F.lit(None).cast("double").alias("e"),
        F.coalesce(F.sum("mrr"), F.lit(0)).cast("double").alias("a"))
    both = last.unionByName(active).agg(F.max("e").alias("ending_mrr"),
                                        F.max("a").alias("active_mrr"))
    return both.filter(F.abs(F.col("ending_mrr") - F.col("active_mrr")) > F.lit(tolerance))


def events_before_signup(fct_events: DataFrame, dim_users: DataFrame) -> DataFrame:
    u = dim_users.select("user_id", "signed_up_at")
    e = fct_events.select("event_id", "user_id", "event_timestamp")
    return (join_dimension(e, u, "user_id")
            .filter(F.col("event_timestamp") < F.col("signed_up_at"))
            .select("event_id", "user_id", "event_timestamp", "signed_up_at"))


def retention_boolean(flags: DataFrame) -> DataFrame:
    """Flags other than 0/1 (NULL does not violate, as with NOT IN)."""
    return (flags.filter(~F.col("is_retained").isin(0, 1))
            .select("user_id", "retention_day", "is_retained"))


# ---- declarative suite ----------------------------------------------------------
@dataclass(frozen=True)
class Check:
    name: str
    table: str
    kind: str                      # not_null | unique | accepted_values | relationships | singular
    column: str | None = None
    values: tuple = ()
    parent: str | None = None
    parent_column: str | None = None
    args: dict = field(default_factory=dict, compare=False, hash=False)


def count_checks(checks: list[Check], frames: dict[str, DataFrame]) -> list[DataFrame]:
    """(test_name, violations) frames, several rows per test to be added up.

    One aggregate per table serves its not_null and accepted_values checks; the
    keys of all unique checks of one data type go through a single group-by, and
    so do the children of all relationships to one parent."""
    out: list[DataFrame] = []
    cells: dict[str, list[tuple[str, object]]] = {}
    keyed: dict[str, list[DataFrame]] = {}
    children: dict[tuple, list[DataFrame]] = {}
    for c in checks:
        df, col = frames[c.table], F.col(c.column)
        name = F.lit(c.name).alias("test_name")
        if c.kind == "not_null":
            cells.setdefault(c.table, []).append((c.name, F.count_if(col.isNull())))
        elif c.kind == "accepted_values":        # distinct values outside the list
            cells.setdefault(c.table, []).append(
                (c.name, F.count_distinct(F.when(~col.isin(*c.values), col))))
        elif c.kind == "unique":
            keyed.setdefault(dict(df.dtypes)[c.column], []).append(
                df.select(name, col.alias("k")).filter(F.col("k").isNotNull()))
        elif c.kind == "relationships":
            children.setdefault((c.parent, c.parent_column), []).append(
                df.select(name, col.alias("k")).filter(F.col("k").isNotNull()))
        else:
            raise ValueError(f"singular checks are passed as frames: {c.name}")
    for table, tests in cells.items():
        counts = frames[table].agg(*[e.alias(f"v{i}") for i, (_, e) in enumerate(tests)])
        out.append(counts.select(F.inline(F.array(*[
            F.struct(F.lit(name).alias("test_name"), F.col(f"v{i}").alias("violations"))
            for i, (name, _) in enumerate(tests)]))))
    for rows in keyed.values():
        out.append(union_all(rows).groupBy("test_name", "k")
                   .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
                   .select("test_name", F.lit(1).cast("long").alias("violations")))
    for (parent, column), rows in children.items():
        # children are reduced per key first (a hot key shrinks map-side)
        per_key = union_all(rows).groupBy("k", "test_name").agg(F.count(F.lit(1)).alias("n"))
        known = frames[parent].select(F.col(column).alias("p")).distinct()
        out.append(per_key.join(known, F.col("k") == F.col("p"), "left_anti")
                   .select("test_name", F.col("n").alias("violations")))
    return out


def run_suite(results: list[tuple[str, DataFrame]], counted: list[DataFrame] = (),
              names: list[str] = ()) -> DataFrame:
    """(name, violating rows) pairs, plus (test_name, violations) frames whose
    rows are added up -> one row per test; ``names`` are tests that also have a
    row when no frame mentions them."""
    counts = [df.agg(F.count(F.lit(1)).alias("violations"))
              .select(F.lit(name).alias("test_name"), "violations")
              for name, df in results] + list(counted)
    if names:
        some = counts[0].sparkSession
        counts.append(some.range(1).select(
            F.explode(F.array(*[F.lit(n) for n in names])).alias("test_name"),
            F.lit(0).cast("long").alias("violations")))
    out = union_all(counts).groupBy("test_name").agg(F.sum("violations").alias("violations"))
    return out.select("test_name", "violations", (F.col("violations") == 0).alias("passed"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union of same-shaped frames as a balanced tree (plan depth log n)."""
    frames = list(frames)
    while len(frames) > 1:
        frames = [frames[i].union(frames[i + 1]) if i + 1 < len(frames) else frames[i]
                  for i in range(0, len(frames), 2)]
    return frames[0]
