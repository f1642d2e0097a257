"""Column helpers, calendar, reports and filters."""

import datetime as dt
from fractions import Fraction

from pyspark.sql import functions as F

from helpers import events_df, users_df
from tidemark.functions.money import cents_to_dollars
from tidemark.functions.rates import pct1
from tidemark.operators.marts import dim_date, fct_user_events
from tidemark.plans import reports as R


def _half_up_tenths(a, b):
    q = Fraction(1000 * a, b)
    return float((q + Fraction(1, 2)).__floor__()) / 10.0


def test_pct1_exact_for_all_small_fractions(spark):
    df = (spark.range(1, 301).withColumnRenamed("id", "b")
          .join(spark.range(0, 301).withColumnRenamed("id", "a"), F.col("a") <= F.col("b")))
    got = {(r.a, r.b): r.p for r in df.select("a", "b", pct1("a", "b").alias("p")).collect()}
    assert len(got) == 45450
    bad = [(a, b) for (a, b), p in got.items() if p != _half_up_tenths(a, b)]
    assert bad == []
    assert spark.range(1).select(pct1(F.lit(1), F.lit(0))).first()[0] is None


def test_cents_to_dollars(spark):
    v = spark.range(1).select(cents_to_dollars(F.lit(1150)).alias("d")).first()["d"]
    assert str(v) == "11.50"


def test_dim_date_calendar_edges(spark):
    rows = {r.date_day: r for r in dim_date(spark, "2024-08-31", "2024-12-31").collect()}
    assert len(rows) == 123
    sep1 = rows[dt.date(2024, 9, 1)]
    assert sep1.day_of_week == 0 and sep1.is_weekend
    assert sep1.week_start_date == dt.date(2024, 8, 26)
    assert sep1.day_name == "Sunday   " and sep1.month_name == "September"
    dec30 = rows[dt.date(2024, 12, 30)]
    assert dec30.week_number == 1 and dec30.year_number == 2024
    assert dec30.quarter_start_date == dt.date(2024, 10, 1)
    assert len(dim_date(spark).collect()) == 577


def test_filters_fallbacks_and_empty(spark):
    users = users_df(spark, [("a", "2024-01-01 00:00:00", "US", "organic"),
                             ("b", "2024-01-01 00:00:00", "UK", "referral"),
                             ("c", "2024-01-01 00:00:00", "DE", "organic")])
    snap = users.select("user_id", "region", "signup_source",
                        F.lit(3).alias("max_funnel_stage"))
    assert R.kpi_total_users(users, R.Filters()).first()["n"] == 3
    # empty region list -> all known regions (US, UK, AU); empty sources -> organic only
    assert R.kpi_total_users(users, R.Filters(regions=(), sources=())).first()["n"] == 1
    assert R.kpi_total_users(users, R.Filters(regions=(), sources=None)).first()["n"] == 2
    nobody = R.kpi_activation_rate(snap, R.Filters(regions=("AU",)))
    assert nobody.first()["rate"] is None


def test_dau_wau_mau(spark):
    users = users_df(spark, [(u, "2024-01-01 00:00:00") for u in "abcdefgh"])
    events = events_df(spark, [
        ("1", "a", "x", "2024-03-31 10:00:00"),   # today
        ("2", "b", "x", "2024-03-30 10:00:00"),   # yesterday
        ("3", "c", "x", "2024-03-24 10:00:00"),   # 7 days ago: in WAU
        ("4", "d", "x", "2024-03-23 10:00:00"),   # 8 days ago: MAU only
        ("5", "e", "x", "2024-03-01 10:00:00"),   # 30 days ago: in MAU
        ("6", "f", "x", "2024-02-29 10:00:00"),   # 31 days ago: out
        ("7", "g", "x", "2024-04-05 10:00:00"),   # future: counted (no upper bound)
    ])
    r = R.kpi_dau_wau_mau(fct_user_events(users, events), "2024-03-31").first()
    assert (r.dau, r.wau, r.mau) == (1, 4, 6)
    assert r.wau_mau_ratio == 66.7
    empty = events_df(spark, [("1", "a", "x", "2020-01-01 00:00:00")])
    r0 = R.kpi_dau_wau_mau(fct_user_events(users, empty), "2024-03-31").first()
    assert r0.mau == 0 and r0.wau_mau_ratio == 0.0
