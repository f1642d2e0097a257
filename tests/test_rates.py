from fractions import Fraction

from pyspark.sql import functions as F

from tidemark.functions.rates import pct1, ratio1, round_cents_avg


def half_up(x: Fraction, digits: int) -> float:
    return int(x * 10 ** digits + Fraction(1, 2)) / 10 ** digits


def test_rates_stay_exact_for_billions_of_rows(spark):
    rows = [(1, 3, 2, 7), (4 * 10 ** 8, 8 * 10 ** 8, 10 ** 8, 12 * 10 ** 8),
            (10 ** 9 + 7, 3 * 10 ** 9 + 1, 10 ** 9 - 11, 2 * 10 ** 9 + 3),
            (9 * 10 ** 15 + 1, 9 * 10 ** 15 + 2, 5, 9 * 10 ** 15 + 7)]
    df = spark.createDataFrame(rows, "a long, b long, c long, d long")
    got = df.select("a", "b", "c", "d", pct1("a", "b").alias("pct"),
                    ratio1("a", "b", "c", "d").alias("lift"),
                    round_cents_avg("a", "b").alias("avg")).collect()
    assert len(got) == len(rows)
    for r in got:
        share = Fraction(r.a, r.b)
        assert r.pct == half_up(share * 100, 1)
        assert r.lift == half_up(share / Fraction(r.c, r.d), 1)
        assert r.avg == half_up(share / 100, 2)


def test_rates_without_a_denominator_are_null(spark):
    df = spark.createDataFrame([(1, 0), (None, 5), (5, None)], "a long, b long")
    assert [r[0] for r in df.select(pct1("a", "b")).collect()] == [None] * 3
    one = df.select(ratio1(F.lit(1), F.lit(2), F.lit(0), F.lit(3))).first()
    assert one[0] is None
