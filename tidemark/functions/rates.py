"""Exact percentage rounding.

``round(100.0 * a / b, 1)`` on exact numerics rounds half away from zero.
Going through doubles misrounds some fractions, so the rate is computed in
integers: tenths = floor((2000*a + b) / (2*b)), then divided by 10.  Whole
decimals of 38 digits hold the products, so counts and products of two counts
of any long size neither overflow nor lose digits.
Valid for a, b >= 0; NULL when b = 0 (or NULL).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.lit(x) if isinstance(x, (int, float)) else F.col(x)


def _whole(x) -> Column:
    return _c(x).cast("decimal(38,0)")


def _floor_div(num: Column, den: Column) -> Column:
    """Exact floor(num / den) for non-negative whole decimals, as a double."""
    return ((num - num % den) / den).cast("double")


def pct1(a, b, scale: int = 100) -> Column:
    """round(scale * a / b, 1), half away from zero, exact; NULL when b = 0."""
    a, b = _whole(a), _whole(b)
    num = _whole(_whole(a * F.lit(scale * 20)) + b)
    return F.when(b != 0, _floor_div(num, _whole(b * F.lit(2))) / F.lit(10.0)).cast("double")


def ratio1(a, b, c, d) -> Column:
    """round((a / b) / (c / d), 1) of four counts, exact; NULL when b or c is 0."""
    return pct1(_whole(a) * _whole(d), _whole(b) * _whole(c), scale=1)


def round_cents_avg(total_cents, n) -> Column:
    """round(total / n, 2) where total is in cents: exact, half away from zero."""
    s, n = _whole(total_cents), _whole(n)
    num = _whole(_whole(s * F.lit(2)) + n)
    return F.when(n != 0, _floor_div(num, _whole(n * F.lit(2))) / F.lit(100.0)).cast("double")
