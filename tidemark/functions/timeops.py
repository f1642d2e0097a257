"""Time arithmetic on naive (TIMESTAMP_NTZ) columns.

Everything is expressed with built-in, codegen-able functions.  Elapsed time
is measured in integer microseconds first and divided last, so results are
exact and identical across engines.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECOND_US = 1_000_000
HOUR_US = 3_600 * SECOND_US
DAY_US = 86_400 * SECOND_US

_UNIT_US = {"second": SECOND_US, "hour": HOUR_US, "day": DAY_US}


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def trunc_date(unit: str, col) -> Column:
    """``date_trunc(unit, ts)::date`` -- weeks start on Monday."""
    return F.date_trunc(unit, _c(col)).cast("date")


def trunc_ts(unit: str, col) -> Column:
    """``date_trunc`` that stays naive (Spark's returns a zoned timestamp)."""
    return F.date_trunc(unit, _c(col)).cast("timestamp_ntz")


def ntz_lit(value) -> Column:
    """A naive timestamp literal, independent of the session time zone."""
    if isinstance(value, _dt.datetime):
        text = value.isoformat(sep=" ")
    elif isinstance(value, _dt.date):
        text = f"{value.isoformat()} 00:00:00"
    else:
        text = str(value)
    return F.lit(text).cast("timestamp_ntz")


def add_days(col, days) -> Column:
    n = days if isinstance(days, Column) else F.lit(int(days))
    return _c(col) + F.make_dt_interval(days=n.cast("int"))


def add_seconds(col, secs) -> Column:
    n = secs if isinstance(secs, Column) else F.lit(secs)
    return _c(col) + F.make_dt_interval(secs=n)


def elapsed_micros(start, end) -> Column:
    """end - start in whole microseconds (NULL if either side is NULL)."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end))


def elapsed(start, end, unit: str = "hour") -> Column:
    """end - start as a double in seconds, hours or days (fraction kept)."""
    return elapsed_micros(start, end).cast("double") / F.lit(float(_UNIT_US[unit]))


def _as_date(value) -> _dt.date:
    if isinstance(value, _dt.datetime):
        return value.date()
    if isinstance(value, _dt.date):
        return value
    return _dt.date.fromisoformat(str(value))


def _bound(value) -> Column:
    if isinstance(value, Column):
        return value.cast("date")
    return F.lit(_as_date(value))


def date_series(spark: SparkSession, start, end, name: str = "date_day",
                bounds: DataFrame | None = None) -> DataFrame:
    """One row per day in [start, end].

    With ``bounds`` (a one-row frame) start/end may be columns of it, so the
    range can come from the data without a driver round trip."""
    base = bounds if bounds is not None else spark.range(1)
    return base.select(F.explode(F.sequence(_bound(start), _bound(end),
                                            F.expr("INTERVAL 1 DAY"))).alias(name))


def month_series(spark: SparkSession, first, last, name: str = "report_month",
                 bounds: DataFrame | None = None) -> DataFrame:
    """One row per month start in [first, last]; ``bounds`` as in
    :func:`date_series`."""
    base = bounds if bounds is not None else spark.range(1)
    return base.select(
        F.explode(F.sequence(F.trunc(_bound(first), "MM"), F.trunc(_bound(last), "MM"),
                             F.expr("INTERVAL 1 MONTH"))).alias(name))


def calendar(dates: DataFrame, col: str = "date_day", pad_names: bool = True) -> DataFrame:
    """Calendar attributes of a date column (the date dimension).

    ``day_of_week`` is 0 = Sunday; ``week_number`` is the ISO week paired
    with the calendar year; names are blank-padded to 9 characters like the
    SQL ``to_char(d, 'Day')`` unless ``pad_names`` is False."""
    d = F.col(col)
    dow = (F.dayofweek(d) - 1).cast("int")

    def name(fmt: str) -> Column:
        text = F.date_format(d, fmt)
        return F.rpad(text, 9, " ") if pad_names else text

    return dates.select(
        d.alias("date_day"),
        F.year(d).cast("int").alias("year_number"),
        F.month(d).cast("int").alias("month_number"),
        F.dayofmonth(d).cast("int").alias("day_number"),
        dow.alias("day_of_week"),
        F.weekofyear(d).cast("int").alias("week_number"),
        F.quarter(d).cast("int").alias("quarter_number"),
        F.date_format(d, "yyyy-MM").alias("year_month"),
        name("EEEE").alias("day_name"),
        name("MMMM").alias("month_name"),
        trunc_date("week", d).alias("week_start_date"),
        trunc_date("month", d).alias("month_start_date"),
        trunc_date("quarter", d).alias("quarter_start_date"),
        dow.isin(0, 6).alias("is_weekend"),
    )
