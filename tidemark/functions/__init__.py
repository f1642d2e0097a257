from tidemark.functions.timeops import (  # noqa: F401
    DAY_US, HOUR_US, SECOND_US, add_days, add_seconds, calendar, date_series,
    elapsed, elapsed_micros, month_series, trunc_date, trunc_ts,
)
from tidemark.functions.rates import pct1, round_cents_avg  # noqa: F401
from tidemark.functions.money import cents_to_dollars, money_out  # noqa: F401
