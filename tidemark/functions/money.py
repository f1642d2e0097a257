"""Money columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(10,2)"


def cents_to_dollars(col) -> Column:
    """Integer cents to dollars as decimal(16,2): cast first, then divide,
    so 1150 becomes 11.50 (never integer division)."""
    c = F.col(col) if isinstance(col, str) else col
    return (c.cast("decimal(16,2)") / F.lit(100)).cast("decimal(16,2)")


def money_out(col) -> Column:
    """Decimal money to double at the edge of a report (sum first, cast last)."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("double")
