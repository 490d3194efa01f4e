"""Times as integers. The session runs in UTC, so wall-clock and absolute times convert without loss."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS


def millis(column: Column) -> Column:
    """Epoch milliseconds of a timestamp with or without zone, rounded down."""
    return F.unix_millis(column.cast("timestamp"))


def floor_div(value: Column, by: int) -> Column:
    """Exact integer division rounding down, also below zero."""
    divisor = F.lit(by).cast("long")
    return F.call_function("div", value.cast("long") - F.pmod(value.cast("long"), divisor), divisor)


def day_text(day: Column) -> Column:
    """yyyy-MM-dd of a day counted from the epoch."""
    return F.date_from_unix_date(day.cast("int")).cast("string")
