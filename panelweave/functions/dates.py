"""Business-day arithmetic (Mon-Fri, no holidays) as closed-form expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bday_add(day: Column, n: int | Column) -> Column:
    """``day`` plus ``n >= 0`` business days.

    A weekend date counts from the preceding Friday when n >= 1, and rolls
    forward to Monday when n = 0.
    """
    n = F.lit(n) if isinstance(n, int) else n
    wd = F.weekday(day)
    excess = F.greatest(wd - 4, F.lit(0))
    start = F.least(wd, F.lit(4))
    shift = n + 2 * F.floor((start + n) / 5).cast("int") - excess
    roll = F.when(wd > 4, 7 - wd).otherwise(0)
    return F.date_add(day, F.when(n == 0, roll).otherwise(shift).cast("int"))


def bday_count(first: Column, last: Column) -> Column:
    """Business days in the closed interval [first, last]."""

    def upto(d: Column) -> Column:
        # Monday 1969-12-29 starts the count, so every later day is >= 0.
        days = F.datediff(d, F.lit("1969-12-29").cast("date"))
        return F.floor(days / 7) * 5 + F.least(F.pmod(days, F.lit(7)) + 1, F.lit(5))

    return (upto(last) - upto(F.date_sub(first, 1))).cast("long")


def month_end(day: Column) -> Column:
    return F.last_day(day)
