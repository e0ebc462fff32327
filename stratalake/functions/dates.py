"""Acquisition dates as decimal years."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days by which a day of the year is divided; the value that published lists use.
DAYS = 365.1


def decimal_year(date: Column) -> Column:
    """Year plus day of the year over 365.1."""
    return F.year(date) + F.dayofyear(date) / F.lit(DAYS)


def decimal_year_by_month(date: Column) -> Column:
    """Year plus whole months over 12 plus days over 365: the second convention in use."""
    return F.year(date) + (F.month(date) - 1) / F.lit(12.0) + (F.dayofmonth(date) - 1) / F.lit(365.0)


def from_yyyymmdd(number: Column) -> Column:
    return F.to_date(number.cast("string"), "yyyyMMdd")


def to_yyyymmdd(date: Column) -> Column:
    return F.year(date) * 10000 + F.month(date) * 100 + F.dayofmonth(date)


def day_of_year_date(year: Column, day: Column) -> Column:
    """The date of a year's n-th day, from 1."""
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (day - 1).cast("int"))


def baseline_limit(days: float) -> float:
    """A temporal baseline given in days, in decimal years."""
    return days / DAYS
