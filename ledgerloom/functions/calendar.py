"""Calendar expressions on date or timestamp columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_to_month_end(d: Column) -> Column:
    return F.datediff(F.last_day(d), F.to_date(d))


def last_business_day(d: Column) -> Column:
    """Last Monday-to-Friday day of the month of ``d``."""
    end = F.last_day(d)
    return F.date_sub(end, F.greatest(F.weekday(end) - F.lit(4), F.lit(0)))


def business_month_end(d: Column) -> Column:
    """Business month end on or after ``d``: past this month's, the next month's."""
    this = last_business_day(d)
    following = last_business_day(F.add_months(F.trunc(d, "month"), 1))
    return F.when(F.to_date(d) <= this, this).otherwise(following)


def is_month_end(d: Column, within: int = 3) -> Column:
    return (F.datediff(business_month_end(d), F.to_date(d)) <= within).cast("int")


def is_quarter_end(d: Column, within: int = 3) -> Column:
    return (F.month(d).isin(3, 6, 9, 12) & (is_month_end(d, within) == 1)).cast("int")


def period_end(d: Column, period: str) -> Column:
    if period == "month":
        return F.last_day(d)
    if period == "quarter":
        return F.last_day(F.add_months(F.trunc(d, "quarter"), 2))
    if period == "year":
        return F.make_date(F.year(d), F.lit(12), F.lit(31))
    raise ValueError(f"unknown period {period!r}")


def near_period_end(d: Column, period: str, n_days: int) -> Column:
    """1 when the period ends within n_days business days, taken as 1.4 calendar days each."""
    gap = F.datediff(period_end(d, period), F.to_date(d))
    return (gap.cast("double") <= F.lit(n_days * 1.4)).cast("int")


def add_business_days(d: Column, n: Column) -> Column:
    """Monday-to-Friday day addition, no holidays; a weekend start moves on from Friday."""
    wd = F.least(F.weekday(d), F.lit(4))
    start = F.date_sub(F.to_date(d), F.weekday(d) - wd)
    weeks = F.floor((wd + n) / F.lit(5)).cast("int")
    return F.date_add(start, (n + weeks * F.lit(2)).cast("int"))


def week_ending_sunday(d: Column) -> Column:
    return F.date_add(F.to_date(F.date_trunc("week", d)), 6)
