"""Business-date rules: Monday weeks, Sunday-first weekdays, half-open windows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col


def day(value: str | dt.date | Column) -> Column:
    """A date constant or column as a DateType column."""
    if isinstance(value, Column):
        return value
    return F.lit(dt.date.fromisoformat(value) if isinstance(value, str) else value)


def to_date(value: str | dt.date) -> dt.date:
    return dt.date.fromisoformat(value) if isinstance(value, str) else value


def week_of(d: Column | str) -> Column:
    """Monday of the week."""
    return F.trunc(col(d), "week")


def day_of_week(d: Column | str) -> Column:
    """0 = Sunday … 6 = Saturday."""
    return F.dayofweek(col(d)) - 1


def month_of(d: Column | str) -> Column:
    return F.date_format(col(d), "yyyy-MM")


def days_in_month(d: Column | str) -> Column:
    return F.dayofmonth(F.last_day(col(d)))


def is_leap_year(y: Column) -> Column:
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def is_iso_date(text: Column) -> Column:
    return text.rlike(r"^\d{4}-\d{2}-\d{2}$")


def between(d: Column | str, lo, hi) -> Column:
    """Half-open window [lo, hi)."""
    return (col(d) >= day(lo)) & (col(d) < day(hi))


def weeks_back(as_of: str | dt.date, weeks: int) -> dt.date:
    return to_date(as_of) - dt.timedelta(days=7 * weeks)


def short_date(d: Column | str) -> Column:
    """``8 Sep``; an em dash for null."""
    return F.coalesce(F.concat(F.dayofmonth(col(d)).cast("string"), F.lit(" "), F.date_format(col(d), "MMM")), F.lit("—"))


def long_date(d: Column | str) -> Column:
    """``8 Sep 2026``; an em dash for null."""
    return F.when(col(d).isNull(), F.lit("—")).otherwise(F.concat(short_date(d), F.lit(" "), F.year(col(d)).cast("string")))


def month_name(d: Column | str) -> Column:
    """``September 2026``."""
    return F.date_format(col(d), "MMMM yyyy")


def reporting_period(as_of: Column) -> Column:
    """Month to date through the last complete day."""
    last = F.date_sub(as_of, 1)
    return F.struct(
        F.trunc(last, "month").alias("from_date"),
        last.alias("to_date"),
        F.concat(month_name(last), F.lit(", month to date")).alias("label"),
        F.concat(F.lit("FY"), F.year(last), F.lit(" P"), F.month(last)).alias("fiscal"),
    )


def closed_period(as_of: Column) -> Column:
    """The last complete calendar month."""
    last = F.date_sub(F.trunc(as_of, "month"), 1)
    return F.struct(
        F.trunc(last, "month").alias("from_date"),
        last.alias("to_date"),
        month_name(last).alias("label"),
        F.concat(F.lit("FY"), F.year(last), F.lit(" P"), F.month(last)).alias("fiscal"),
    )


def period_for(as_of: str | dt.date) -> tuple[dt.date, dt.date]:
    """The reporting period as two dates, both inside it."""
    last = to_date(as_of) - dt.timedelta(days=1)
    return last.replace(day=1), last


def closed_period_for(as_of: str | dt.date) -> tuple[dt.date, dt.date]:
    last = to_date(as_of).replace(day=1) - dt.timedelta(days=1)
    return last.replace(day=1), last
