"""Dates, ISO weeks, work days and clock times.  Clock times are seconds or minutes as integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_year(d: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), d)


def iso_week(d: Column) -> Column:
    return F.weekofyear(d)


def monday(d: Column) -> Column:
    return F.to_date(F.date_trunc("week", d))


def monday_of(year: Column, week: Column) -> Column:
    """Monday of an ISO week; null where the year has no such week."""
    first = monday(F.make_date(year, F.lit(1), F.lit(4)))
    day = F.date_add(first, (week - 1) * 7)
    return F.when((week >= 1) & (iso_year(day) == year), day)


def week_label(d: Column) -> Column:
    return F.concat(iso_year(d).cast("string"), F.lit("-W"), F.lpad(iso_week(d).cast("string"), 2, "0"))


def is_workday(d: Column, saturday: Column | bool = False, sunday: Column | bool = False) -> Column:
    """Monday to Friday, and the weekend's days where they are opted in."""
    sat, sun = (x if isinstance(x, Column) else F.lit(x) for x in (saturday, sunday))
    return F.when(F.weekday(d) == 5, sat).when(F.weekday(d) == 6, sun).otherwise(F.lit(True))


def workdays(start: Column, end: Column, saturday: Column | bool = False, sunday: Column | bool = False) -> Column:
    """Work days of a range, ascending; none if it ends before it starts."""
    days = F.when(end >= start, F.sequence(start, end)).otherwise(F.array().cast("array<date>"))
    return F.filter(days, lambda d: is_workday(d, saturday, sunday))


def seconds_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def clock_minutes(text: Column) -> Column:
    """Minutes of "H:MM" or "H:MM:SS", at most 23:59; null if it isn't a clock time."""
    hour = F.try_to_number(F.regexp_extract(text, r"^\s*(\d{1,2}):(\d{2})(?::\d{2})?\s*$", 1), F.lit("99")).cast("int")
    minute = F.try_to_number(F.regexp_extract(text, r"^\s*(\d{1,2}):(\d{2})(?::\d{2})?\s*$", 2), F.lit("99")).cast("int")
    return F.when(minute < 60, F.least(hour * 60 + minute, F.lit(23 * 60 + 59)))


def net_hours(start: Column, end: Column, pause: Column) -> Column:
    """Hours between two clock times in minutes, less the pause."""
    net = F.greatest(F.lit(0), end - start - F.greatest(F.lit(0), pause))
    return F.round(net.cast("decimal(12,2)") / 60, 2)


def hundredths_of_hours(seconds: Column) -> Column:
    """Hours of a number of seconds, in hundredths, rounded half up in integers."""
    return F.floor((seconds * 100 + 1800) / 3600).cast("bigint")


def snap_hours(hours: Column) -> Column:
    """The nearest even number of hours from 2 to 8."""
    return F.greatest(F.lit(2), F.least(F.lit(8), F.round(hours / 2) * 2))


def man_days(hours: Column) -> Column:
    """Days of eight hours, one at most."""
    return F.round(F.least(F.lit(8), F.greatest(F.lit(0), hours)).cast("decimal(12,4)") / 8, 4)
