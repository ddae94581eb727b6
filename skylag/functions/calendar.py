"""Dates, weekdays and hhmm departure times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def flight_date(year="Year", month="Month", day="DayofMonth") -> Column:
    """The parts may be whole numbers of any width."""
    return F.make_date(*[F.col(part).cast("int") for part in (year, month, day)])


def iso_dow(date: Column) -> Column:
    """Monday = 1 ... Sunday = 7."""
    return F.weekday(date) + 1


def format_time(hhmm: Column) -> Column:
    """Scheduled hhmm as HH:MM; N/A when absent or outside 0..2400."""
    digits = F.lpad(hhmm.cast("string"), 4, "0")
    return F.when(
        hhmm.between(0, 2400), F.concat(digits.substr(1, 2), F.lit(":"), digits.substr(3, 2))
    ).otherwise("N/A")


def dep_hour(hhmm: Column) -> Column:
    """Whole hour of an hhmm time."""
    return F.call_function("div", hhmm, F.lit(100)).cast("int")


def weekday_of(flights: DataFrame) -> Column:
    """ISO weekday of each flight: the stored column where the table has one, which scans can be asked for."""
    return F.col("DayOfWeek") if "DayOfWeek" in flights.columns else iso_dow(flight_date())


def hour_of(flights: DataFrame) -> Column:
    """Departure hour of each flight, stored or derived."""
    return F.col("DepHour") if "DepHour" in flights.columns else dep_hour(F.col("CRSDepTime"))


def hour_text(hour: Column) -> Column:
    return F.when(hour.isNotNull(), F.format_string("%02d:00", hour))


def date_text(year: Column, month: Column, day: Column) -> Column:
    known = year.isNotNull() & month.isNotNull() & day.isNotNull()
    return F.when(known, F.format_string("%d-%02d-%02d", year, month, day))


def month_name(month: Column) -> Column:
    return F.date_format(F.make_date(F.lit(2024), month, F.lit(1)), "MMMM")


def day_name(dow: Column) -> Column:
    """Weekday name of an ISO weekday number; 2024-01-01 was a Monday."""
    return F.date_format(F.make_date(F.lit(2024), F.lit(1), dow), "EEEE")


def time_of_day(hour: Column) -> Column:
    """Class 1 before 6, 2 before 12, 3 before 17, else 4."""
    return (
        F.when(hour < 6, 1).when(hour < 12, 2).when(hour < 17, 3).when(hour.isNotNull(), 4)
    )
