"""Derived features of one planned flight."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Month * 100 + day of the holidays.
HOLIDAYS = [101, 704, 1225, 1226]


def weekday_share(dow: Column) -> Column:
    return F.when(dow.between(1, 5), 1.0).otherwise(0.0)


def has_holiday_effect(month: Column, day: Column) -> Column:
    return F.when((month * 100 + day).isin(HOLIDAYS), 1.0).otherwise(0.0)


def has_peak_hour(hour: Column) -> Column:
    """6:00-8:59 and 16:00-18:59."""
    return F.when(hour.between(6, 8) | hour.between(16, 18), 1.0).otherwise(0.0)


def distance_category(miles: Column) -> Column:
    return F.when(miles < 250, 1.0).when(miles < 750, 2.0).when(miles < 1500, 3.0).otherwise(4.0)


def season(month: Column) -> Column:
    """Winter 1 (Dec-Feb), spring 2, summer 3, autumn 4."""
    return (
        F.when(month.isin(12, 1, 2), 1.0)
        .when(month.between(3, 5), 2.0)
        .when(month.between(6, 8), 3.0)
        .otherwise(4.0)
    )
