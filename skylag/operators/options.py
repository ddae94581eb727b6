"""Date ranges and the choices available for a selection, over all keys at once."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, functions as F

from skylag import functions as fn
from skylag.operators.filters import require
from skylag.operators.reports import airline_label
from skylag.operators.routes import airport_side
from skylag.schemas import DATE_KEYS

# The range shown when the parts do not form dates.
DEFAULT_RANGE = (datetime.date(2024, 1, 1), datetime.date(2024, 12, 31))


def date_range(flights: DataFrame) -> DataFrame:
    """First and last flight date."""
    date = fn.flight_date()
    return flights.agg(F.min(date).alias("min_date"), F.max(date).alias("max_date"))


def date_range_parts(flights: DataFrame) -> DataFrame:
    """Range from the smallest and largest year, month and day taken one by one.

    Such a date may have no flights or not exist; if either does not exist, both defaults apply.
    """
    parts = flights.agg(
        *[F.min(c).alias(f"min_{c}") for c in DATE_KEYS],
        *[F.max(c).alias(f"max_{c}") for c in DATE_KEYS],
    )

    def date(prefix: str) -> Column:
        text = F.format_string("%04d-%02d-%02d", *[F.col(f"{prefix}_{c}") for c in DATE_KEYS])
        return F.try_to_date(text, "yyyy-MM-dd")

    valid = date("min").isNotNull() & date("max").isNotNull()
    first, last = DEFAULT_RANGE
    return parts.select(
        F.when(valid, date("min")).otherwise(F.lit(first)).alias("min_date"),
        F.when(valid, date("max")).otherwise(F.lit(last)).alias("max_date"),
    )


def _named_codes(ids: DataFrame, airports: DataFrame, id_column: str, keys: list) -> DataFrame:
    side = airport_side(airports, "_id", "airport_name", "lat", "lon").select("_id", "airport_name")
    code = F.col(id_column).cast("string")
    return ids.join(side, F.col(id_column) == F.col("_id")).select(
        *keys, code.alias("code"),
        fn.code_name_label(code, F.col("airport_name")).alias("display"),
    )


def airports_by_date(flights: DataFrame, airports: DataFrame) -> DataFrame:
    """Known airports with departures, per date."""
    ids = flights.select(*DATE_KEYS, "OriginAirportID").distinct()
    return _named_codes(ids, airports, "OriginAirportID", DATE_KEYS)


def dests_by_origin_date(flights: DataFrame, airports: DataFrame) -> DataFrame:
    """Known destinations per date and origin."""
    ids = flights.select(*DATE_KEYS, "OriginAirportID", "DestAirportID").distinct()
    origin = F.col("OriginAirportID").cast("string").alias("origin")
    return _named_codes(ids, airports, "DestAirportID", [*DATE_KEYS, origin])


def dep_times(flights: DataFrame) -> DataFrame:
    """Scheduled departure times per date and origin; filter by destination beforehand."""
    times = require(flights, ["CRSDepTime"]).select(
        *DATE_KEYS, "OriginAirportID", "CRSDepTime").distinct()
    return times.select(
        *DATE_KEYS, F.col("OriginAirportID").cast("string").alias("origin"), "CRSDepTime",
        fn.format_time(F.col("CRSDepTime")).alias("display"),
    )


def airlines_by_route(flights: DataFrame) -> DataFrame:
    return (
        require(flights, ["DOT_ID_Reporting_Airline"])
        .select("OriginAirportID", "DestAirportID", "DOT_ID_Reporting_Airline").distinct()
        .select(
            F.col("OriginAirportID").cast("string").alias("origin"),
            F.col("DestAirportID").cast("string").alias("dest"),
            F.col("DOT_ID_Reporting_Airline").cast("string").alias("code"),
        )
    )


def airlines_all(flights: DataFrame) -> DataFrame:
    return (
        require(flights, ["DOT_ID_Reporting_Airline"])
        .select("DOT_ID_Reporting_Airline").distinct()
        .select(F.col("DOT_ID_Reporting_Airline").cast("string").alias("code"))
    )


def default_airlines(flights: DataFrame, airlines: DataFrame, n: int = 5) -> DataFrame:
    """The first airlines by code, in text order: the report's default choice."""
    first = airlines_all(flights).orderBy("code").limit(n)
    return airline_label(first, airlines, "code")


# What operated in a month on a weekday ------------------------------------------------

CUBE = ["Month", "DayOfWeek", "origin", "dest", "airline", "DepHour"]


def availability_cube(flights: DataFrame) -> DataFrame:
    """Each (month, weekday, origin, dest, airline, hour) that occurs.

    The coarser choices below are distinct projections of this one small table.
    """
    cube = flights.select(
        "Month",
        fn.weekday_of(flights).alias("DayOfWeek"),
        F.col("OriginAirportID").alias("origin"),
        F.col("DestAirportID").alias("dest"),
        F.col("DOT_ID_Reporting_Airline").alias("airline"),
        fn.hour_of(flights).alias("DepHour"),
    ).distinct()
    return cube.withColumns({c: F.col(c).cast("string") for c in ("origin", "dest", "airline")})


def _airport_display(cube: DataFrame, airports: DataFrame, code: str, keys: list[str]) -> DataFrame:
    names = airports.select(F.col("code").alias("_code"), "airport_name")
    distinct = require(cube.select(*keys, code), [code]).distinct()
    return distinct.join(names, F.col(code) == F.col("_code"), "left").select(
        *keys, code,
        fn.code_only_label(F.col(code), F.col("airport_name")).alias("label_or_code"),
        fn.code_name_label(F.col(code), F.col("airport_name")).alias("label_or_unknown"),
    )


def availability_origins(cube: DataFrame, airports: DataFrame) -> DataFrame:
    return _airport_display(cube, airports, "origin", CUBE[:2])


def availability_dests(cube: DataFrame, airports: DataFrame) -> DataFrame:
    return _airport_display(cube, airports, "dest", CUBE[:3])


def availability_airlines(cube: DataFrame, airlines: DataFrame) -> DataFrame:
    """Airlines per route; flights without an airline offer no choice."""
    distinct = require(cube.select(*CUBE[:5]), ["airline"]).distinct()
    return airline_label(distinct, airlines, "airline")


def availability_hours(cube: DataFrame) -> DataFrame:
    return (
        require(cube, ["airline", "DepHour"])
        .withColumn("display", fn.hour_text(F.col("DepHour")))
    )
