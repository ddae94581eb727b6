"""Predicates and row-level projections of the flights table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from skylag import functions as fn
from skylag.schemas import CAUSES, DATE_KEYS, DELAY_FLAGS, DELAY_MINUTES

ALL = "ALL"
#: A condition, or a function that makes one for a table from the columns it has; None does not filter.
Clause = Column | Callable[[DataFrame], Column] | None
REQUIRED = ["DayofMonth", "Month", "CRSDepTime", "DOT_ID_Reporting_Airline",
            "OriginAirportID", "DestAirportID"]
# Report order of the measures.
MEASURES = [*DELAY_FLAGS, *DELAY_MINUTES, *CAUSES]


def _is_all(choice) -> bool:
    return choice is None or choice == ALL or list(choice) in ([], [ALL])


def on_date(year: int, month: int, day: int) -> Column:
    return (F.col("Year") == year) & (F.col("Month") == month) & (F.col("DayofMonth") == day)


def from_origin(airport_id: int) -> Column:
    """Typed literal against the bare column, so that scans can skip row groups."""
    return F.col("OriginAirportID") == int(airport_id)


def on_route(origin: int, dest: int) -> Column:
    return from_origin(origin) & (F.col("DestAirportID") == int(dest))


def to_dests(dests) -> Column | None:
    if _is_all(dests):
        return None
    return F.col("DestAirportID").isin([int(d) for d in dests])


def at_time(hhmm) -> Column | None:
    if hhmm is None or hhmm == ALL:
        return None
    return F.col("CRSDepTime") == int(hhmm)


def with_status(status: str) -> Column | None:
    choices = {ALL: None, "Delayed": fn.is_delayed(), "On-Time": fn.is_on_time()}
    if status not in choices:
        raise ValueError(f"status must be one of {sorted(choices)}")
    return choices[status]


def by_airlines(codes) -> Column | None:
    if _is_all(codes):
        return None
    return F.col("DOT_ID_Reporting_Airline").isin([int(c) for c in codes])


def in_months(months) -> Column | None:
    return None if _is_all(months) else F.col("Month").isin([int(m) for m in months])


def on_month_dow(month: int, dow: int) -> Clause:
    """A stored weekday is compared as it is, so that scans can skip row groups; else it follows from the date."""
    return lambda flights: (F.col("Month") == month) & (fn.weekday_of(flights) == dow)


def keep(flights: DataFrame, *clauses: Clause) -> DataFrame:
    """Rows that meet every given clause; absent clauses do not filter."""
    given = [clause(flights) if callable(clause) else clause for clause in clauses if clause is not None]
    return flights.where(reduce(and_, given)) if given else flights


def selection(date=None, origin=None, dests=ALL, dep_time=ALL, status: str = ALL) -> list[Clause]:
    """The clauses of the history view: any of its parts may be left open."""
    return [
        on_date(*date) if date else None,
        from_origin(origin) if origin is not None else None,
        to_dests(dests),
        at_time(dep_time),
        with_status(status),
    ]


def select_flights(flights: DataFrame, date=None, origin=None, dests=ALL, dep_time=ALL,
                   status: str = ALL) -> DataFrame:
    """The selection of the history view."""
    return keep(flights, *selection(date, origin, dests, dep_time, status))


def keep_keys(flights: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The IN-list for lists too long for literals."""
    return flights.join(keys, on, "left_semi")


def require(rows: DataFrame, columns: list[str] = REQUIRED) -> DataFrame:
    """Rows where every given column is known; stated per column, which scans can use."""
    return rows.where(reduce(and_, [F.col(c).isNotNull() for c in columns]))


def fill_measures(flights: DataFrame) -> DataFrame:
    return flights.fillna(0, subset=MEASURES)


def add_missing_causes(flights: DataFrame) -> DataFrame:
    absent = [cause for cause in CAUSES if cause not in flights.columns]
    return flights.withColumns({cause: F.lit(0.0) for cause in absent}) if absent else flights


def flight_rows(flights: DataFrame, *more: str) -> DataFrame:
    """Standard flight rows: filled measures, delay flag, shown time and its sort key."""
    filled = fill_measures(add_missing_causes(flights))
    return filled.select(
        *DATE_KEYS,
        F.col("Flight_Number_Reporting_Airline").alias("fl_num"),
        F.col("OriginAirportID").cast("string").alias("origin"),
        F.col("DestAirportID").cast("string").alias("dest"),
        F.col("CRSDepTime").alias("crs_dep_time_raw"),
        *MEASURES,
        fn.is_delay().alias("is_delay"),
        fn.format_time(F.col("CRSDepTime")).alias("crs_dep_time"),
        F.coalesce("CRSDepTime", F.lit(0)).alias("crs_dep_time_sort"),
        *more,
    )


def cross_filter(rows: DataFrame, picks: DataFrame) -> DataFrame:
    """Rows whose time is among the picked times and whose destination is among the picked ones.

    This is the cross product of the picks, wider than the picked cells themselves.
    """
    times = picks.select("crs_dep_time").distinct()
    dests = picks.select("dest_name").distinct()
    return rows.join(times, "crs_dep_time", "left_semi").join(dests, "dest_name", "left_semi")
