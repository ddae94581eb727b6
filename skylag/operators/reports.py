"""Counts, cause breakdowns, averages, matrices and the flight listing."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from skylag import functions as fn
from skylag.operators.filters import ALL, by_airlines, in_months, keep, require
from skylag.operators.routes import airport_side
from skylag.schemas import CAUSE_LABELS_LONG, CAUSE_LABELS_SHORT, CAUSES, DATE_KEYS
from skylag.session import materialize

SELECTION = [*DATE_KEYS, "OriginAirportID"]


def kpi_summary(flights: DataFrame, keys: list[str] = SELECTION) -> DataFrame:
    """Flights, on-time flights, delayed flights and delayed per cent; 0 % of no flights."""
    return finished_kpis(flights.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_flights"), F.sum(fn.is_delay()).alias("delayed_flights")), keys)


def finished_kpis(counts: DataFrame, keys: list[str]) -> DataFrame:
    total, late = F.col("total_flights"), F.coalesce("delayed_flights", F.lit(0))
    return counts.select(
        *keys, total, (total - late).alias("on_time_flights"), late.alias("delayed_flights"),
        F.coalesce(fn.pct_rounded(F.try_divide(late, total)), F.lit(0.0)).alias("delayed_pct"),
    )


# Destination by departure time --------------------------------------------------------

def _dest_time_counts(flights: DataFrame, airports: DataFrame, keys: list[str]) -> DataFrame:
    """Flights and delayed flights per destination and raw time, then the destination's name.

    Counting comes first, so names are joined to counts only.
    """
    counts = flights.groupBy(*keys, "DestAirportID", "CRSDepTime").agg(
        F.count(F.lit(1)).alias("n"), F.sum(fn.is_delay()).alias("late"))
    return named_counts(counts, airports, keys)


def named_counts(counts: DataFrame, airports: DataFrame, keys: list[str]) -> DataFrame:
    side = airport_side(airports, "_dst", "dest_name", "lat", "lon").select("_dst", "dest_name")
    return counts.join(side, F.col("DestAirportID") == F.col("_dst"), "left").select(
        *keys, "dest_name", fn.format_time(F.col("CRSDepTime")).alias("crs_dep_time"), "n", "late")


def dest_time_ratio(flights: DataFrame, airports: DataFrame,
                    keys: list[str] = SELECTION) -> DataFrame:
    """Delay ratio per destination name and shown departure time; unnamed destinations drop out."""
    return ratios_of(_dest_time_counts(flights, airports, keys), keys)


def ratios_of(counts: DataFrame, keys: list[str]) -> DataFrame:
    return (
        require(counts, ["dest_name"])
        .groupBy(*keys, "dest_name", "crs_dep_time")
        .agg(F.sum("late").alias("delayed"), F.sum("n").alias("total"))
        .withColumn("delay_ratio", F.col("delayed") / F.col("total"))
    )


def dest_time_matrix(ratios: DataFrame, times: list[str], keys: list[str] = SELECTION) -> DataFrame:
    """One row per destination, one column per time in text order, null where nothing flew."""
    return (
        ratios.groupBy(*keys, "dest_name").pivot("crs_dep_time", sorted(times))
        .agg(F.first("delay_ratio"))
    )


def shown_times(ratios: DataFrame) -> list[str]:
    """The matrix columns that occur; at most one per minute of the day plus N/A."""
    return [row[0] for row in ratios.select("crs_dep_time").distinct().orderBy("crs_dep_time").collect()]


def heatmap_summary(flights: DataFrame, airports: DataFrame,
                    keys: list[str] = SELECTION) -> DataFrame:
    """Destinations and times shown in the matrix, and all flight records of the selection."""
    return heatmap_of(_dest_time_counts(flights, airports, keys), keys)


def heatmap_of(counts: DataFrame, keys: list[str]) -> DataFrame:
    shown = F.when(F.col("dest_name").isNotNull(), F.col("crs_dep_time"))
    return counts.groupBy(*keys).agg(
        F.count_distinct("dest_name").alias("destinations"),
        F.count_distinct(shown).alias("departure_times"),
        F.sum("n").alias("flight_records"),
    )


# Delay causes -------------------------------------------------------------------------

def causes_long(wide: DataFrame, keys: list[str], labels: dict[str, str]) -> DataFrame:
    """Turn one aggregated column per cause into one row per cause."""
    return (
        wide.unpivot(keys, CAUSES, "cause", "avg_minutes")
        .withColumn("delay_type", fn.cause_label(F.col("cause"), labels))
    )


def cause_mean_positive(flights: DataFrame, keys: list[str] = SELECTION) -> DataFrame:
    """Mean of each cause over the flights where it is positive; causes with none are absent.

    The five means are one aggregation; only its result is unpivoted.
    """
    wide = flights.groupBy(*keys).agg(
        *[F.avg(F.when(F.col(c) > 0, F.col(c))).alias(c) for c in CAUSES])
    return require(causes_long(wide, keys, CAUSE_LABELS_SHORT), ["avg_minutes"])


def cause_mean_delayed(flights: DataFrame, keys: list[str] = SELECTION) -> DataFrame:
    """Mean of each cause over all delayed flights, zeros included; only positive means."""
    wide = flights.where(fn.is_delayed()).groupBy(*keys).agg(
        *[F.avg(F.coalesce(c, F.lit(0.0))).alias(c) for c in CAUSES])
    return causes_long(wide, keys, CAUSE_LABELS_LONG).where("avg_minutes > 0")


def ranked_causes(causes: DataFrame) -> DataFrame:
    """Largest mean first, for one selection."""
    return causes.orderBy(F.desc("avg_minutes"), "cause")


def has_cause(flights: DataFrame, keys: list[str] = SELECTION) -> DataFrame:
    present = reduce(or_, [F.coalesce(F.col(c), F.lit(0.0)) > 0 for c in CAUSES])
    return flights.groupBy(*keys).agg(F.bool_or(present).alias("has_delays"))


# Averages -----------------------------------------------------------------------------

def _averages(flights: DataFrame, by: list, months, airlines) -> DataFrame:
    chosen = keep(
        flights, F.col("DOT_ID_Reporting_Airline").isNotNull(), by_airlines(airlines),
        in_months(months),
    )
    return chosen.groupBy(*by).agg(
        F.avg(fn.total_delay()).alias("avg_total_delay"), F.count(F.lit(1)).alias("flight_count"))


def _airline_code() -> Column:
    return F.col("DOT_ID_Reporting_Airline").cast("string").alias("airline_code")


def airline_label(rows: DataFrame, airlines: DataFrame, code: str = "airline_code") -> DataFrame:
    """Add ``code - name``, with a default for airlines that have no entry."""
    names = airlines.select(F.col("code").alias("_code"), F.col("description").alias("_name"))
    return (
        rows.join(names, F.col(code) == F.col("_code"), "left")
        .withColumn("airline_name", fn.code_name_label(F.col(code), F.col("_name")))
        .drop("_code", "_name")
    )


def airline_average(flights: DataFrame, airlines: DataFrame, months=ALL, airline_codes=ALL,
                    threshold: float = 30) -> DataFrame:
    """Average total delay per airline and whether it exceeds the threshold."""
    averages = _averages(flights, [_airline_code()], months, airline_codes)
    return airline_label(averages, airlines).withColumn(
        "over_threshold", F.col("avg_total_delay") > threshold)


def monthly_average(flights: DataFrame, months=ALL, airline_codes=ALL,
                    threshold: float = 30) -> DataFrame:
    averages = _averages(flights, ["Month"], months, airline_codes)
    return averages.withColumns({
        "month_name": fn.month_name(F.col("Month")),
        "over_threshold": F.col("avg_total_delay") > threshold,
    })


def daily_trend(flights: DataFrame, airlines: DataFrame, months=ALL, airline_codes=ALL,
                threshold: float = 30) -> DataFrame:
    averages = _averages(flights, [_airline_code(), F.col("DayofMonth")], months, airline_codes)
    return airline_label(averages, airlines).withColumn(
        "over_threshold", F.col("avg_total_delay") > threshold)


def month_airline_average(flights: DataFrame, airlines: DataFrame, months=ALL,
                          airline_codes=ALL) -> DataFrame:
    averages = _averages(flights, [F.col("Month"), _airline_code()], months, airline_codes)
    return airline_label(averages, airlines).withColumn(
        "month_name", fn.month_name(F.col("Month"))).drop("flight_count")


# Matrix columns, in calendar order.
MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July", "August",
               "September", "October", "November", "December"]


def month_airline_matrix(averages: DataFrame) -> DataFrame:
    """One row per airline, one column per month in calendar order."""
    return (
        averages.groupBy("airline_name").pivot("month_name", MONTH_NAMES)
        .agg(F.first("avg_total_delay"))
    )


def sorted_report(report: DataFrame, *by: str) -> DataFrame:
    """Report order: the given keys, or the largest average first."""
    return report.orderBy(*by) if by else report.orderBy(F.desc("avg_total_delay"), "airline_code")


def numbered(report: DataFrame) -> DataFrame:
    """A sorted report with ``row``, each row's place from 1, without bringing the rows into one task.

    A task knows its own order; how many rows stand before its first comes from the counts of the earlier tasks.
    """
    placed = materialize(report.withColumn("_place", F.monotonically_increasing_id()), "report-rows")
    part = F.shiftright("_place", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = F.col("_place") - F.shiftleft("_part", 33)
    return (placed.withColumn("_part", part).join(starts, "_part")
            .withColumn("row", F.col("_before") + within + 1).select(*report.columns, "row"))


# Labels -------------------------------------------------------------------------------

def airline_labels(flights: DataFrame, airlines: DataFrame) -> DataFrame:
    codes = require(flights, ["DOT_ID_Reporting_Airline"]).select(_airline_code()).distinct()
    return airline_label(codes, airlines)


def airport_labels(flights: DataFrame, airports: DataFrame) -> DataFrame:
    """Every airport flown from or to, labelled with either default for unknown names."""
    routes = flights.select("OriginAirportID", "DestAirportID").distinct()
    ids = require(routes.select(F.explode(F.array(*routes.columns)).alias("id")), ["id"]).distinct()
    side = airport_side(airports, "_id", "airport_name", "lat", "lon").select("_id", "airport_name")
    named = ids.join(side, F.col("id") == F.col("_id"), "left")
    code = F.col("id").cast("string")
    return named.select(
        code.alias("code"), "airport_name",
        fn.code_only_label(code, F.col("airport_name")).alias("label_or_code"),
        fn.code_name_label(code, F.col("airport_name")).alias("label_or_unknown"),
    )


# Flight listing -----------------------------------------------------------------------

# Display names of the listing.
LISTING = {
    "fl_num": "Flight #",
    "orig_name": "Origin Airport",
    "dest_name": "Destination Airport",
    "crs_dep_time": "Scheduled Dep Time",
    "status": "Status",
}
LISTING_ROWS = 500


def _listing_order() -> list[Column]:
    """Departure time (absent as 0), then every shown column: ties are equal rows."""
    shown = ["crs_dep_time", "fl_num", "orig_name", "dest_name", "is_delay", *CAUSES]
    return [F.col("crs_dep_time_sort"), *[F.col(c) for c in shown]]


def flight_listing(rows: DataFrame, rows_shown: int = LISTING_ROWS,
                   keys: list[str] | None = None) -> DataFrame:
    """The first flights by departure time under their display names.

    Over one selection this is a top-k of the whole frame; with ``keys`` every selection
    keeps its own first rows, cut in each task before the shuffle.
    """
    if keys:
        window = Window.partitionBy(*keys).orderBy(*_listing_order())
        first = rows.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= rows_shown)
    else:
        first = rows.orderBy(*_listing_order()).limit(rows_shown)
    return first.withColumn("status", fn.status_text(F.col("is_delay"))).select(
        *(keys or []), *[F.col(c).alias(shown) for c, shown in LISTING.items()], *CAUSES)
