"""One aggregation of a selection that all summaries of the history view are finished from.

``selection_states`` reduces the flights to one row of mergeable partial states (counts, sums, smallest departure) per date,
route and departure time. Every summary is an aggregation of these rows and no longer of the flights; written once (see
``skylag.session.materialize``), they let a report of nine summaries scan its flights once. Means are kept as sum and count, so
any coarser key is exact.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, functions as F

from skylag import functions as fn
from skylag.operators import reports, routes
from skylag.operators.filters import require
from skylag.operators.reports import SELECTION
from skylag.schemas import CAUSE_LABELS_LONG, CAUSE_LABELS_SHORT, CAUSES, DATE_KEYS

FINEST = [*DATE_KEYS, "OriginAirportID", "DestAirportID", "CRSDepTime"]


def selection_states(flights: DataFrame) -> DataFrame:
    """Partial states per date, route and departure time."""
    minutes = {c: F.coalesce(c, F.lit(0.0)) for c in CAUSES}
    return flights.groupBy(*FINEST).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(fn.is_delay()).alias("late"),
        F.min(routes.departure_order()).alias("departure"),
        F.bool_or(reduce(or_, [m > 0 for m in minutes.values()])).alias("any_cause"),
        *[F.sum(F.when(F.col(c) > 0, F.col(c))).alias(f"{c}_sum") for c in CAUSES],
        *[F.count(F.when(F.col(c) > 0, 1)).alias(f"{c}_n") for c in CAUSES],
        *[F.sum(F.when(fn.is_delayed(), m)).alias(f"{c}_late") for c, m in minutes.items()],
    )


def kpi_summary(states: DataFrame, keys: list[str] = SELECTION) -> DataFrame:
    counts = states.groupBy(*keys).agg(F.sum("n").alias("total_flights"), F.sum("late").alias("delayed_flights"))
    return reports.finished_kpis(counts, keys)


def route_summary(states: DataFrame, airports: DataFrame, keys: list[str] = DATE_KEYS) -> DataFrame:
    counted = states.groupBy(
        *keys, F.col("OriginAirportID").alias("origin"), F.col("DestAirportID").alias("dest"),
    ).agg(F.sum("n").alias("total_flights"), F.sum("late").alias("delayed_count"))
    return routes.finished_routes(routes.attach_airports(counted, airports), keys)


def map_center(states: DataFrame, airports: DataFrame, keys: list[str] = DATE_KEYS) -> DataFrame:
    per_origin = states.groupBy(*keys, "OriginAirportID").agg(F.sum("n").alias("n"), F.min("departure").alias("departure"))
    return routes.finished_center(per_origin, airports, keys)


def _dest_time_counts(states: DataFrame, airports: DataFrame, keys: list[str]) -> DataFrame:
    counts = states.groupBy(*keys, "DestAirportID", "CRSDepTime").agg(F.sum("n").alias("n"), F.sum("late").alias("late"))
    return reports.named_counts(counts, airports, keys)


def dest_time_ratio(states: DataFrame, airports: DataFrame, keys: list[str] = SELECTION) -> DataFrame:
    return reports.ratios_of(_dest_time_counts(states, airports, keys), keys)


def heatmap_summary(states: DataFrame, airports: DataFrame, keys: list[str] = SELECTION) -> DataFrame:
    return reports.heatmap_of(_dest_time_counts(states, airports, keys), keys)


def cause_mean_positive(states: DataFrame, keys: list[str] = SELECTION) -> DataFrame:
    wide = states.groupBy(*keys).agg(
        *[F.try_divide(F.sum(f"{c}_sum"), F.sum(f"{c}_n")).alias(c) for c in CAUSES])
    return require(reports.causes_long(wide, keys, CAUSE_LABELS_SHORT), ["avg_minutes"])


def cause_mean_delayed(states: DataFrame, keys: list[str] = SELECTION) -> DataFrame:
    wide = states.groupBy(*keys).agg(
        *[F.try_divide(F.sum(f"{c}_late"), F.sum("late")).alias(c) for c in CAUSES])
    return reports.causes_long(wide, keys, CAUSE_LABELS_LONG).where("avg_minutes > 0")


def has_cause(states: DataFrame, keys: list[str] = SELECTION) -> DataFrame:
    return states.groupBy(*keys).agg(F.bool_or("any_cause").alias("has_delays"))
