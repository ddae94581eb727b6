"""The four reports a user opens, as sets of DataFrames over all keys.

Most frames run when a caller writes or shows them. Building the matrix collects its column names, at most one per
minute of the day, and the model report loads the saved models.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skylag.operators import analog, model, options, reports, routes, scenario, states
from skylag.operators.filters import ALL, select_flights
from skylag.operators.lookup import lookup_backoff
from skylag.schemas import DATE_KEYS
from skylag.session import materialize
from skylag.sources import FlightTables


def history_report(tables: FlightTables, date=None, origin=None, dests=ALL, dep_time=ALL,
                   status: str = ALL) -> dict[str, DataFrame]:
    """Flight rows, map and matrix of a selection; open parts keep all keys.

    The selection is scanned once for all summaries: their common partial states are written first. Only the
    rows and their listing read the flights again.
    """
    flights = select_flights(tables.flights, date, origin, dests, dep_time, status)
    common = materialize(states.selection_states(flights), "history-states")
    summary = states.route_summary(common, tables.airports)
    rows = routes.enrich_flights(flights, tables.airports)
    by_time = states.dest_time_ratio(common, tables.airports)
    return {
        "rows": rows,
        "arcs": routes.route_arcs(summary),
        "points": routes.airport_points(summary),
        "center": states.map_center(common, tables.airports),
        "kpis": states.kpi_summary(common),
        "dest_by_time": by_time,
        "matrix": reports.dest_time_matrix(by_time, reports.shown_times(by_time)),
        "heatmap": states.heatmap_summary(common, tables.airports),
        "has_cause": states.has_cause(common),
        "causes_positive": states.cause_mean_positive(common),
        "causes_delayed": reports.ranked_causes(states.cause_mean_delayed(common)),
        "listing": reports.flight_listing(rows),
    }


def averages_report(tables: FlightTables, months=ALL, airlines=ALL,
                    threshold: float = 30) -> dict[str, DataFrame]:
    flights, names = tables.flights, tables.airlines
    by_month = reports.month_airline_average(flights, names, months, airlines)
    return {
        "default_airlines": options.default_airlines(flights, names),
        "by_airline": reports.sorted_report(
            reports.airline_average(flights, names, months, airlines, threshold)),
        "by_month": reports.sorted_report(
            reports.monthly_average(flights, months, airlines, threshold), "Month"),
        "by_day": reports.sorted_report(
            reports.daily_trend(flights, names, months, airlines, threshold),
            "airline_code", "DayofMonth"),
        "matrix": reports.month_airline_matrix(by_month),
    }


def analog_report(tables: FlightTables, requests: DataFrame) -> dict[str, DataFrame]:
    history = analog.training_rows(tables.flights)
    neighbors = analog.analog_neighbors(requests, history)
    return {
        "forecast": analog.analog_forecast(requests, history),
        "neighbors": analog.shown_neighbors(neighbors),
        "route_map": routes.route_geometry(requests.select(
            F.col("origin").alias("OriginAirportID"), F.col("dest").alias("DestAirportID")), tables.airports),
    }


def model_report(requests: DataFrame, lookup: DataFrame, folder: str) -> dict[str, DataFrame]:
    """Forecast with explanation from saved models and a written lookup."""
    models = model.load_models(folder)
    features = scenario.scenario_features(requests, lookup)
    important = model.feature_importance(model.split_counts(requests.sparkSession, folder))
    top = model.attribution_top(model.attribution(features, folder))
    return {
        "forecast": model.model_forecast(features, models),
        "importance": important,
        "attribution": top,
        "descriptions": model.feature_descriptions(important, top),
        "route_facts": lookup_backoff(scenario.keyed_requests(requests), lookup).select(
            *scenario.MODEL_REQUEST, "avg_distance", "avg_crs_elapsed_time"),
    }


def date_choices(tables: FlightTables) -> dict[str, DataFrame]:
    """What can be chosen before any report is opened."""
    flights, airports = tables.flights, tables.airports
    return {
        "range": options.date_range(flights),
        "origins": options.airports_by_date(flights, airports).orderBy(*DATE_KEYS, "code"),
        "dests": options.dests_by_origin_date(flights, airports).orderBy(
            *DATE_KEYS, "origin", "code"),
        "times": options.dep_times(flights).orderBy(*DATE_KEYS, "origin", "CRSDepTime"),
    }
