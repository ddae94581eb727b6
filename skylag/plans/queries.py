"""Every operator as a query over whole tables derived from the given ones."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from skylag import functions as fn
from skylag.operators import analog, filters, lookup, model, options, reports, routes, scenario, states
from skylag.plans.reports import averages_report, date_choices
from skylag.schemas import DATE_KEYS, HIST_COLUMNS, PERCENTILES
from skylag.session import materialize, shared_folder
from skylag.store import kept
from skylag.sources import (
    FlightTables, finish_flights, flight_tables, land_flights, read_airlines, read_airports, read_flights, read_flights_csv,
    read_lookup, register_views, sql_over,
)
from skylag.sources.summaries import read_availability, read_lookup_cells, refresh_availability, refresh_lookup_states

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters of the filter queries.
DATE = (2024, 7, 15)
ROUTE = (10001, 10002)
DESTS = [10002, 10004]
DEP_TIME = 815
MONTH_DOW = (7, 3)
REPORT_AIRLINES = [19790, 20304]
REPORT_MONTHS = [1, 2, 3, 5, 7, 8, 11, 12]
THRESHOLD = 30
MEAN_MAX_K = 25
PICKED_TIMES = ["08:00", "17:30"]
CALENDAR_COLUMNS = [*DATE_KEYS, "OriginAirportID", "DestAirportID", "CRSDepTime"]


def query(build: Callable[[FlightTables], DataFrame]) -> Callable[[FlightTables], DataFrame]:
    """Register a function of the three tables under its own name."""
    @wraps(build)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(flight_tables(spark, sf_dir))
    QUERIES[build.__name__] = run
    return build


def rounded(frame: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """Interpolated values differ between engines in the last bit."""
    return frame.withColumns({c: F.round(c, digits) for c in columns})


# Sources ------------------------------------------------------------------------------

@query
def scan_flights(t):
    return t.flights


@query
def scan_airports(t):
    return t.airports


@query
def scan_airlines(t):
    return t.airlines


def as_csv(frame: DataFrame, purpose: str) -> str:
    """Write a frame as gzip CSV with a header to the shared folder."""
    path = shared_folder(frame.sparkSession, purpose)
    frame.write.option("header", True).option("compression", "gzip").csv(path)
    return path


@query
def landed_flights(t):
    path = shared_folder(t.spark, "landed-flights")
    land_flights(t.facts, path, finish=finish_flights)
    return read_flights(t.spark, path)


@query
def csv_flights(t):
    return read_flights_csv(t.spark, as_csv(t.flights, "csv-flights"))


@query
def csv_airports(t):
    named = t.airports.select(F.col("code").alias("Code"), F.col("airport_name").alias("Airport Name"),
                              F.col("latitude").alias("Latitude"), F.col("longitude").alias("Longitude"))
    return read_airports(t.spark, as_csv(named, "csv-airports"))


@query
def csv_airlines(t):
    named = t.airlines.select(F.col("code").alias("Code"), F.col("description").alias("Description"))
    return read_airlines(t.spark, as_csv(named, "csv-airlines"))


@query
def sql_view_query(t):
    register_views(t.flights, t.airports, t.airlines)
    return t.flights.sparkSession.sql("""
        SELECT a.description, g.airport_name, count(*) AS flights,
               sum(coalesce(f.ArrDelayMinutes, 0)) AS arrival_minutes
        FROM flights f
        LEFT JOIN airlines a ON f.DOT_ID_Reporting_Airline = CAST(a.code AS INT)
        LEFT JOIN geo g ON f.OriginAirportID = CAST(g.code AS INT)
        GROUP BY a.description, g.airport_name
    """)


@query
def sql_named_frames(t):
    return sql_over("""
        SELECT a.description, g.airport_name, count(*) AS flights,
               sum(coalesce(f.ArrDelayMinutes, 0)) AS arrival_minutes
        FROM {flights} f
        LEFT JOIN {airlines} a ON f.DOT_ID_Reporting_Airline = CAST(a.code AS INT)
        LEFT JOIN {geo} g ON f.OriginAirportID = CAST(g.code AS INT)
        GROUP BY a.description, g.airport_name
    """, t.flights, t.airports, t.airlines)


def landed(t: FlightTables) -> str:
    """The flights as landed Parquet, written once per state of the data."""
    return kept(t.spark, "landed", _flight_files(t.sf_dir), lambda folder: land_flights(t.facts, folder + "/flights", finish=finish_flights)) + "/flights"


def wide_file(t: FlightTables) -> str:
    """The flights as one writes them from pandas: every whole number as bigint, or as double where some are absent."""
    wide = {c: F.col(c).cast("bigint") for c in (*DATE_KEYS, "Flight_Number_Reporting_Airline", "OriginAirportID", "DestAirportID")}
    partial = {c: F.col(c).cast("double") for c in ("DOT_ID_Reporting_Airline", "CRSDepTime")}

    def build(folder: str) -> None:
        t.flights.withColumns({**wide, **partial}).write.parquet(folder + "/flights")
    return kept(t.spark, "wide-flights", _flight_files(t.sf_dir), build) + "/flights"


@query
def pushed_selection(t):
    chosen = filters.selection(origin=ROUTE[0], dests=DESTS, dep_time=DEP_TIME, status="Delayed")
    return read_flights(t.spark, wide_file(t), *chosen)


@query
def pushed_date(t):
    return read_flights(t.spark, wide_file(t), *filters.selection(date=DATE))


@query
def pushed_month_dow(t):
    return read_flights(t.spark, landed(t), filters.on_month_dow(*MONTH_DOW))


# Filters and projections --------------------------------------------------------------

@query
def filter_date(t):
    return filters.select_flights(t.flights, date=DATE)


@query
def filter_route(t):
    return filters.keep(t.flights, filters.on_route(*ROUTE))


@query
def filter_dest_in(t):
    return filters.select_flights(t.flights, dests=DESTS)


@query
def filter_dep_time(t):
    return filters.select_flights(t.flights, dep_time=DEP_TIME)


@query
def filter_delayed(t):
    return filters.select_flights(t.flights, status="Delayed")


@query
def filter_on_time(t):
    return filters.select_flights(t.flights, status="On-Time")


@query
def filter_month_dow(t):
    return filters.keep(t.flights, filters.on_month_dow(*MONTH_DOW))


@query
def filter_required(t):
    return filters.require(t.flights)


@query
def filter_combined(t):
    return filters.select_flights(
        t.flights, origin=ROUTE[0], dests=DESTS, dep_time=DEP_TIME, status="Delayed")


@query
def null_fill(t):
    return filters.fill_measures(t.flights)


@query
def flight_rows(t):
    return filters.flight_rows(t.flights)


def _picks(t: FlightTables) -> DataFrame:
    """Heatmap cells: the named airports, each with one of the picked times."""
    named = t.airports.where(F.col("airport_name").isNotNull())
    late = F.col("code").cast("int") % 2
    return named.select(
        F.col("airport_name").alias("dest_name"),
        F.when(late == 0, PICKED_TIMES[0]).otherwise(PICKED_TIMES[1]).alias("crs_dep_time"),
    )


@query
def cross_filter(t):
    rows = routes.enrich_flights(t.flights, t.airports)
    return filters.cross_filter(rows, _picks(t)).select(
        *DATE_KEYS, "fl_num", "origin", "dest", "orig_name", "dest_name", "crs_dep_time", "is_delay")


# Routes -------------------------------------------------------------------------------

@query
def enrich_flights(t):
    return routes.enrich_flights(t.flights, t.airports)


@query
def route_summary(t):
    return routes.route_summary(t.flights, t.airports)


@query
def route_summary_known(t):
    return routes.route_summary_known(t.flights, t.airports)


@query
def route_arcs(t):
    return routes.route_arcs(routes.route_summary(t.flights, t.airports))


@query
def airport_points(t):
    return routes.airport_points(routes.route_summary(t.flights, t.airports))


@query
def route_geometry(t):
    return routes.route_geometry(t.flights, t.airports)


@query
def map_center(t):
    return routes.map_center(t.flights, t.airports)


# Choices ------------------------------------------------------------------------------

@query
def date_range(t):
    return options.date_range(t.flights)


@query
def date_range_parts(t):
    return options.date_range_parts(t.flights)


@query
def airports_by_date(t):
    return options.airports_by_date(t.flights, t.airports)


@query
def dests_by_origin_date(t):
    return options.dests_by_origin_date(t.flights, t.airports)


@query
def dep_times(t):
    return options.dep_times(t.flights)


@query
def airlines_by_route(t):
    return options.airlines_by_route(t.flights)


@query
def airlines_all(t):
    return options.airlines_all(t.flights)


@query
def default_airlines(t):
    return options.default_airlines(t.flights, t.airlines)


@query
def availability_cube(t):
    return options.availability_cube(t.flights)


@query
def availability_origins(t):
    return options.availability_origins(options.availability_cube(t.flights), t.airports)


@query
def availability_dests(t):
    return options.availability_dests(options.availability_cube(t.flights), t.airports)


@query
def availability_airlines(t):
    return options.availability_airlines(options.availability_cube(t.flights), t.airlines)


@query
def availability_hours(t):
    return options.availability_hours(options.availability_cube(t.flights))


def stored_availability(t: FlightTables) -> DataFrame:
    """The cube from its stored table; summer is refreshed twice, as after a correction."""
    def build(folder: str) -> None:
        flights = read_flights(t.spark, landed(t), schedule=True)
        years = (2023, 2024)
        refresh_availability(flights, folder + "/cube", [(y, m) for y in years for m in range(1, 9)])
        refresh_availability(flights, folder + "/cube", [(y, m) for y in years for m in range(7, 13)])
    return read_availability(t.spark, kept(t.spark, "availability", _flight_files(t.sf_dir), build) + "/cube")


@query
def stored_availability_cube(t):
    return stored_availability(t)


@query
def stored_availability_origins(t):
    return options.availability_origins(stored_availability(t), t.airports)


@query
def stored_availability_dests(t):
    return options.availability_dests(stored_availability(t), t.airports)


@query
def stored_availability_airlines(t):
    return options.availability_airlines(stored_availability(t), t.airlines)


@query
def stored_availability_hours(t):
    return options.availability_hours(stored_availability(t))


# Reports ------------------------------------------------------------------------------

@query
def absent_causes(t):
    kept_causes = t.flights.drop("WeatherDelay", "SecurityDelay")
    return filters.add_missing_causes(kept_causes).select(*t.flights.columns)


@query
def origins_in_order(t):
    """The first choice of the history view with its place in the list."""
    return reports.numbered(date_choices(t)["origins"])


@query
def airline_average_in_order(t):
    return reports.numbered(averages_report(t, REPORT_MONTHS, REPORT_AIRLINES, THRESHOLD)["by_airline"])


@query
def daily_trend_in_order(t):
    return reports.numbered(averages_report(t, REPORT_MONTHS, REPORT_AIRLINES, THRESHOLD)["by_day"])


@query
def airline_labels(t):
    return reports.airline_labels(t.flights, t.airlines)


@query
def airport_labels(t):
    return reports.airport_labels(t.flights, t.airports)


@query
def kpi_summary(t):
    return reports.kpi_summary(t.flights)


@query
def dest_time_ratio(t):
    return reports.dest_time_ratio(t.flights, t.airports)


@query
def dest_time_matrix(t):
    ratios = reports.dest_time_ratio(t.flights, t.airports, ["OriginAirportID"])
    return reports.dest_time_matrix(ratios, reports.shown_times(ratios), ["OriginAirportID"])


@query
def heatmap_summary(t):
    return reports.heatmap_summary(t.flights, t.airports)


@query
def cause_mean_positive(t):
    return reports.cause_mean_positive(t.flights)


@query
def cause_mean_delayed(t):
    return reports.cause_mean_delayed(t.flights)


@query
def has_cause(t):
    return reports.has_cause(t.flights)


@query
def airline_average(t):
    return reports.airline_average(
        t.flights, t.airlines, REPORT_MONTHS, REPORT_AIRLINES, THRESHOLD)


@query
def monthly_average(t):
    return reports.monthly_average(t.flights, REPORT_MONTHS, REPORT_AIRLINES, THRESHOLD)


@query
def daily_trend(t):
    return reports.daily_trend(t.flights, t.airlines, REPORT_MONTHS, REPORT_AIRLINES, THRESHOLD)


@query
def month_airline_average(t):
    return reports.month_airline_average(t.flights, t.airlines, REPORT_MONTHS, REPORT_AIRLINES)


@query
def month_airline_matrix(t):
    return reports.month_airline_matrix(
        reports.month_airline_average(t.flights, t.airlines, REPORT_MONTHS, REPORT_AIRLINES))


@query
def flight_listing(t):
    return reports.flight_listing(routes.enrich_flights(t.flights, t.airports))


@query
def flight_listing_by_origin(t):
    rows = routes.enrich_flights(t.flights, t.airports)
    return reports.flight_listing(rows, keys=["origin"])


# The history view from one scan -------------------------------------------------------

@query
def history_kpis(t):
    return states.kpi_summary(states.selection_states(t.flights))


@query
def history_routes(t):
    return states.route_summary(states.selection_states(t.flights), t.airports)


@query
def history_center(t):
    return states.map_center(states.selection_states(t.flights), t.airports)


@query
def history_dest_by_time(t):
    return states.dest_time_ratio(states.selection_states(t.flights), t.airports)


@query
def history_heatmap(t):
    return states.heatmap_summary(states.selection_states(t.flights), t.airports)


@query
def history_causes_positive(t):
    return states.cause_mean_positive(states.selection_states(t.flights))


@query
def history_causes_delayed(t):
    return states.cause_mean_delayed(states.selection_states(t.flights))


@query
def history_has_cause(t):
    return states.has_cause(states.selection_states(t.flights))


# Scalar rules -------------------------------------------------------------------------

@query
def format_time(t):
    return t.flights.select("CRSDepTime", fn.format_time(F.col("CRSDepTime")).alias("shown"))


@query
def dep_hour(t):
    return t.flights.select("CRSDepTime", fn.dep_hour(F.col("CRSDepTime")).alias("hour"))


@query
def iso_dow(t):
    return t.flights.select(*DATE_KEYS, fn.iso_dow(fn.flight_date()).alias("dow"))


@query
def calendar_names(t):
    dow = fn.iso_dow(fn.flight_date())
    hour = fn.dep_hour(F.col("CRSDepTime"))
    return t.flights.select(
        *DATE_KEYS,
        fn.month_name(F.col("Month")).alias("month_name"),
        fn.day_name(dow).alias("day_name"),
        fn.date_text(*[F.col(c) for c in DATE_KEYS]).alias("date_text"),
        fn.hour_text(hour).alias("hour_text"),
    )


@query
def ratio_color(t):
    ratio = F.col("delay_ratio")
    shares = routes.route_summary(t.flights, t.airports).select("delay_ratio").distinct()
    return shares.select(
        ratio, *[c.alias(n) for n, c in fn.ratio_color(ratio).items()],
        fn.status_label(ratio).alias("status_label"), fn.pct_label(ratio).alias("pct_delayed"))


# Analog forecasts ---------------------------------------------------------------------

def stored_history(t: FlightTables) -> DataFrame:
    """The forecast history as a table, written once per state of the data: requests and search both read it."""
    def build(folder: str) -> None:
        analog.training_rows(t.flights).write.parquet(folder + "/rows")
    return t.spark.read.parquet(kept(t.spark, "training-rows", _flight_files(t.sf_dir), build) + "/rows")


def analog_requests(history: DataFrame) -> DataFrame:
    """Every (route, airline, month, hour) that occurs, on a date of 2024, with k from 3 to 20; and a route never flown."""
    slots = filters.require(history, ["airline"]).select(
        *analog.ROUTE_AIRLINE, F.col("Month").alias("month"), F.col("DepHour").alias("hour"),
    ).distinct()
    never = history.sparkSession.createDataFrame([(99999, 10001, 19790, 7, 8)], slots.schema)
    day = (F.col("hour") * 3 + F.col("month")) % 28 + 1
    return slots.unionByName(never).select(
        *analog.ROUTE_AIRLINE, "month", day.alias("day"),
        fn.iso_dow(F.make_date(F.lit(2024), "month", day)).alias("dow"), "hour",
        ((F.col("month") * 5 + F.col("hour")) % 18 + 3).alias("k"))


@query
def training_rows(t):
    return analog.training_rows(t.flights)


@query
def analog_candidates(t):
    history = stored_history(t)
    return analog.analog_candidates(analog_requests(history), history)


@query
def analog_neighbors(t):
    history = stored_history(t)
    return analog.shown_neighbors(analog.analog_neighbors(analog_requests(history), history))


@query
def analog_forecast(t):
    history = stored_history(t)
    forecast = analog.analog_forecast(analog_requests(history), history)
    return rounded(forecast, list(PERCENTILES), 4)


def mean_requests(history: DataFrame) -> DataFrame:
    """Every (route, month, hour) that occurs, on a date of 2024, with k from 3 to 25, and a route never flown."""
    day = (F.col("DepHour") * 5 + F.col("Month") * 2) % 28 + 1
    slots = history.select(
        *analog.MEAN_KEYS, F.col("Month").alias("month"), day.alias("day"),
        fn.iso_dow(F.make_date(F.lit(2024), "Month", day)).alias("dow"),
        F.col("DepHour").alias("hour"), ((F.col("Month") * 7 + F.col("DepHour")) % 23 + 3).alias("k"),
    ).distinct()
    never = history.sparkSession.createDataFrame([(99999, 10001, 7, 15, 1, 8, 5)], slots.schema)
    return slots.unionByName(never)


@query
def knn_mean_forecast(t):
    history = stored_history(t)
    return rounded(analog.knn_mean_forecast(mean_requests(history), history, max_k=MEAN_MAX_K), ["forecast"])


@query
def knn_neighbors(t):
    history = stored_history(t)
    return rounded(analog.knn_neighbors(mean_requests(history), history, max_k=MEAN_MAX_K), ["distance"]).select(
        *analog.MEAN_KEYS, *analog.POINT, "k", "rank", "distance", "TotalDelay")


# Lookup, scenarios and models ---------------------------------------------------------

def model_requests(flights: DataFrame) -> DataFrame:
    """Every flown (airline, route) on the last Wednesday of each month of 2024, at one hour
    of each time-of-day class, and one flight from an airport to itself, never flown before."""
    flown = filters.require(flights, ["DOT_ID_Reporting_Airline"]).select(
        F.col("DOT_ID_Reporting_Airline").cast("string").alias("carrier_code"),
        F.col("OriginAirportID").cast("string").alias("origin_id"),
        F.col("DestAirportID").cast("string").alias("dest_id"),
    ).distinct()
    month_end = F.last_day(F.make_date(F.lit(2024), F.col("m"), F.lit(1)))
    planned = (
        flown.withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(12))))
        .withColumn("date", F.next_day(F.date_sub(month_end, 7), "WED"))
        .withColumn("hour", F.explode(F.array(*[F.lit(h) for h in (5, 8, 13, 17)])))
        .select(*scenario.MODEL_REQUEST)
    )
    never = flights.sparkSession.range(1).select(
        F.lit("19790").alias("carrier_code"), F.lit("10001").alias("origin_id"),
        F.lit("10001").alias("dest_id"), F.lit("2024-12-25").cast("date").alias("date"),
        F.lit(8).alias("hour"))
    return planned.unionByName(never)


LOOKUP_VALUES = ["avg_crs_elapsed_time", "avg_distance", *HIST_COLUMNS]

# Offline jobs run once per state of the data; everything else reads their output.

def _flight_files(sf_dir: str) -> list[str]:
    return [f"{sf_dir}/{table}.parquet" for table in ("lineitem", "orders", "customer", "supplier")]


def written_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lookup cells as a table in the shared folder, so that no reader aggregates again."""
    def build(folder: str) -> None:
        lookup.lookup_cells(flight_tables(spark, sf_dir).flights).write.parquet(f"{folder}/cells")
    return spark.read.parquet(f"{kept(spark, 'lookup-cells', _flight_files(sf_dir), build)}/cells")


def trained(spark: SparkSession, sf_dir: str, trees: int = 12, depth: int = 4) -> str:
    """Folder of the fitted models."""
    def build(folder: str) -> None:
        training = scenario.training_table(written_cells(spark, sf_dir))
        model.save_models(model.fit_models(training, trees, depth), folder)
    return kept(spark, "delay-models", _flight_files(sf_dir), build, trees=trees, depth=depth)


# Labels that are an exact function of month and weekday: what two-level trees learn from them has a closed form,
# so that scoring, split counts and attributions can be held against SQL. Weights of (Month > 6), (DayOfWeek > 3).
STEPS = {"p10": (0.5, 0.25), "p50": (1.0, 0.5), "p90": (2.0, 1.0)}


def trained_steps(spark: SparkSession, sf_dir: str) -> str:
    """Folder of models fitted on the lookup cells with the labels of ``STEPS``."""
    def build(folder: str) -> None:
        late, end = (F.col("Month") > 6).cast("double"), (F.col("DayOfWeek") > 3).cast("double")
        training = scenario.training_table(written_cells(spark, sf_dir)).withColumns(
            {f"label_{p}": a * late + b * end for p, (a, b) in STEPS.items()})
        model.save_models(model.fit_models(training, trees=2, depth=2), folder)
    return kept(spark, "step-models", _flight_files(sf_dir), build, steps=STEPS)


@query
def inference_lookup(t):
    return rounded(lookup.inference_lookup(lookup.lookup_cells(t.flights)), LOOKUP_VALUES)


@query
def merged_lookup(t):
    """The lookup from stored value counts of two overlapping landings."""
    def build(folder: str) -> None:
        refresh_lookup_states(filters.keep(t.flights, F.col("Month") <= 7), folder + "/states")
        refresh_lookup_states(filters.keep(t.flights, F.col("Month") >= 7), folder + "/states")
    folder = kept(t.spark, "lookup-states", _flight_files(t.sf_dir), build)
    return rounded(lookup.inference_lookup(read_lookup_cells(t.spark, folder + "/states")), LOOKUP_VALUES)


@query
def read_lookup_table(t):
    path = shared_folder(t.spark, "lookup")
    lookup.inference_lookup(written_cells(t.spark, t.sf_dir)).write.parquet(path)
    return rounded(read_lookup(t.spark, path), LOOKUP_VALUES)


@query
def lookup_backoff(t):
    requests = scenario.keyed_requests(model_requests(t.flights))
    table = lookup.inference_lookup(written_cells(t.spark, t.sf_dir))
    return rounded(lookup.lookup_backoff(requests, table), LOOKUP_VALUES)


@query
def scenario_features(t):
    table = lookup.inference_lookup(written_cells(t.spark, t.sf_dir))
    return rounded(scenario.scenario_features(model_requests(t.flights), table), LOOKUP_VALUES)


@query
def model_training_table(t):
    labels = [f"label_{p}" for p in PERCENTILES]
    return rounded(
        scenario.training_table(lookup.lookup_cells(t.flights)), [*LOOKUP_VALUES, *labels])


def model_query(build, fitted=trained) -> Query:
    """Register a query that scores with the models of ``fitted``."""
    @wraps(build)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = fitted(spark, sf_dir)
        tables = flight_tables(spark, sf_dir)
        table = lookup.inference_lookup(written_cells(spark, sf_dir))
        features = scenario.scenario_features(model_requests(tables.flights), table)
        return build(spark, features, folder)
    QUERIES[build.__name__] = run
    return build


def step_query(build) -> Query:
    """Register a query that scores with the models whose answers have a closed form."""
    return model_query(build, trained_steps)


@model_query
def model_forecast(spark, features, folder):
    return model.model_forecast(features, model.load_models(folder))


@model_query
def feature_importance(spark, features, folder):
    return model.feature_importance(model.split_counts(spark, folder))


@model_query
def attribution(spark, features, folder):
    return model.attribution(features, folder)


@model_query
def attribution_top(spark, features, folder):
    return model.attribution_top(model.attribution(features, folder))


@model_query
def feature_descriptions(spark, features, folder):
    important = model.feature_importance(model.split_counts(spark, folder))
    top = model.attribution_top(model.attribution(features, folder))
    return model.feature_descriptions(important, top)


@model_query
def attribution_residual(spark, features, folder):
    """What contributions and base value lack to the log prediction: nothing."""
    logs = model.log_forecast(features, model.load_models(folder))
    logs = logs.unpivot(scenario.MODEL_REQUEST, list(PERCENTILES), "percentile", "log")
    keys = [*scenario.MODEL_REQUEST, "percentile"]
    sums = model.attribution(features, folder).groupBy(*keys).agg(
        (F.sum("contribution") + F.first("base_value")).alias("explained"))
    return sums.join(logs, keys).select(*keys, (F.round(F.col("explained") - F.col("log"), 6) + 0.0).alias("residual"))


@step_query
def step_forecast(spark, features, folder):
    return rounded(model.model_forecast(features, model.load_models(folder)), list(PERCENTILES))


@step_query
def step_importance(spark, features, folder):
    return model.feature_importance(model.split_counts(spark, folder))


@step_query
def step_attribution(spark, features, folder):
    found = rounded(model.attribution(features, folder), ["contribution", "base_value"])
    return found.select(*scenario.MODEL_REQUEST, "percentile", "feature", (F.col("contribution") + 0.0).alias("contribution"), "base_value")


@step_query
def step_descriptions(spark, features, folder):
    """The two features that the models test, with their texts."""
    important = model.feature_importance(model.split_counts(spark, folder))
    return model.feature_descriptions(important, important)


@step_query
def step_attribution_top(spark, features, folder):
    found = model.attribution_top(rounded(model.attribution(features, folder), ["contribution", "base_value"]))
    return found.withColumn("contribution", F.col("contribution") + 0.0)


@step_query
def step_descriptions_union(spark, features, folder):
    """The most used feature of each model and the ten with the largest contributions, with their texts."""
    important = model.feature_importance(model.split_counts(spark, folder), top=1)
    attributed = model.attribution_top(rounded(model.attribution(features, folder), ["contribution", "base_value"]))
    return model.feature_descriptions(important, attributed)
