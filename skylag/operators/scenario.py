"""Feature rows for planned flights and for training."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skylag import functions as fn
from skylag.operators.lookup import lookup_backoff
from skylag.schemas import FEATURES, HIST_COLUMNS, PERCENTILES

MODEL_REQUEST = ["carrier_code", "origin_id", "dest_id", "date", "hour"]


def keyed_requests(requests: DataFrame) -> DataFrame:
    """Planned flights with the lookup keys that follow from date and hour."""
    return requests.select(
        *MODEL_REQUEST,
        F.month("date").alias("month"),
        fn.iso_dow(F.col("date")).alias("dow"),
        fn.time_of_day(F.col("hour")).alias("time_of_day_category"),
    )


def scenario_features(requests: DataFrame, lookup: DataFrame) -> DataFrame:
    """The 25 model features of every planned flight, after its identifying columns."""
    found = lookup_backoff(keyed_requests(requests), lookup)
    derived = found.select(
        *MODEL_REQUEST,
        F.col("time_of_day_category").cast("double").alias("time_of_day_category"),
        F.col("month").cast("double").alias("Month"),
        F.col("dow").cast("double").alias("DayOfWeek"),
        "avg_crs_elapsed_time", "avg_distance",
        fn.weekday_share(F.col("dow")).alias("pct_weekday"),
        fn.has_holiday_effect(F.col("month"), F.dayofmonth("date")).alias("has_holiday_effect"),
        fn.has_peak_hour(F.col("hour")).alias("has_peak_hour"),
        fn.distance_category(F.col("avg_distance")).alias("distance_category"),
        fn.season(F.col("month")).alias("season"),
        *HIST_COLUMNS,
    )
    return derived.select(*MODEL_REQUEST, *FEATURES)


def training_table(cells: DataFrame) -> DataFrame:
    """One row per lookup cell: its features and the log of its total-delay percentiles."""
    return cells.select(
        "carrier_code", "origin_id", "dest_id",
        F.col("time_of_day_category").cast("double").alias("time_of_day_category"),
        F.col("month").cast("double").alias("Month"),
        F.col("dow").cast("double").alias("DayOfWeek"),
        "avg_crs_elapsed_time", "avg_distance",
        fn.weekday_share(F.col("dow")).alias("pct_weekday"),
        "has_holiday_effect", "has_peak_hour",
        fn.distance_category(F.col("avg_distance")).alias("distance_category"),
        fn.season(F.col("month")).alias("season"),
        *HIST_COLUMNS,
        *[F.log1p(f"total_{p}").alias(f"label_{p}") for p in PERCENTILES],
    )
