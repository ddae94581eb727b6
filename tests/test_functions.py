import datetime

import pytest
from pyspark.sql import functions as F

from skylag import functions as fn
from skylag.schemas import CAUSE_LABELS_LONG


def values(spark, kind, inputs, rule):
    """The rule's result for each input, in order."""
    frame = spark.createDataFrame(list(enumerate(inputs)), f"i int, x {kind}")
    return [r[0] for r in frame.orderBy("i").select(rule(F.col("x"))).collect()]


def test_format_time(spark):
    assert values(spark, "int", [None, -1, 2401, 0, 5, 1545, 2400], fn.format_time) == [
        "N/A", "N/A", "N/A", "00:00", "00:05", "15:45", "24:00"]


def test_dep_hour_cuts(spark):
    assert values(spark, "int", [0, 59, 1545, 2400, None], fn.dep_hour) == [0, 0, 15, 24, None]


@pytest.mark.parametrize("ratio,color", [
    (-1.0, [0, 255, 0, 200]), (0.0, [0, 255, 0, 200]), (0.25, [127, 255, 0, 200]),
    (0.5, [255, 255, 0, 200]), (0.75, [255, 127, 0, 200]), (1.0, [255, 0, 0, 200]),
    (2.0, [255, 0, 0, 200])])
def test_ratio_color(spark, ratio, color):
    assert values(spark, "double", [ratio], fn.color_array) == [color]


def test_status_label_rounds_half_to_even(spark):
    assert values(spark, "double", [0.0, 1.0, 0.125, 0.375, 0.5, None], fn.status_label) == [
        "On-Time", "Delayed", "Mixed (12% delayed)", "Mixed (38% delayed)", "Mixed (50% delayed)", None]


def test_pct_label(spark):
    assert values(spark, "double", [0.0, 1 / 3, 0.0625, 1.0], fn.pct_label) == [
        "0.0%", "33.3%", "6.2%", "100.0%"]


def test_iso_dow(spark):
    days = [datetime.date(2024, 7, d) for d in range(1, 8)]
    assert values(spark, "date", days, fn.iso_dow) == [1, 2, 3, 4, 5, 6, 7]


def test_names(spark):
    assert values(spark, "int", [1, 12], fn.month_name) == ["January", "December"]
    assert values(spark, "int", [1, 7], fn.day_name) == ["Monday", "Sunday"]
    assert values(spark, "int", [6, 24, None], fn.hour_text) == ["06:00", "24:00", None]


def test_time_of_day_edges(spark):
    assert values(spark, "int", [5, 6, 11, 12, 16, 17, None], fn.time_of_day) == [1, 2, 2, 3, 3, 4, None]


def test_peak_edges(spark):
    assert values(spark, "int", [5, 6, 8, 9, 15, 16, 18, 19], fn.has_peak_hour) == [
        0, 1, 1, 0, 0, 1, 1, 0]


def test_distance_edges(spark):
    assert values(spark, "double", [249.0, 250.0, 749.0, 750.0, 1499.0, 1500.0], fn.distance_category) == [
        1, 2, 2, 3, 3, 4]


def test_season_and_weekday(spark):
    assert values(spark, "int", [12, 1, 2, 3, 5, 6, 8, 9, 11], fn.season) == [1, 1, 1, 2, 2, 3, 3, 4, 4]
    assert values(spark, "int", [1, 5, 6, 7], fn.weekday_share) == [1, 1, 0, 0]


def test_holidays(spark):
    frame = spark.createDataFrame(
        [(1, 1), (7, 4), (12, 25), (12, 26), (12, 24)], "m int, d int")
    flags = frame.select(fn.has_holiday_effect(F.col("m"), F.col("d"))).collect()
    assert [r[0] for r in flags] == [1, 1, 1, 1, 0]


def test_forecast_band_edges(spark):
    assert [v.split()[0] for v in values(spark, "double", [9.9, 10.0, 29.9, 30.0], fn.forecast_band)] == [
        "On-Time", "Minor", "Minor", "Significant"]


def test_log_delay_is_clamped(spark):
    assert values(spark, "double", [-1.0, 0.0], fn.from_log_delay) == [0.0, 0.0]


def test_labels(spark):
    frame = spark.createDataFrame([("1", "A"), ("2", None)], "c string, n string")
    rows = frame.select(fn.code_name_label(F.col("c"), F.col("n")),
                        fn.code_only_label(F.col("c"), F.col("n"))).collect()
    assert [tuple(r) for r in rows] == [("1 - A", "1 - A"), ("2 - Unknown", "2")]
    assert values(spark, "string", ["LateAircraftDelay"],
                  lambda c: fn.cause_label(c, CAUSE_LABELS_LONG)) == ["Late Aircraft"]
