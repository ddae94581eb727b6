"""Analog forecasts against brute force, with one key holding a third of all flights."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylag.operators import analog

SLOT = ["origin", "dest", "airline"]
REQUEST = "origin string, dest string, airline string, month int, day int, dow int, hour int, k int"
HISTORY = ("origin string, dest string, airline string, Year int, DayofMonth int, DayOfWeek int, "
           "Month int, DepHour int, DepTime int, TotalDelay double")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)

    def flight(dest):
        hour = rng.choice([8, 9])
        return ("A", dest, "1", rng.choice([2022, 2023, 2024]), rng.randint(1, 28), rng.randint(1, 7),
                rng.choice([6, 7]), hour, hour * 100 + rng.choice([0, 15]), float(rng.randint(-3, 60)))
    spread = [flight(d) for d in "BCD" for _ in range(400)]
    hot = [("A", "B", "1", 2024, 15, 2, 7, 8, 800, 12.0)] * 300      # copies of one flight
    hot += [("A", "B", "1", 2024, 16, 2, 7, 8, 800 + i % 60, float(i % 97)) for i in range(300)]
    return spread + hot


@pytest.fixture(scope="module")
def requests():
    return [("A", d, "1", m, day, dow, h, k) for d in "BCDE" for m in (6, 7) for h in (8, 9)
            for day, dow, k in ((15, 2, 10), (3, 5, 20), (28, 7, 3))]


def brute_candidates(rows, request):
    origin, dest, airline, month, day, dow, hour, _ = request
    same = {r for r in rows if r[:3] == (origin, dest, airline) and r[6] == month and r[7] == hour}
    return [(r, "DOW") for r in same if r[5] == dow] + [(r, "DOM") for r in same if r[4] == day]


def brute_neighbors(rows, request):
    day, dow, k = request[4], request[5], request[7]
    ranked = sorted(
        (math.hypot(day - r[4], dow - r[5]), -r[3], r[4], r[8], r[9], tag)
        for r, tag in brute_candidates(rows, request))
    return ranked[:k]


def brute_percentiles(neighbors):
    delays = np.array([max(n[4], 0) for n in neighbors])
    if len(neighbors) < 3:
        return [delays.mean()] * 3
    weights = 1 / np.array([n[0] or 1e-6 for n in neighbors])
    order = np.argsort(delays, kind="stable")
    cum = np.cumsum(weights[order])
    return list(np.interp([0.1, 0.5, 0.9], cum / cum[-1], delays[order]))


def test_neighbors_and_percentiles_match_brute_force(spark, rows, requests):
    history = spark.createDataFrame(rows, HISTORY)
    asked = spark.createDataFrame(requests + requests[:5], REQUEST)
    got = defaultdict(list)
    for r in analog.analog_neighbors(asked, history).orderBy("rank").collect():
        got[tuple(r[c] for c in analog.REQUEST)].append(
            (r.distance, -r.Year, r.DayofMonth, r.DepTime, r.TotalDelay, r.Group))
    forecasts = {tuple(r[c] for c in analog.REQUEST): r
                 for r in analog.analog_forecast(asked, history).collect()}
    answered = 0
    for request in requests:
        expected = brute_neighbors(rows, request)
        assert got.get(request, []) == expected
        if expected:
            answered += 1
            f = forecasts[request]
            assert f.k_eff == len(expected)
            assert [f.p10, f.p50, f.p90] == pytest.approx(brute_percentiles(expected), abs=1e-9)
            assert f.p10 <= f.p50 <= f.p90
    assert 30 < answered == len(forecasts)
    assert not any(key[1] == "E" for key in forecasts)


def test_candidates_keep_both_rules_and_collapse_copies(spark, rows, requests):
    history = spark.createDataFrame(rows, HISTORY)
    found = analog.analog_candidates(spark.createDataFrame(requests, REQUEST), history)
    expected = sum(len(brute_candidates(rows, r)) for r in requests)
    assert found.count() == expected
    both = found.where("DayofMonth = day AND DayOfWeek = dow AND dest = 'B' AND TotalDelay = 12 AND DepTime = 800")
    assert {r.Group for r in both.where("day = 15").collect()} == {"DOW", "DOM"}


def test_few_neighbors_fall_back_to_the_mean(spark):
    neighbors = spark.createDataFrame([("x", 1, -5.0, 0.0), ("x", 2, 30.0, 1.0)],
                                      "id string, rank int, TotalDelay double, distance double")
    row = analog.weighted_percentiles(neighbors, ["id"]).first()
    assert (row.k_eff, row.p10, row.p50, row.p90) == (2, 15.0, 15.0, 15.0)


def test_exact_match_dominates(spark):
    neighbors = spark.createDataFrame(
        [("x", 1, 40.0, 0.0), ("x", 2, 0.0, 1.0), ("x", 3, 90.0, 2.0)],
        "id string, rank int, TotalDelay double, distance double")
    row = analog.weighted_percentiles(neighbors, ["id"]).first()
    assert row.p90 == pytest.approx(36, abs=1e-3) and row.p90 < 40


@pytest.mark.parametrize("k", [0, 21, None])
def test_k_out_of_bounds_fails(spark, rows, k):
    history = spark.createDataFrame(rows[:50], HISTORY)
    asked = spark.createDataFrame([("A", "B", "1", 7, 15, 2, 8, k)], REQUEST)
    with pytest.raises(Exception, match="k must lie in 1..20"):
        analog.analog_forecast(asked, history).collect()


@pytest.mark.parametrize("keys", [["origin", "dest"], ["origin", "dest", "airline"]])
def test_route_mean_matches_brute_force(spark, rows, keys):
    """Dense and thin neighbourhoods, and a route with fewer flights than k."""
    lone = [("A", "F", "1", 2024, 1, 1, 1, 1, 100, 5.0), ("A", "F", "1", 2024, 1, 1, 12, 23, 2300, 9.0)]
    flights = rows + lone
    asked = [("A", d, "1", m, day, dow, h, k) for d in "BCF" for m, h in ((7, 8), (6, 9), (12, 0), (7, 24))
             for day, dow, k in ((15, 2, 5), (31, 7, 20), (1, 1, 1))]
    found = analog.knn_mean_forecast(
        spark.createDataFrame(asked, REQUEST), spark.createDataFrame(flights, HISTORY), keys).collect()
    got = {(r.dest, r.month, r.day, r.dow, r.hour, r.k): r for r in found}
    assert len(got) == len(asked)
    for _, dest, _, month, day, dow, hour, k in asked:
        nearest = sorted(
            ((r[4] - day) ** 2 + (r[5] - dow) ** 2 + (r[6] - month) ** 2 + (r[7] - hour) ** 2,
             -r[3], r[6], r[4], r[8], r[9]) for r in flights if r[1] == dest)[:k]
        row = got[dest, month, day, dow, hour, k]
        assert row.neighbors == len(nearest)
        assert row.forecast == pytest.approx(max(0, np.mean([n[5] for n in nearest])))


def test_history_drops_unknown_times(make_flights):
    history = analog.training_rows(make_flights({}, dict(CRSDepTime=None), dict(DOT_ID_Reporting_Airline=None)))
    assert history.count() == 2 and analog.distinct_history(history).count() == 1
    assert analog.training_rows(make_flights({}, dict(DOT_ID_Reporting_Airline=20304)), ["20304"]).count() == 1


def test_cells_keep_their_first_flights(spark, rows):
    history = spark.createDataFrame(rows, HISTORY)
    cut = analog.first_per_cell(history, SLOT, 2)
    assert cut.groupBy(*SLOT, *analog.LATTICE).count().agg(F.max("count")).first()[0] == 2


def test_a_route_without_history_gets_zero_from_no_neighbours(spark, rows):
    asked = spark.createDataFrame([("A", "nowhere", "1", 7, 15, 2, 8, 5), ("A", "B", "1", 7, 15, 2, 8, 25)], REQUEST)
    found = {r.dest: (r.neighbors, r.forecast) for r in analog.knn_mean_forecast(asked, spark.createDataFrame(rows, HISTORY)).collect()}
    assert found["nowhere"] == (0, 0.0) and found["B"][0] == 25


@pytest.mark.parametrize("k", [0, None])
def test_a_request_for_no_neighbours_fails(spark, rows, k):
    asked = spark.createDataFrame([("A", "B", "1", 7, 15, 2, 8, k)], REQUEST)
    with pytest.raises(Exception, match="k must be at least 1"):
        analog.knn_mean_forecast(asked, spark.createDataFrame(rows[:50], HISTORY))
