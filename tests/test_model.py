"""Lookup, back-off, features, models and their explanations."""

import datetime
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylag.operators import lookup, model, scenario
from skylag.plans.reports import model_report
from skylag.schemas import FEATURE_DESCRIPTIONS, FEATURES, HIST_COLUMNS, LOOKUP_KEYS, STAT_DEFAULTS


def test_feature_list():
    assert len(FEATURES) == 25 == len(FEATURE_DESCRIPTIONS) and list(FEATURE_DESCRIPTIONS) == FEATURES
    assert FEATURES[10:13] == ["hist_p10_carrier_delay", "hist_p50_carrier_delay", "hist_p90_carrier_delay"]
    assert FEATURES[-1] == "hist_p90_late_aircraft_delay"


def test_cells_hold_exact_percentiles(make_flights):
    delays = [float(x) for x in (0, 3, 7, 20, 45, 46, 90)]
    hot = [dict(CarrierDelay=d, ArrDelayMinutes=d, Distance=400.0 + d) for d in delays for _ in range(50)]
    flights = make_flights(*hot, dict(CRSDepTime=1300), dict(CRSDepTime=None),
                           dict(DOT_ID_Reporting_Airline=None))
    cells = lookup.lookup_cells(flights)
    assert cells.count() == 2
    row = cells.where("time_of_day_category = 2").first()
    expected = np.quantile(np.repeat(delays, 50), [0.1, 0.5, 0.9])
    assert [row[f"hist_{p}_carrier_delay"] for p in ("p10", "p50", "p90")] == pytest.approx(list(expected))
    assert [row.total_p10, row.total_p50, row.total_p90] == pytest.approx(list(expected))
    assert row.avg_distance == pytest.approx(400 + np.mean(delays))
    rough = lookup.lookup_cells(flights, accuracy=1000).where("time_of_day_category = 2").first()
    assert [rough.total_p10, rough.total_p50, rough.total_p90] == [0.0, 20.0, 90.0]
    assert lookup.inference_lookup(cells).columns == [
        *LOOKUP_KEYS, "avg_crs_elapsed_time", "avg_distance", *HIST_COLUMNS]


@pytest.fixture(scope="module")
def table(spark):
    """Cells told apart by their distance; one statistic is unknown."""
    cells = [("1", "A", "B", 7, 3, 2, 101.0), ("1", "A", "B", 7, 1, 2, 102.0),
             ("1", "A", "B", 5, 6, 2, 103.0), ("1", "A", "B", 5, 2, 4, None)]
    frame = spark.createDataFrame(
        cells, "carrier_code string, origin_id string, dest_id string, month int, dow int, "
        "time_of_day_category int, avg_distance double")
    return frame.withColumns({c: F.lit(None).cast("double") for c in STAT_DEFAULTS if c != "avg_distance"})


def test_backoff_levels(spark, table):
    asked = [("1", "A", "B", 7, 3, 2), ("1", "A", "B", 7, 5, 2), ("1", "A", "B", 9, 3, 2),
             ("1", "A", "B", 7, 3, 1), ("2", "A", "B", 7, 3, 2), ("1", "A", "B", 5, 2, 4)]
    requests = spark.createDataFrame([(i, *r) for i, r in enumerate(asked)],
                                     "id int, carrier_code string, origin_id string, dest_id string, "
                                     "month int, dow int, time_of_day_category int")
    rows = lookup.lookup_backoff(requests, table).orderBy("id").collect()
    assert [(r.match_level, r.avg_distance) for r in rows] == [
        (1, 101.0), (2, 102.0), (3, 103.0), (4, 1000.0), (4, 1000.0), (1, 1000.0)]
    assert all(r.avg_crs_elapsed_time == 180.0 and r.hist_p90_nas_delay == 0.0 for r in rows)


@pytest.fixture(scope="module")
def planned(spark):
    dates = [datetime.date(2024, 7, 4), datetime.date(2024, 5, 11), datetime.date(2024, 12, 25)]
    return spark.createDataFrame(
        [("1", "A", "B", d, h) for d in dates for h in (5, 8, 17)] + [("9", "A", "A", dates[0], 8)],
        "carrier_code string, origin_id string, dest_id string, date date, hour int")


def test_scenario_features(spark, table, planned):
    features = scenario.scenario_features(planned, table)
    assert features.columns == [*scenario.MODEL_REQUEST, *FEATURES]
    row = features.where("month(date) = 7 AND hour = 8 AND carrier_code = '1'").first()
    assert (row.time_of_day_category, row.Month, row.DayOfWeek) == (2, 7, 4)
    assert (row.pct_weekday, row.has_holiday_effect, row.has_peak_hour) == (1, 1, 1)
    assert (row.avg_distance, row.distance_category, row.season) == (102, 1, 3)
    weekend = features.where("month(date) = 5 AND hour = 5").first()
    assert (weekend.pct_weekday, weekend.has_holiday_effect, weekend.has_peak_hour) == (0, 0, 0)


@pytest.fixture(scope="module")
def fitted(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        x = rng.integers(1, 5, len(FEATURES)).astype(float)
        y = np.log1p(2 * x[0] + x[1] * x[10] + (5 if x[24] > 2 else 0))
        rows.append(("1", "A", "B", *map(float, x), float(y / 2), float(y), float(y * 1.5)))
    schema = "carrier_code string, origin_id string, dest_id string, " + ", ".join(
        f"{c} double" for c in [*FEATURES, "label_p10", "label_p50", "label_p90"])
    training = spark.createDataFrame(rows, schema)
    folder = str(tmp_path_factory.mktemp("models"))
    model.save_models(model.fit_models(training, trees=5, depth=3), folder)
    return folder


def test_forecast_and_explanations(spark, table, planned, fitted):
    folder, models = fitted, model.load_models(fitted)
    features = scenario.scenario_features(planned, table)
    forecast = model.model_forecast(features, models).collect()
    assert len(forecast) == 10
    assert all(f.p10 >= 0 and f.crossed == (f.p10 > f.p50 or f.p50 > f.p90) for f in forecast)

    contributions = model.attribution(features.union(features), folder)
    assert contributions.count() == 10 * 25 * 3
    sums = contributions.groupBy(*scenario.MODEL_REQUEST, "percentile").agg(
        (F.sum("contribution") + F.first("base_value")).alias("log"))
    predicted = {tuple(f[c] for c in scenario.MODEL_REQUEST): f for f in forecast}
    for r in sums.collect():
        expected = predicted[tuple(r[c] for c in scenario.MODEL_REQUEST)][r.percentile]
        assert max(0, np.expm1(r.log)) == pytest.approx(expected, abs=1e-9)

    top = model.attribution_top(contributions)
    per_request = top.groupBy(*scenario.MODEL_REQUEST, "percentile").count().collect()
    assert {r["count"] for r in per_request} == {10} and len(per_request) == 30
    first = top.where("percentile = 'p50' AND hour = 8 AND month(date) = 7 AND carrier_code = '1'")
    order = [FEATURES.index(r.feature) for r in first.orderBy("position").collect()]
    assert order == sorted(order)


def test_attribution_is_the_shapley_value(spark, fitted):
    """Against the definition: mean marginal change over all orders, per tree."""
    rng = np.random.default_rng(11)
    names = {f: float(v) for f, v in zip(FEATURES, rng.integers(1, 5, 25))}
    features = spark.createDataFrame(
        [("1", "A", "B", datetime.date(2024, 7, 4), 8, *names.values())],
        "carrier_code string, origin_id string, dest_id string, date date, hour int, "
        + ", ".join(f"{f} double" for f in FEATURES))
    x = list(names.values())
    got = {(r.percentile, r.feature): r for r in model.attribution(features, fitted).collect()}
    for p, fitted_model in model.load_models(fitted).items():
        nodes = {(n.treeID, n.id): n for n in model._nodes(spark, fitted, p).collect()}
        expected, base = np.zeros(25), 0.0
        for tree, weight in enumerate(fitted_model.treeWeights):

            def value(known, node_id=0):
                node = nodes[tree, node_id]
                if node.leftChild < 0:
                    return node.prediction
                if node.feature_index in known:
                    left = x[node.feature_index] <= node.threshold
                    return value(known, node.leftChild if left else node.rightChild)
                counts = [nodes[tree, c].rawCount for c in (node.leftChild, node.rightChild)]
                return (value(known, node.leftChild) * counts[0]
                        + value(known, node.rightChild) * counts[1]) / sum(counts)

            used = sorted({n.feature_index for (t, _), n in nodes.items() if t == tree and n.leftChild >= 0})
            orders = list(itertools.permutations(used))
            base += weight * value(set())
            for order in orders:
                for i, feature in enumerate(order):
                    change = value(set(order[:i + 1])) - value(set(order[:i]))
                    expected[feature] += weight * change / len(orders)
        assert [got[p, f].contribution for f in FEATURES] == pytest.approx(list(expected), abs=1e-12)
        assert got[p, FEATURES[0]].base_value == pytest.approx(base)


def test_attribution_does_not_depend_on_unused_features(spark, table, planned, fitted):
    """A feature that no tree splits on contributes nothing."""
    used = {r.feature for r in model.split_counts(spark, fitted).collect()}
    rows = model.attribution(scenario.scenario_features(planned, table), fitted)
    rest = rows.where(~F.col("feature").isin(sorted(used)))
    assert rest.count() and rest.agg(F.max(F.abs("contribution"))).first()[0] < 1e-12


def test_split_counts_match_the_trees(spark, fitted):
    models = model.load_models(fitted)
    counts = {r.percentile: r.n for r in model.split_counts(spark, fitted)
              .groupBy("percentile").agg(F.sum("splits").alias("n")).collect()}
    for p, fitted_model in models.items():
        assert counts[p] == sum((t.numNodes - 1) // 2 for t in fitted_model.trees)
    important = model.feature_importance(model.split_counts(spark, fitted), top=3).collect()
    for p in models:
        ranked = sorted((r for r in important if r.percentile == p), key=lambda r: r["rank"])
        assert [r.splits for r in ranked] == sorted((r.splits for r in ranked), reverse=True)
        assert len(ranked) <= 3


def test_descriptions(spark):
    important = spark.createDataFrame([("p10", "season"), ("p10", "mystery")], "percentile string, feature string")
    attributed = spark.createDataFrame([("p10", "season"), ("p50", "Month")], "percentile string, feature string")
    rows = {(r.percentile, r.feature): r.description
            for r in model.feature_descriptions(important, attributed).collect()}
    assert len(rows) == 3 and rows["p10", "mystery"] == "No description available."
    assert rows["p50", "Month"] == "Month of flight (1-12)"


def test_model_report(table, planned, fitted):
    frames = model_report(planned, table, fitted)
    assert frames["route_facts"].count() == 10
    assert frames["descriptions"].where("description LIKE 'No desc%'").count() == 0


def test_contributions_of_deep_paths_add_up():
    """Eight tested features: for every set of passed tests the contributions sum to what the leaf gains over its base."""
    shares = [0.1, 0.9, 0.5, 0.3, 0.7, 0.2, 0.6, 0.8]
    parts = model._shapley_parts(model.Leaf(2.0, {f: (0.0, 1.0, s) for f, s in enumerate(shares)}))
    base = 2.0 * math.prod(shares)
    assert len(parts) == 256
    assert all(sum(row) == pytest.approx((2.0 if mask == 255 else 0.0) - base) for mask, row in enumerate(parts))


def test_too_deep_trees_fail_before_their_contributions_are_computed():
    with pytest.raises(ValueError, match="take .* bytes"):
        model._bounded([model.Leaf(1.0, {f: (0.0, 1.0, 0.5) for f in range(20)})], 0)
