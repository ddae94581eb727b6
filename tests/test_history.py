"""Filters, routes, choices and reports on hand-made flights."""

import datetime

import pytest

from skylag.operators import filters, options, reports, routes
from skylag.plans.reports import averages_report, history_report
from skylag.schemas import CAUSES

LATE, FINE, UNKNOWN = dict(ArrDel15=1.0), {}, dict(ArrDel15=None, DepDel15=None)


def test_on_time_keeps_unknown_flags(make_flights):
    flights = make_flights(LATE, FINE, UNKNOWN, dict(ArrDel15=None, DepDel15=1.0))
    assert filters.select_flights(flights, status="Delayed").count() == 2
    assert filters.select_flights(flights, status="On-Time").count() == 2
    assert filters.select_flights(flights).count() == 4
    with pytest.raises(ValueError):
        filters.with_status("Late")


@pytest.mark.parametrize("choice", [None, "ALL", [], ["ALL"]])
def test_open_choices_do_not_filter(choice):
    assert filters.to_dests(choice) is None and filters.by_airlines(choice) is None


def test_selection_parts_combine(make_flights):
    flights = make_flights(*[dict(DestAirportID=d, CRSDepTime=t) for d in (1, 2) for t in (800, 900)])
    assert filters.select_flights(flights, (2024, 7, 1), "10001", ["2"], "800").count() == 1
    assert filters.select_flights(flights, (2024, 7, 2)).count() == 0


def test_key_table_filter(spark, make_flights):
    flights = make_flights(dict(DestAirportID=1), dict(DestAirportID=2))
    keys = spark.createDataFrame([(2,), (2,)], "DestAirportID int")
    assert [r.DestAirportID for r in filters.keep_keys(flights, keys, ["DestAirportID"]).collect()] == [2]


def test_absent_causes_are_zero(make_flights):
    rows = filters.flight_rows(make_flights({}).drop("NASDelay")).first()
    assert all(rows[c] == 0.0 for c in CAUSES)


def test_cross_filter_is_wider_than_the_cells(spark, make_flights, airports):
    flights = make_flights(*[dict(DestAirportID=d, OriginAirportID=o, CRSDepTime=t)
                             for o, d in ((10001, 10002), (10002, 10001)) for t in (800, 900)])
    rows = routes.enrich_flights(flights, airports)
    picks = spark.createDataFrame([("Alpha", "08:00"), ("Beta", "09:00")],
                                  "dest_name string, crs_dep_time string")
    assert filters.cross_filter(rows, picks).count() == 4


def test_unknown_airports_kept_or_dropped(make_flights, airports):
    flights = make_flights(LATE, FINE, dict(DestAirportID=10003), dict(DestAirportID=10009),
                           dict(Flight_Number_Reporting_Airline=None))
    kept = {r.dest: r for r in routes.route_summary(flights, airports).collect()}
    assert set(kept) == {"10002", "10003", "10009"} and kept["10009"].dest_lat is None
    assert (kept["10002"].total_flights, kept["10002"].delayed_count) == (3, 1)
    known = routes.route_summary_known(flights, airports).collect()
    assert [(r.dest, r.total_flights, r.pct_delayed) for r in known] == [("10002", 2, "50.0%")]


def test_points_repeat_per_ratio(make_flights, airports):
    flights = make_flights(LATE, FINE, dict(DestAirportID=10003), dict(DestAirportID=10009))
    points = routes.airport_points(routes.route_summary(flights, airports)).collect()
    assert sorted(p.delay_ratio for p in points if p.type == "Origin") == [0.0, 0.5]
    assert len([p for p in points if p.type == "Destination"]) == 3
    assert all(p.total_flights is None for p in points)


def test_center_weighs_flights(make_flights, airports):
    flights = make_flights({}, {}, {}, dict(OriginAirportID=10002, CRSDepTime=None))
    row = routes.map_center(flights, airports).first()
    assert (row.center_lat, row.first_lat) == (15.0, 30.0)


def test_impossible_range_falls_back(make_flights):
    flights = make_flights(dict(Month=2, DayofMonth=1), dict(Month=2, DayofMonth=28),
                           dict(Month=1, DayofMonth=31))
    assert tuple(options.date_range_parts(flights).first()) == options.DEFAULT_RANGE
    assert tuple(options.date_range(flights).first()) == (
        datetime.date(2024, 1, 31), datetime.date(2024, 2, 28))
    none = options.date_range_parts(flights.where("Year = 1"))
    assert tuple(none.first()) == options.DEFAULT_RANGE


def test_totals_agree(make_flights, airports):
    flights = make_flights(LATE, FINE, UNKNOWN, dict(OriginAirportID=10002, DestAirportID=10001))
    kpis = reports.kpi_summary(flights).collect()
    assert sum(r.total_flights for r in kpis) == 4
    assert all(r.on_time_flights + r.delayed_flights == r.total_flights for r in kpis)
    summary = routes.route_summary(flights, airports)
    assert summary.groupBy().sum("total_flights").first()[0] == 4


def test_cause_means(make_flights):
    flights = make_flights(dict(ArrDel15=1.0, CarrierDelay=10.0), dict(ArrDel15=1.0),
                           dict(CarrierDelay=30.0))
    assert [(r.delay_type, r.avg_minutes) for r in reports.cause_mean_positive(flights).collect()] == [
        ("Carrier", 20.0)]
    assert [(r.cause, r.avg_minutes) for r in reports.cause_mean_delayed(flights).collect()] == [
        ("CarrierDelay", 5.0)]
    assert reports.has_cause(flights).first().has_delays is True
    assert reports.has_cause(make_flights(FINE)).first().has_delays is False


def test_matrix_keeps_gaps(make_flights, airports):
    flights = make_flights(LATE, dict(CRSDepTime=900, OriginAirportID=10002, DestAirportID=10001))
    ratios = reports.dest_time_ratio(flights, airports, ["Year"])
    assert reports.shown_times(ratios) == ["08:00", "09:00"]
    rows = reports.dest_time_matrix(ratios, ["09:00", "08:00"], ["Year"]).orderBy("dest_name").collect()
    assert rows[0].__fields__ == ["Year", "dest_name", "08:00", "09:00"]
    assert [tuple(r) for r in rows] == [(2024, "Alpha", None, 0.0), (2024, "Beta", 1.0, None)]


def test_listing_is_ordered_and_cut(make_flights, airports):
    flights = make_flights(*[dict(CRSDepTime=t, Flight_Number_Reporting_Airline=i)
                             for i, t in enumerate([900, None, 800])])
    rows = routes.enrich_flights(flights, airports)
    listed = reports.flight_listing(rows, rows_shown=2).collect()
    assert [r["Scheduled Dep Time"] for r in listed] == ["N/A", "08:00"]
    assert reports.flight_listing(rows, 1, keys=["origin"]).count() == 1


def test_reports_run(make_flights, airports, airlines):
    class Tables:
        flights = make_flights(LATE, FINE, dict(DOT_ID_Reporting_Airline=None))
    Tables.airports, Tables.airlines = airports, airlines
    assert all(frame.count() for frame in history_report(Tables, origin=10001).values()
               if "avg_minutes" not in frame.columns)
    averages = averages_report(Tables, months=[7], airlines=[19790])
    assert averages["by_airline"].first().airline_name == "19790 - First Air"
    assert averages["matrix"].first().July == 0.0


def test_matrix_has_every_time_that_occurs(make_flights, airports):
    flights = make_flights({}, dict(CRSDepTime=1111), dict(CRSDepTime=None))
    ratios = reports.dest_time_ratio(flights, airports)
    assert reports.shown_times(ratios) == ["08:00", "11:11", "N/A"]
    assert reports.dest_time_matrix(ratios, reports.shown_times(ratios)).columns[-3:] == ["08:00", "11:11", "N/A"]
