"""The composite reports that no query covers whole."""

import datetime

from skylag.operators import analog
from skylag.operators.reports import numbered
from skylag.plans.reports import analog_report, averages_report, date_choices, history_report
from skylag.sources.star import flight_tables

SF_DIR = "/root/testdata/sf0.001"


def test_analog_report_maps_only_the_requested_routes(spark):
    tables = flight_tables(spark, SF_DIR)
    flown = analog.training_rows(tables.flights).where("airline is not null").first()
    asked = spark.createDataFrame(
        [(flown.origin, flown.dest, flown.airline, flown.Month, flown.DayofMonth, flown.DayOfWeek, flown.DepHour, 3),
         (99999, flown.dest, flown.airline, 1, 1, 1, 1, 3)],
        "origin int, dest int, airline int, month int, day int, dow int, hour int, k int")
    report = analog_report(tables, asked)
    assert report["forecast"].count() == 1 and report["neighbors"].count() <= 3
    assert {(r.origin, r.dest) for r in report["route_map"].collect()} <= {
        (str(flown.origin), str(flown.dest)), ("99999", str(flown.dest))}


def test_choices_are_in_order(spark):
    choices = date_choices(flight_tables(spark, SF_DIR))
    for name, keys in (("origins", ["Year", "Month", "DayofMonth", "code"]),
                       ("dests", ["Year", "Month", "DayofMonth", "origin", "code"])):
        rows = [tuple(r[k] for k in keys) for r in choices[name].collect()]
        assert rows and rows == sorted(rows)
    times = [(r.Year, r.Month, r.DayofMonth, r.origin, r.CRSDepTime or -1) for r in choices["times"].collect()]
    assert times == sorted(times)
    assert choices["range"].first()[0] <= datetime.date(2024, 12, 31)


def test_averages_come_sorted(spark):
    report = averages_report(flight_tables(spark, SF_DIR))
    months = [r.Month for r in report["by_month"].collect()]
    assert months == sorted(months) and len(months) == 12
    days = [(r.airline_code or "", r.DayofMonth) for r in report["by_day"].collect()]
    assert days == sorted(days)


def test_history_summaries_share_one_scan(spark):
    """All summaries read the written states; only rows and listing read the flights."""
    report = history_report(flight_tables(spark, SF_DIR), date=(2024, 7, 15))
    for name, frame in report.items():
        text = frame._jdf.queryExecution().executedPlan().toString()
        assert ("lineitem" in text) == (name in ("rows", "listing")), name
        assert name in ("rows", "listing") or "history-states" in text
    assert report["kpis"].agg({"total_flights": "sum"}).first()[0] == report["rows"].count() > 0


def test_rows_are_numbered_in_their_order(spark):
    frame = spark.range(1000, numPartitions=7).selectExpr("(id * 37) % 1000 AS x").orderBy("x")
    assert [(r.x, r.row) for r in numbered(frame).collect()] and all(r.row == r.x + 1 for r in numbered(frame).collect())
    assert numbered(frame.limit(0)).count() == 0


def test_every_statement_is_a_view():
    import duckdb

    from compare import duckdb_tables
    from skylag.plans.oracle import ORACLE

    connection = duckdb_tables(SF_DIR)
    failed = []
    for name, sql in ORACLE.items():
        try:
            connection.execute(f"CREATE VIEW v_{name} AS {sql}")
        except duckdb.Error as error:
            failed.append((name, str(error)[:80]))
    assert failed == []
