import csv
import gzip

import pytest
from pyspark.sql import functions as F

from skylag.operators import filters
from skylag.schemas import CAUSES, FLIGHTS
from skylag.operators import analog, lookup, options
from skylag.sources import (
    land_flights, read_airlines, read_airports, read_flights, read_flights_csv, read_lookup,
    register_views, sql_over,
)
from skylag.sources.readers import with_schedule_columns
from skylag.sources.summaries import read_availability, read_lookup_cells, refresh_availability, refresh_lookup_states


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_gzip_csv_without_cause_columns(spark, tmp_path):
    columns = [c for c in FLIGHTS.fieldNames() if c not in CAUSES]
    path = tmp_path / "flights.csv.gz"
    with gzip.open(path, "wt", newline="") as file:
        writer = csv.writer(file)
        writer.writerow(columns)
        for day in (1, 2, 3):
            writer.writerow([2024, 7, day, 12, 19790, 10001, 10002, "" if day == 3 else 815,
                             1, 2, 0, "", 90, 400])
    flights = read_flights_csv(spark, str(path), partitions=4)
    assert flights.schema.fieldNames() == FLIGHTS.fieldNames()
    assert flights.rdd.getNumPartitions() == 4
    rows = flights.orderBy("DayofMonth").collect()
    assert [r.CRSDepTime for r in rows] == [815, 815, None]
    assert [r.ArrDel15 for r in rows] == [None] * 3
    assert all(r[c] == 0.0 for r in rows for c in CAUSES)


def test_missing_required_column_fails(spark, tmp_path):
    (tmp_path / "f.csv").write_text("Year,Month\n2024,7\n")
    with pytest.raises(ValueError, match="OriginAirportID"):
        read_flights_csv(spark, str(tmp_path / "f.csv"))


def test_landed_flights_are_pruned_and_pushed(spark, make_flights, tmp_path):
    flights = make_flights(*[dict(Month=m, DayofMonth=d, OriginAirportID=10000 + d)
                             for m in (6, 7) for d in range(1, 8)])
    land_flights(flights, str(tmp_path / "landed"))
    landed = spark.read.parquet(str(tmp_path / "landed"))
    assert {"DayOfWeek", "DepHour"} <= set(landed.columns)
    again = read_flights(spark, str(tmp_path / "landed"))
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, flights.collect()), key=str)

    one = filters.select_flights(again, date=(2024, 7, 3), origin=10003)
    text = plan(one.select("CRSDepTime"))
    assert one.count() == 1
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    assert "Year" in scan.split("PartitionFilters")[1].split("]")[0]
    assert "EqualTo(OriginAirportID,10003)" in scan and "EqualTo(DayofMonth,3)" in scan
    assert "CRSDepTime" in scan.split("ReadSchema")[1] and "Distance" not in scan.split("ReadSchema")[1]


def test_schedule_columns(make_flights):
    row = with_schedule_columns(make_flights(dict(DayofMonth=7, CRSDepTime=1545))).first()
    assert (row.DayOfWeek, row.DepHour) == (7, 15)


def test_airports_are_typed_and_unique(spark, tmp_path):
    path = tmp_path / "geo.csv"
    path.write_text("Code,Airport Name,Latitude,Longitude,More\n1,Beta,1.5,2.5,x\n1,Alpha,9,9,x\n2,,3,4,x\n")
    rows = read_airports(spark, str(path)).orderBy("code").collect()
    assert [tuple(r) for r in rows] == [("1", "Alpha", 9.0, 9.0), ("2", None, 3.0, 4.0)]


def test_airlines_present_and_absent(spark, tmp_path):
    path = tmp_path / "airlines.csv"
    path.write_text("Code,Description\n19790,First Air\n")
    assert [tuple(r) for r in read_airlines(spark, str(path)).collect()] == [("19790", "First Air")]
    absent = read_airlines(spark, str(tmp_path / "none.csv"))
    assert absent.columns == ["code", "description"] and absent.count() == 0


def test_lookup_keys_become_text(spark, tmp_path):
    spark.createDataFrame([(1, 2, 3, 7)], "carrier_code int, origin_id int, dest_id int, month int") \
        .write.parquet(str(tmp_path / "lookup"))
    assert [tuple(r) for r in read_lookup(spark, str(tmp_path / "lookup")).collect()] == [("1", "2", "3", 7)]


def test_views(spark, make_flights, airports, airlines):
    register_views(make_flights({}), airports, airlines)
    assert spark.sql("SELECT count(*) FROM flights JOIN geo ON OriginAirportID = code").first()[0] == 1


def test_whole_numbers_written_with_a_fraction(spark, make_flights, tmp_path):
    """Integers as ``815.0``; a true fraction fails and names its column."""
    text = make_flights({}, dict(CRSDepTime=None)).withColumn("CRSDepTime", F.col("CRSDepTime").cast("double"))
    text.write.option("header", True).csv(str(tmp_path / "whole"))
    read = read_flights_csv(spark, str(tmp_path / "whole"))
    assert sorted((r.CRSDepTime or 0) for r in read.collect()) == [0, 800]
    assert read.schema["CRSDepTime"].dataType.simpleString() == "int"
    text.withColumn("CRSDepTime", F.lit(815.5)).write.option("header", True).csv(str(tmp_path / "broken"))
    with pytest.raises(Exception, match="CRSDepTime is not a whole number: 815.5"):
        read_flights_csv(spark, str(tmp_path / "broken")).collect()


def scan_line(frame):
    return next(line for line in plan(frame).splitlines() if "FileScan" in line)


@pytest.mark.parametrize("stored", ["int", "bigint", "double", "string"])
def test_clauses_meet_the_types_of_the_file(spark, make_flights, tmp_path, stored):
    """Whatever type whole numbers have, the selection is the same; numbers are compared inside the scan."""
    whole = [f.name for f in FLIGHTS.fields if f.dataType.simpleString() == "int"]
    flights = make_flights(*[dict(OriginAirportID=10001 + d % 3, DayofMonth=d, CRSDepTime=None if d == 9 else 800 + d) for d in range(1, 20)])
    flights.withColumns({c: F.col(c).cast(stored) for c in whole}).write.parquet(str(tmp_path / "f"))
    clauses = filters.selection(date=(2024, 7, 4), origin=10002, dests=[10002], dep_time=804, status="On-Time")
    found = read_flights(spark, str(tmp_path / "f"), *clauses)
    assert found.schema == flights.schema and [tuple(r) for r in found.collect()] == [
        tuple(r) for r in filters.keep(flights, *clauses).collect()]
    assert found.count() == 1
    if stored != "string":
        suffix = ".0" if stored == "double" else ""
        assert f"EqualTo(OriginAirportID,10002{suffix})" in scan_line(found)
        assert f"EqualTo(CRSDepTime,804{suffix})" in scan_line(found)
    weekday = read_flights(spark, str(tmp_path / "f"), filters.on_month_dow(7, 3))
    assert sorted(r.DayofMonth for r in weekday.collect()) == [3, 10, 17]


def test_stored_schedule_columns_are_taken(spark, make_flights, tmp_path):
    flights = make_flights(*[dict(DayofMonth=d, CRSDepTime=100 * d) for d in range(1, 15)])
    land_flights(flights, str(tmp_path / "landed"))
    wednesdays = read_flights(spark, str(tmp_path / "landed"), filters.on_month_dow(7, 3))
    assert "EqualTo(DayOfWeek,3)" in scan_line(wednesdays)
    assert sorted(r.DayofMonth for r in wednesdays.collect()) == [3, 10]
    landed = read_flights(spark, str(tmp_path / "landed"), schedule=True)
    assert landed.columns == [*FLIGHTS.fieldNames(), "DayOfWeek", "DepHour"]
    for build in (analog.training_rows, options.availability_cube, lookup.lookup_cells):
        assert "weekday" not in plan(build(landed)) and "weekday" in plan(build(flights))
        assert sorted(map(str, build(landed).collect())) == sorted(map(str, build(flights).collect()))


def months(*pairs):
    return [dict(Year=y, Month=m, DayofMonth=d, CRSDepTime=100 * d, ArrDelayMinutes=float(d * m), CarrierDelay=float(d)) for y, m in pairs
            for d in range(1, 12)]


def test_availability_is_refreshed_by_month(spark, make_flights, tmp_path):
    path = str(tmp_path / "cube")
    before, after = make_flights(*months((2024, 6), (2024, 7))), make_flights(*months((2024, 7), (2024, 8)), dict(Month=7, CRSDepTime=2300))
    refresh_availability(before, path)
    refresh_availability(after, path, [(2024, 7)])
    refresh_availability(after.where("Month = 8"), path)
    rows = read_availability(spark, path)
    whole = make_flights(*months((2024, 6), (2024, 7), (2024, 8)), dict(Month=7, CRSDepTime=2300))
    assert rows.schema == options.availability_cube(whole).schema
    assert sorted(map(str, rows.collect())) == sorted(map(str, options.availability_cube(whole).collect()))


def test_lookup_states_merge(spark, make_flights, tmp_path):
    """Two landings, one month in both: the cells are those of all flights at once."""
    path = str(tmp_path / "states")
    flights = make_flights(*months((2023, 6), (2023, 7), (2024, 6), (2024, 7)), dict(DOT_ID_Reporting_Airline=None), dict(CRSDepTime=None))
    refresh_lookup_states(flights.where("Month = 6"), path)
    refresh_lookup_states(flights, path, [(2023, 6), (2023, 7), (2024, 7)])
    merged, whole = read_lookup_cells(spark, path), lookup.lookup_cells(flights)
    assert merged.columns == whole.columns
    assert sorted(map(str, merged.collect())) == sorted(map(str, whole.collect()))


def test_statements_over_frames_leave_no_view(spark, make_flights, airports, airlines):
    before = {t.name for t in spark.catalog.listTables()}
    one = sql_over("SELECT count(*) AS n FROM {flights}", make_flights({}), airports, airlines)
    two = sql_over("SELECT count(*) AS n FROM {flights}", make_flights({}, {}), airports, airlines)
    assert (one.first().n, two.first().n) == (1, 2)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_landing_shuffles_and_sorts_only_what_flights_follow_from(spark):
    from skylag.sources import finish_flights, flight_tables
    from skylag.sources.readers import landing_rows

    t = flight_tables(spark, "/root/testdata/sf0.001")
    rows, plain = landing_rows(t.facts, finish_flights), landing_rows(t.flights)
    assert rows.schema == plain.schema and rows.count() > 0
    assert rows.exceptAll(plain).isEmpty() and plain.exceptAll(rows).isEmpty()
    behind, moved = rows._jdf.queryExecution().optimizedPlan().toString().split("RebalancePartitions", 1)
    assert "Sort [" in behind and all(f"AS {c}#" in behind for c in (*CAUSES, "DepDelayMinutes", "CRSDepTime", "DepHour"))
    assert not any(c in moved for c in (*CAUSES, "DepDelayMinutes", "CRSDepTime", "DepHour")) and len(t.facts.columns) <= 10
    # Line items meet orders without the columns that their few numbers are made of.
    joined = moved.split("Join Inner")[1]
    assert not any(c in joined for c in ("l_quantity", "l_partkey", "l_shipdate"))
