import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parents[1])]

from skylag.schemas import FLIGHTS  # noqa: E402
from skylag.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g",
        "spark.sql.maxMetadataStringLength": "2000",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_flights(spark):
    """Flights from dicts; unnamed columns take a plain on-time flight's values."""
    plain = dict(
        Year=2024, Month=7, DayofMonth=1, Flight_Number_Reporting_Airline=1,
        DOT_ID_Reporting_Airline=19790, OriginAirportID=10001, DestAirportID=10002, CRSDepTime=800,
        DepDelayMinutes=0.0, ArrDelayMinutes=0.0, DepDel15=0.0, ArrDel15=0.0, CarrierDelay=None,
        WeatherDelay=None, NASDelay=None, SecurityDelay=None, LateAircraftDelay=None,
        CRSElapsedTime=100.0, Distance=500.0)

    def make(*rows):
        return spark.createDataFrame(
            [tuple({**plain, **r}[c] for c in FLIGHTS.fieldNames()) for r in rows], FLIGHTS)
    return make


@pytest.fixture(scope="session")
def airports(spark):
    return spark.createDataFrame(
        [("10001", "Alpha", 10.0, 20.0), ("10002", "Beta", 30.0, 40.0), ("10003", None, 50.0, 60.0)],
        "code string, airport_name string, latitude double, longitude double")


@pytest.fixture(scope="session")
def airlines(spark):
    return spark.createDataFrame([("19790", "First Air")], "code string, description string")
