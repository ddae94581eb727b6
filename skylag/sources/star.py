"""Flight, airport and airline tables derived from the star-schema test tables.

The rules are those of FIXTURES.md; ``skylag.plans.oracle`` states the same in SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from skylag.schemas import CAUSES, DATE_KEYS

# The columns read, so that no file has to be opened to plan a query.
COLUMNS = {
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
                "l_quantity double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "orders": "o_orderkey long, o_custkey long",
    "customer": "c_custkey long, c_nationkey int",
    "supplier": "s_suppkey long, s_nationkey int",
    "nation": "n_nationkey int, n_name string",
    "region": "r_regionkey int, r_name string",
}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(COLUMNS[table]).parquet(f"{sf_dir}/{table}.parquet")


def flight_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: the few whole numbers that all columns of a flight follow from (``finish_flights``).

    Line items are reduced to them before any shuffle, so that what is moved and sorted is small. Orders and customers meet
    first, so line items are shuffled once for them. The merge
    hint states what Catalyst cannot estimate: that joined side is as long as the orders, and
    line items are longer still, so neither is to be broadcast; adaptive execution splits a hot
    order key. The supplier side is left to Catalyst's size check.
    """
    order_dest = _read(spark, sf_dir, "orders").join(
        _read(spark, sf_dir, "customer").selectExpr("c_custkey AS o_custkey", "c_nationkey % 5 AS d0"),
        "o_custkey",
    ).selectExpr("o_orderkey AS l_orderkey", "d0")
    lines = _read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_suppkey", "l_linenumber",
        "date_add(DATE'2023-01-01', datediff(l_shipdate, DATE'1995-01-01') % 731) AS dt",
        """CASE WHEN l_linenumber = 7 AND l_partkey % 10 = 9 THEN NULL
                WHEN l_partkey % 10 < 6 THEN 19790 WHEN l_partkey % 10 < 9 THEN 19805
                ELSE 20304 END AS DOT_ID_Reporting_Airline""",
        """CASE WHEN l_partkey % 53 = 0 THEN NULL
                WHEN l_returnflag = 'N' THEN 0
                WHEN l_returnflag = 'A' THEN cast(l_quantity AS int)
                WHEN l_returnflag = 'R' THEN cast(l_quantity AS int) % 20 END AS dep""",
        """CASE WHEN l_partkey % 53 = 0 OR l_suppkey % 61 = 0 THEN NULL
                WHEN l_linestatus = 'O' THEN (cast(l_quantity AS int) * 2) % 70
                WHEN l_linestatus = 'F' THEN cast(l_quantity AS int) % 12 END AS arr""",
    ).join(_read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS l_suppkey", "s_nationkey % 5 AS o"), "l_suppkey").drop("l_suppkey")
    return lines.join(order_dest.hint("merge"), "l_orderkey").selectExpr(
        "year(dt) AS Year", "month(dt) AS Month", "day(dt) AS DayofMonth",
        "DOT_ID_Reporting_Airline", "10001 + o AS OriginAirportID", "10001 + if(d0 = o, (d0 + 1) % 5, d0) AS DestAirportID",
        "l_orderkey", "l_linenumber", "dep", "arr",
    )


def finish_flights(facts: DataFrame) -> DataFrame:
    """The flights that ``flight_facts`` describe, row by row."""
    carrier, nas = "arr div 3", "arr div 5"
    weather = "if(l_linenumber = 1, arr div 4, 0)"
    security = "if(l_linenumber = 6, 2, 0)"
    causes = dict(zip(CAUSES, [
        carrier, weather, nas, security, f"arr - {carrier} - {weather} - {nas} - {security}"]))
    stretch = "abs(OriginAirportID - DestAirportID)"
    return facts.selectExpr(
        *DATE_KEYS, "cast(1 + l_orderkey % 9000 AS int) AS Flight_Number_Reporting_Airline", "DOT_ID_Reporting_Airline",
        "OriginAirportID", "DestAirportID",
        """CASE WHEN l_orderkey % 97 = 0 THEN NULL WHEN l_orderkey % 101 = 0 THEN 5
                WHEN l_orderkey % 103 = 0 THEN 2400
                ELSE cast(100 * CASE WHEN l_orderkey % 8 <= 2 THEN 8 WHEN l_orderkey % 8 <= 4 THEN 17
                                     WHEN l_orderkey % 8 = 5 THEN 6 WHEN l_orderkey % 8 = 6 THEN 13
                                     ELSE 22 END + (l_orderkey % 4) * 15 AS int) END AS CRSDepTime""",
        "cast(dep AS double) AS DepDelayMinutes", "cast(arr AS double) AS ArrDelayMinutes",
        "cast(if(dep >= 15, 1, dep - dep) AS double) AS DepDel15",
        "cast(if(arr >= 15, 1, arr - arr) AS double) AS ArrDel15",
        *[f"CASE WHEN arr >= 15 THEN cast({minutes} AS double) END AS {cause}"
          for cause, minutes in causes.items()],
        f"cast(60 + (200 + 450 * {stretch}) div 8 AS double) AS CRSElapsedTime",
        f"cast(200 + 450 * {stretch} AS double) AS Distance",
    )


def derive_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flight per line item."""
    return finish_flights(flight_facts(spark, sf_dir))


def derive_airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as airports: key 4 is missing and key 3 has no name."""
    return _read(spark, sf_dir, "nation").where("n_nationkey <> 4").selectExpr(
        "cast(10001 + n_nationkey AS string) AS code",
        "if(n_nationkey <> 3, n_name, NULL) AS airport_name",
        "cast(25 + 2.5D * n_nationkey AS double) AS latitude",
        "cast(-120 + 7.25D * n_nationkey AS double) AS longitude",
    )


def derive_airlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two regions as airlines; the third airline of the flights has no name."""
    return _read(spark, sf_dir, "region").where("r_regionkey IN (0, 1)").selectExpr(
        "if(r_regionkey = 0, '19790', '19805') AS code", "r_name AS description")


class FlightTables:
    """The three tables of one data folder, each built when first used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def facts(self) -> DataFrame:
        """The flights before ``finish_flights``."""
        return flight_facts(self.spark, self.sf_dir)

    @cached_property
    def flights(self) -> DataFrame:
        return finish_flights(self.facts)

    @cached_property
    def airports(self) -> DataFrame:
        return derive_airports(self.spark, self.sf_dir)

    @cached_property
    def airlines(self) -> DataFrame:
        return derive_airlines(self.spark, self.sf_dir)


def flight_tables(spark: SparkSession, sf_dir: str) -> FlightTables:
    return FlightTables(spark, sf_dir)
