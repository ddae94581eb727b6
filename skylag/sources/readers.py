"""Reading flights, airports, airlines and the lookup; landing flights as Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import FractionalType, IntegerType, StringType, StructField
from pyspark.sql.utils import AnalysisException

from skylag import functions as fn
from skylag.operators.filters import Clause, add_missing_causes, keep
from skylag.schemas import (
    AIRLINE_FILE_COLUMNS, AIRLINES, AIRPORT_FILE_COLUMNS, CAUSES, FLIGHTS, LOOKUP_KEYS,
)


#: Columns that landing adds: the ISO weekday and the departure hour.
SCHEDULE = ("DayOfWeek", "DepHour")


def _typed_flights(raw: DataFrame, *more: str) -> DataFrame:
    """Project the known flight columns, and ``more`` whole numbers, with fixed types; only cause columns may be absent."""
    required = [name for name in FLIGHTS.fieldNames() if name not in CAUSES]
    missing = [name for name in required if name not in raw.columns]
    if missing:
        raise ValueError(f"flights lack the columns {missing}")
    complete = add_missing_causes(raw)
    fields = [*FLIGHTS.fields, *[StructField(name, IntegerType()) for name in more]]
    return complete.select([_typed(f, complete.schema[f.name].dataType).alias(f.name) for f in fields])


def _typed(field, found) -> Column:
    """A column in its fixed type; whole numbers may be written as ``815.0``, other fractions fail."""
    value = F.col(field.name)
    if not isinstance(field.dataType, IntegerType) or not isinstance(found, (StringType, FractionalType)):
        return value.cast(field.dataType)
    number = value.cast("double")
    message = F.concat(F.lit(f"{field.name} is not a whole number: "), value.cast("string"))
    return F.when(number == F.floor(number), number.cast("int")).when(
        number.isNotNull(), F.raise_error(message).cast("int"))


def _bound(raw: DataFrame, clauses: tuple[Clause, ...]) -> DataFrame:
    """Clauses over the file's own columns.

    Numbers keep the type the file's footer gives them and the clause's literals are cast to it, whether it is int, bigint
    or double, so that Parquet can skip row groups. A cast of the column to our narrower type would hide it
    from the scan. Only numbers written as text have to be cast first.
    """
    if not any(clause is not None for clause in clauses):
        return raw
    texts = [f for f in FLIGHTS.fields if f.name in raw.columns and isinstance(raw.schema[f.name].dataType, StringType)]
    comparable = raw.withColumns({f.name: _typed(f, StringType()) for f in texts}) if texts else raw
    return keep(comparable, *clauses)


def read_flights(spark: SparkSession, path: str, *clauses: Clause, schedule: bool = False) -> DataFrame:
    """Flights from Parquet that meet the clauses (see ``filters.selection``), with fixed types.

    Clauses given here reach the scan whatever whole-number type the file has; filters on the result do so where the types
    agree. With ``schedule`` the weekday and hour that landing stores are kept, if the file has them: operators
    take them instead of deriving them.
    """
    raw = _bound(spark.read.parquet(path), clauses)
    return _typed_flights(raw, *[c for c in SCHEDULE if schedule and c in raw.columns])


def read_flights_csv(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Flights from (gzip) CSV with a header.

    A gzip file is one split whatever its size, so its rows are spread over ``partitions`` (as many as the cluster
    has cores unless named) before any further work.
    """
    rows = _typed_flights(spark.read.option("header", True).csv(path))
    return rows.repartition(partitions or spark.sparkContext.defaultParallelism)


def with_schedule_columns(flights: DataFrame) -> DataFrame:
    """Add the ISO weekday and departure hour, so that predicates on them can be pushed down."""
    return flights.withColumns({
        "DayOfWeek": fn.iso_dow(fn.flight_date()),
        "DepHour": fn.dep_hour(F.col("CRSDepTime")),
    })


def landing_rows(flights: DataFrame, finish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Flights as they are landed: months together, sorted by route, with the schedule columns.

    Rebalancing lets adaptive execution split a month too large for one task and merge
    small ones, so no month and no group of equal rows depends on a single task. Columns that follow from others row by row
    are made by ``finish`` behind the shuffle and the sort, which need not carry them.
    """
    dealt = flights.hint("rebalance", "Year", "Month").sortWithinPartitions("Year", "Month", "OriginAirportID", "DestAirportID")
    return with_schedule_columns(finish(dealt) if finish else dealt)


def land_flights(flights: DataFrame, path: str, mode: str = "errorifexists",
                 finish: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Write flights as Parquet by Year and Month, sorted by route for min/max pruning."""
    landing_rows(flights, finish).write.mode(mode).partitionBy("Year", "Month").parquet(path)


def read_airports(spark: SparkSession, path: str) -> DataFrame:
    """Airports from CSV: four columns, code as text, one row per code."""
    raw = spark.read.option("header", True).csv(path)
    missing = [name for name in AIRPORT_FILE_COLUMNS if name not in raw.columns]
    if missing:
        raise ValueError(f"airports lack the columns {missing}")
    typed = raw.select(
        F.col("Code").cast("string").alias("code"),
        F.col("Airport Name").alias("airport_name"),
        F.col("Latitude").cast("double").alias("latitude"),
        F.col("Longitude").cast("double").alias("longitude"),
    )
    return unique_airports(typed)


def unique_airports(airports: DataFrame) -> DataFrame:
    """Keep one row per code, so that no name join can multiply flights."""
    facts = F.struct("airport_name", "latitude", "longitude")
    return (
        airports.groupBy("code").agg(F.min(facts).alias("facts"))
        .select("code", "facts.airport_name", "facts.latitude", "facts.longitude")
    )


def read_airlines(spark: SparkSession, path: str) -> DataFrame:
    """Airlines from CSV, or an empty table of the same columns where the file is absent."""
    try:
        raw = spark.read.option("header", True).csv(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], AIRLINES)
    missing = [name for name in AIRLINE_FILE_COLUMNS if name not in raw.columns]
    if missing:
        raise ValueError(f"airlines lack the columns {missing}")
    return (
        raw.select(F.col("Code").cast("string").alias("code"),
                   F.col("Description").alias("description"))
        .groupBy("code").agg(F.min("description").alias("description"))
    )


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """The precomputed lookup with its three code columns as text."""
    lookup = spark.read.parquet(path)
    codes = [c for c in LOOKUP_KEYS[:3] if c in lookup.columns]
    return lookup.withColumns({c: F.col(c).cast("string") for c in codes})


def sql_over(text: str, flights: DataFrame, airports: DataFrame, airlines: DataFrame) -> DataFrame:
    """A statement over ``{flights}``, ``{geo}`` and ``{airlines}``; no view is left in the session, so that
    tables of several folders do not collide."""
    return flights.sparkSession.sql(text, flights=flights, geo=airports, airlines=airlines)


def register_views(flights: DataFrame, airports: DataFrame, airlines: DataFrame) -> None:
    """Name the three tables for use from ``spark.sql``."""
    flights.createOrReplaceTempView("flights")
    airports.createOrReplaceTempView("geo")
    airlines.createOrReplaceTempView("airlines")
