"""Stored summaries that are kept up to date month by month.

Both are Parquet tables partitioned by Year and Month. Refreshing writes only the partitions of the months it is given rows
for (dynamic partition overwrite), so that a new or corrected month costs one scan of that month; with
``months`` the scan of landed flights is pruned to it. A month refreshed twice counts once. A month that has lost all its
flights keeps its partition until that is deleted.

- availability: what operates, the distinct combinations that the choices are taken from;
- lookup states: how often each value of each measure occurs per lookup cell. Counts of values merge by addition, so the
  exact percentiles and means of any set of months come from them without their flights.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skylag import functions as fn
from skylag.operators.filters import keep, require
from skylag.operators.lookup import lookup_statistics
from skylag.operators.options import CUBE
from skylag.schemas import CAUSE_STEMS, CAUSES, LOOKUP_KEYS

Months = list[tuple[int, int]]


def in_year_months(months: Months | None) -> Column | None:
    if months is None:
        return None
    one_by_one = [(F.col("Year") == year) & (F.col("Month") == month) for year, month in months]
    return reduce(or_, one_by_one, F.lit(False))


def _refresh(rows: DataFrame, path: str) -> None:
    (rows.hint("rebalance", "Year", "Month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("Year", "Month").parquet(path))


# Availability -------------------------------------------------------------------------

def refresh_availability(flights: DataFrame, path: str, months: Months | None = None) -> None:
    """Write the combinations that occur in the given months, or in all that ``flights`` hold."""
    chosen = keep(flights, in_year_months(months))
    _refresh(chosen.select(
        "Year", "Month", fn.weekday_of(flights).alias("DayOfWeek"), F.col("OriginAirportID").alias("origin"),
        F.col("DestAirportID").alias("dest"), F.col("DOT_ID_Reporting_Airline").alias("airline"),
        fn.hour_of(flights).alias("DepHour")).distinct(), path)


def read_availability(spark: SparkSession, path: str) -> DataFrame:
    """The cube of ``options.availability_cube`` over all years, without the flights."""
    cube = spark.read.parquet(path).select(*CUBE).distinct()
    return cube.withColumns({c: F.col(c).cast("string") for c in ("origin", "dest", "airline")})


# Lookup cells -------------------------------------------------------------------------

# Measure names of the states, besides the causes.
TOTAL, ELAPSED, DISTANCE, HOLIDAY, PEAK = "total", "elapsed", "distance", "holiday", "peak"


def refresh_lookup_states(flights: DataFrame, path: str, months: Months | None = None) -> None:
    """Write the value counts of the given months, or of all that ``flights`` hold."""
    hour = fn.hour_of(flights)
    measures = {
        **{stem: F.coalesce(c, F.lit(0.0)) for c, stem in zip(CAUSES, CAUSE_STEMS)},
        TOTAL: fn.total_delay(), ELAPSED: F.col("CRSElapsedTime"), DISTANCE: F.col("Distance"),
        HOLIDAY: fn.has_holiday_effect(F.col("Month"), F.col("DayofMonth")), PEAK: fn.has_peak_hour(hour),
    }
    known = require(keep(flights, in_year_months(months)), ["DOT_ID_Reporting_Airline", "CRSDepTime"])
    values = F.array(*[F.struct(F.lit(name).alias("measure"), value.cast("double").alias("value")) for name, value in measures.items()])
    keyed = known.select(
        "Year", "Month", F.col("DOT_ID_Reporting_Airline").alias("carrier_code"), F.col("OriginAirportID").alias("origin_id"),
        F.col("DestAirportID").alias("dest_id"), fn.weekday_of(flights).alias("dow"),
        fn.time_of_day(hour).alias("time_of_day_category"), F.inline(values))
    _refresh(keyed.groupBy(*keyed.columns).agg(F.count(F.lit(1)).alias("n")), path)


def read_lookup_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells of ``lookup.lookup_cells`` from the states of all months."""
    states = spark.read.parquet(path).withColumnRenamed("Month", "month")

    def of(measure: str) -> Column:
        return F.when(F.col("measure") == measure, F.col("value"))

    def mean(measure: str) -> Column:
        present = F.when(of(measure).isNotNull(), F.col("n"))
        return F.sum(of(measure) * F.col("n")) / F.sum(present)

    def largest(measure: str) -> Column:
        return F.max(of(measure))

    def percentiles(measure: str, ranks: Column) -> Column:
        return F.percentile(of(measure), ranks, F.col("n"))

    return lookup_statistics(states.groupBy(*LOOKUP_KEYS), percentiles, mean(ELAPSED), mean(DISTANCE), largest(HOLIDAY), largest(PEAK))
