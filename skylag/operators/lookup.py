"""The precomputed lookup of route statistics and the key back-off into it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, GroupedData, functions as F

from skylag import functions as fn
from skylag.operators.filters import require
from skylag.schemas import (
    CAUSE_STEMS, CAUSES, HIST_COLUMNS, LOOKUP_KEYS, PERCENTILES, STAT_DEFAULTS,
)

STATS = list(STAT_DEFAULTS)
ROUTE_SLOT = ["carrier_code", "origin_id", "dest_id", "time_of_day_category"]


def lookup_cells(flights: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Statistics per (carrier, origin, dest, month, weekday, time of day).

    Flights without carrier or departure time belong to no cell. Percentiles are exact:
    delays are whole minutes, so each task reduces a cell, however large, to counts per
    distinct minute before the shuffle. With ``accuracy`` they are approximate instead, for
    delays that are not whole minutes.
    """
    hour = fn.hour_of(flights)
    keyed = require(flights, ["DOT_ID_Reporting_Airline", "CRSDepTime"]).select(
        F.col("DOT_ID_Reporting_Airline").alias("carrier_code"),
        F.col("OriginAirportID").alias("origin_id"),
        F.col("DestAirportID").alias("dest_id"),
        F.col("Month").alias("month"),
        fn.weekday_of(flights).alias("dow"),
        fn.time_of_day(hour).alias("time_of_day_category"),
        "CRSElapsedTime", "Distance",
        *[F.coalesce(c, F.lit(0.0)).alias(stem) for c, stem in zip(CAUSES, CAUSE_STEMS)],
        fn.total_delay().alias("total"),
        fn.has_holiday_effect(F.col("Month"), F.col("DayofMonth")).alias("holiday"),
        fn.has_peak_hour(hour).alias("peak"),
    )

    def percentiles(value: str, ranks: Column) -> Column:
        if accuracy is None:
            return F.percentile(value, ranks)
        return F.percentile_approx(value, ranks, accuracy)

    return lookup_statistics(keyed.groupBy(*LOOKUP_KEYS), percentiles, F.avg("CRSElapsedTime"), F.avg("Distance"),
                             F.max("holiday"), F.max("peak"))


def lookup_statistics(grouped: GroupedData, percentiles: Callable[[str, Column], Column], elapsed: Column, distance: Column,
                      holiday: Column, peak: Column) -> DataFrame:
    """Cells from rows grouped by ``LOOKUP_KEYS``, given how each statistic is aggregated."""
    ranks = F.array(*[F.lit(p) for p in PERCENTILES.values()])
    cells = grouped.agg(
        elapsed.alias("avg_crs_elapsed_time"),
        distance.alias("avg_distance"),
        *[percentiles(v, ranks).alias(f"_{v}") for v in [*CAUSE_STEMS, "total"]],
        holiday.alias("has_holiday_effect"),
        peak.alias("has_peak_hour"),
    )

    def split(value: str, name: str) -> list[Column]:
        return [F.col(f"_{value}")[i].alias(name.format(p=p)) for i, p in enumerate(PERCENTILES)]

    return cells.select(
        *[F.col(k).cast("string").alias(k) for k in LOOKUP_KEYS[:3]], *LOOKUP_KEYS[3:],
        "avg_crs_elapsed_time", "avg_distance",
        *[c for stem in CAUSE_STEMS for c in split(stem, f"hist_{{p}}_{stem}_delay")],
        *split("total", "total_{p}"),
        "has_holiday_effect", "has_peak_hour",
    )


def inference_lookup(cells: DataFrame) -> DataFrame:
    return cells.select(*LOOKUP_KEYS, "avg_crs_elapsed_time", "avg_distance", *HIST_COLUMNS)


def lookup_backoff(requests: DataFrame, lookup: DataFrame) -> DataFrame:
    """Statistics of the best matching cell for every request.

    Level 1 is the full key, level 2 ignores the weekday, level 3 ignores month and weekday,
    level 4 takes constants; among several cells the smallest (month, weekday) wins. The
    existing cells of a route slot, at most 84 small numbers, settle the level in one narrow
    join, so the wide statistics are joined once, by full key.
    """
    def number(month: str, dow: str) -> Column:
        return F.col(month) * 10 + F.col(dow)

    slots = lookup.groupBy(*ROUTE_SLOT).agg(
        F.collect_set(number("month", "dow")).alias("_cells"))
    wanted = F.col("month") * 10 + F.col("dow")
    in_month = F.filter(
        "_cells", lambda c: F.call_function("div", c, F.lit(10)) == F.col("month"))
    resolved = requests.join(slots, ROUTE_SLOT, "left").withColumns({
        "match_level": F.when(F.array_contains("_cells", wanted), 1)
        .when(F.size(in_month) > 0, 2).when(F.col("_cells").isNotNull(), 3).otherwise(4),
        "_month_first": F.array_min(in_month),
        "_first": F.array_min("_cells"),
    }).withColumn(
        "_cell",
        F.when(F.col("match_level") == 1, wanted)
        .when(F.col("match_level") == 2, F.col("_month_first"))
        .otherwise(F.col("_first")),
    ).drop("_cells", "_month_first", "_first")

    stats = lookup.select(*ROUTE_SLOT, number("month", "dow").alias("_cell"), *STATS)
    return resolved.join(stats, [*ROUTE_SLOT, "_cell"], "left").select(
        *[resolved[c] for c in requests.columns], "match_level",
        *[F.coalesce(F.col(c), F.lit(default)).alias(c) for c, default in STAT_DEFAULTS.items()],
    )
