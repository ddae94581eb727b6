"""Route delay summaries, map arcs and points, and flights with airport names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skylag import functions as fn
from skylag.operators.filters import flight_rows, require
from skylag.schemas import DATE_KEYS

ROUTE = ["origin", "dest"]
NAME_COLUMNS = ["orig_name", "src_lat", "src_lon", "dest_name", "dest_lat", "dest_lon"]


def airport_side(airports: DataFrame, key: str, name: str, lat: str, lon: str) -> DataFrame:
    """Airports under the column names of one end of a route; the text code becomes a number."""
    return airports.select(
        F.col("code").try_cast("int").alias(key), F.col("airport_name").alias(name),
        F.col("latitude").alias(lat), F.col("longitude").alias(lon),
    )


def attach_airports(routes: DataFrame, airports: DataFrame, origin: str = "origin",
                    dest: str = "dest") -> DataFrame:
    """Left-join both ends of a route; unknown airports keep null names."""
    source = airport_side(airports, "_src", "orig_name", "src_lat", "src_lon")
    target = airport_side(airports, "_dst", "dest_name", "dest_lat", "dest_lon")
    return (
        routes.join(source, F.col(origin) == F.col("_src"), "left")
        .join(target, F.col(dest) == F.col("_dst"), "left")
        .drop("_src", "_dst")
    )


def enrich_flights(flights: DataFrame, airports: DataFrame) -> DataFrame:
    """Flight rows with the names and coordinates of both airports."""
    named = attach_airports(flights, airports, "OriginAirportID", "DestAirportID")
    return flight_rows(named, *NAME_COLUMNS)


def _count_routes(flights: DataFrame, keys: list[str], flights_counted: Column) -> DataFrame:
    return flights.groupBy(
        *keys, F.col("OriginAirportID").alias("origin"), F.col("DestAirportID").alias("dest"),
    ).agg(
        flights_counted.alias("total_flights"),
        F.sum(fn.is_delay()).alias("delayed_count"),
    )


def finished_routes(named: DataFrame, keys: list[str]) -> DataFrame:
    ratio = F.try_divide(F.col("delayed_count"), F.col("total_flights"))
    return named.withColumn("delay_ratio", ratio).select(
        *keys, *[F.col(c).cast("string").alias(c) for c in ROUTE], *NAME_COLUMNS,
        "total_flights", "delayed_count", "delay_ratio",
        fn.pct_label(F.col("delay_ratio")).alias("pct_delayed"),
        *[c.alias(name) for name, c in fn.ratio_color(F.col("delay_ratio")).items()],
    )


def route_summary(flights: DataFrame, airports: DataFrame,
                  keys: list[str] = DATE_KEYS) -> DataFrame:
    """Flights, delayed flights and their ratio per key and route.

    The fact table is aggregated before the names are joined, so the joins see one row per
    key and route. Airports without an entry keep null names.
    """
    counted = _count_routes(flights, keys, F.count(F.lit(1)))
    return finished_routes(attach_airports(counted, airports), keys)


def route_summary_known(flights: DataFrame, airports: DataFrame,
                        keys: list[str] = DATE_KEYS) -> DataFrame:
    """Variant that counts flight numbers and keeps only routes with both airports fully known."""
    counted = _count_routes(flights, keys, F.count("Flight_Number_Reporting_Airline"))
    named = require(attach_airports(counted, airports), NAME_COLUMNS)
    return finished_routes(named, keys)


def route_arcs(summary: DataFrame, keys: list[str] = DATE_KEYS) -> DataFrame:
    """One line per route for the map."""
    return summary.select(
        *keys, "src_lon", "src_lat", "dest_lon", "dest_lat", "orig_name", "dest_name",
        "total_flights", "delayed_count", "pct_delayed",
        "color_r", "color_g", "color_b", "color_a",
    )


def airport_points(summary: DataFrame, keys: list[str] = DATE_KEYS) -> DataFrame:
    """Origins and destinations of each selection (key and origin), one per distinct ratio."""
    selection = [*keys, F.col("origin").alias("selected_origin")]

    def side(prefix: str, name: str, kind: str) -> DataFrame:
        return summary.select(
            *selection, F.col(name).alias("airport"), F.col(f"{prefix}_lat").alias("lat"),
            F.col(f"{prefix}_lon").alias("lon"), "delay_ratio",
        ).distinct().withColumn("type", F.lit(kind))

    both = side("src", "orig_name", "Origin").unionByName(side("dest", "dest_name", "Destination"))
    ratio = F.col("delay_ratio")
    return both.select(
        "*",
        *[c.alias(name) for name, c in fn.ratio_color(ratio).items()],
        fn.status_label(ratio).alias("status_label"),
        F.lit(None).cast("bigint").alias("total_flights"),
        F.lit(None).cast("bigint").alias("delayed_count"),
        F.lit(None).cast("string").alias("pct_delayed"),
    )


def route_geometry(flights: DataFrame, airports: DataFrame) -> DataFrame:
    """Every flown route with its end points and their midpoint."""
    routes = flights.select(
        F.col("OriginAirportID").alias("origin"), F.col("DestAirportID").alias("dest")).distinct()
    return attach_airports(routes, airports).select(
        *[F.col(c).cast("string").alias(c) for c in ROUTE],
        "src_lat", "src_lon", "dest_lat", "dest_lon",
        ((F.col("src_lat") + F.col("dest_lat")) / 2).alias("mid_lat"),
        ((F.col("src_lon") + F.col("dest_lon")) / 2).alias("mid_lon"),
    )


def map_center(flights: DataFrame, airports: DataFrame,
               keys: list[str] = DATE_KEYS) -> DataFrame:
    """Mean origin position per key over its flights, and the position of its first departure.

    Flights are first counted per origin, so only counts travel to the join. Time and flight
    number are packed into one number, which keeps both aggregations hash-based.
    """
    per_origin = flights.groupBy(*keys, "OriginAirportID").agg(
        F.count(F.lit(1)).alias("n"), F.min(departure_order()).alias("departure"))
    return finished_center(per_origin, airports, keys)


def departure_order() -> Column:
    """Time (absent as 0), then flight number (absent last) in one number of 64 bits."""
    time = F.coalesce("CRSDepTime", F.lit(0)).cast("bigint")
    return F.shiftleft(time, 32) + F.coalesce(F.col("Flight_Number_Reporting_Airline").cast("bigint"), F.lit(1 << 31))


def finished_center(per_origin: DataFrame, airports: DataFrame, keys: list[str]) -> DataFrame:
    side = airport_side(airports, "_src", "name", "lat", "lon")
    placed = per_origin.join(side, F.col("OriginAirportID") == F.col("_src"), "left")
    known = F.when(F.col("lat").isNotNull(), F.col("n"))
    first = F.struct("departure", "OriginAirportID")
    return placed.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("lat") * F.col("n")), F.sum(known)).alias("center_lat"),
        F.try_divide(F.sum(F.col("lon") * F.col("n")), F.sum(known)).alias("center_lon"),
        F.min_by("lat", first).alias("first_lat"),
        F.min_by("lon", first).alias("first_lon"),
    )
