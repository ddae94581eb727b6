"""Readers, the Parquet landing job and the flight tables derived from the star schema."""

from skylag.sources.readers import (  # noqa: F401
    land_flights, read_airlines, read_airports, read_flights, read_flights_csv, read_lookup,
    register_views, sql_over, with_schedule_columns,
)
from skylag.sources.star import FlightTables, finish_flights, flight_tables  # noqa: F401
