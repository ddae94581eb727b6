"""Table schemas and the column lists shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

# The five delay causes, in report order.
CAUSES = ["CarrierDelay", "WeatherDelay", "NASDelay", "SecurityDelay", "LateAircraftDelay"]

# Report labels of the causes.
CAUSE_LABELS_SHORT = {
    "CarrierDelay": "Carrier",
    "WeatherDelay": "Weather",
    "NASDelay": "NAS",
    "SecurityDelay": "Security",
    "LateAircraftDelay": "LateAircraft",
}
CAUSE_LABELS_LONG = {
    "CarrierDelay": "Carrier",
    "WeatherDelay": "Weather",
    "NASDelay": "National Aviation System",
    "SecurityDelay": "Security",
    "LateAircraftDelay": "Late Aircraft",
}

DELAY_FLAGS = ["ArrDel15", "DepDel15"]
DELAY_MINUTES = ["ArrDelayMinutes", "DepDelayMinutes"]
DATE_KEYS = ["Year", "Month", "DayofMonth"]

FLIGHTS = T.StructType(
    [T.StructField(name, T.IntegerType()) for name in DATE_KEYS]
    + [
        T.StructField("Flight_Number_Reporting_Airline", T.IntegerType()),
        T.StructField("DOT_ID_Reporting_Airline", T.IntegerType()),
        T.StructField("OriginAirportID", T.IntegerType()),
        T.StructField("DestAirportID", T.IntegerType()),
        T.StructField("CRSDepTime", T.IntegerType()),
    ]
    + [
        T.StructField(name, T.DoubleType())
        for name in [
            "DepDelayMinutes", "ArrDelayMinutes", "DepDel15", "ArrDel15",
            *CAUSES, "CRSElapsedTime", "Distance",
        ]
    ]
)

# The airport file carries the code, the name and the coordinates under these headers.
AIRPORT_FILE_COLUMNS = ["Code", "Airport Name", "Latitude", "Longitude"]
AIRPORTS = T.StructType([
    T.StructField("code", T.StringType()),
    T.StructField("airport_name", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
])

AIRLINE_FILE_COLUMNS = ["Code", "Description"]
AIRLINES = T.StructType([
    T.StructField("code", T.StringType()),
    T.StructField("description", T.StringType()),
])

# Lookup keys and statistics. Cause order as in CAUSES.
CAUSE_STEMS = ["carrier", "weather", "nas", "security", "late_aircraft"]
PERCENTILES = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
LOOKUP_KEYS = ["carrier_code", "origin_id", "dest_id", "month", "dow", "time_of_day_category"]
HIST_COLUMNS = [f"hist_{p}_{stem}_delay" for stem in CAUSE_STEMS for p in PERCENTILES]

# Statistics used when no history matches a request.
STAT_DEFAULTS = {
    "avg_crs_elapsed_time": 180.0,
    "avg_distance": 1000.0,
    **{name: 0.0 for name in HIST_COLUMNS},
}

# The model's feature order.
FEATURES = [
    "time_of_day_category", "Month", "DayOfWeek", "avg_crs_elapsed_time", "avg_distance",
    "pct_weekday", "has_holiday_effect", "has_peak_hour", "distance_category", "season",
    *HIST_COLUMNS,
]

# What each feature means.
FEATURE_DESCRIPTIONS = {
    "time_of_day_category": "Time of day category (1=early morning, 4=evening)",
    "Month": "Month of flight (1-12)",
    "DayOfWeek": "Day of the Week (1=Mon, 7=Sun)",
    "avg_crs_elapsed_time": "Average scheduled elapsed time (local time: hhmm) ",
    "avg_distance": "Average distance between airports (miles)",
    "pct_weekday": "Proportion of historical flights on weekdays (Mon-Fri)",
    "has_holiday_effect": "Indicator for major holiday dates (e.g., Jan 1, Jul 4, Dec 25)",
    "has_peak_hour": "Indicator for peak travel hours (6-9am, 4-7pm)",
    "distance_category": "Distance category (1:<250mi, 2:250-750mi, 3:750-1500mi, 4:>1500mi)",
    "season": "Season of the year (1=Winter, 2=Spring, 3=Summer, 4=Fall)",
    **{
        f"hist_{p}_{stem}_delay": f"{rank} of historical {cause} delays (minutes)"
        for stem, cause in zip(CAUSE_STEMS, ["carrier", "weather", "NAS", "security", "late aircraft"])
        for p, rank in [
            ("p10", "10th percentile"),
            ("p50", "50th percentile (median)"),
            ("p90", "90th percentile"),
        ]
    },
}
NO_DESCRIPTION = "No description available."
UNKNOWN = "Unknown"
