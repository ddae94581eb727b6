"""DuckDB statements that state each query's result independently of Spark.

Each starts from the driver's tables: the flight, airport and airline tables are CTEs.
"""

from __future__ import annotations

from skylag.schemas import (
    CAUSE_LABELS_LONG, CAUSE_LABELS_SHORT, CAUSE_STEMS, CAUSES, FEATURE_DESCRIPTIONS, FEATURES,
)

ORACLE: dict[str, str] = {}

FLIGHTS = """
lines AS (
  SELECT l_linenumber, l_orderkey, l_partkey, l_suppkey, l_returnflag, l_linestatus,
         CAST(l_quantity AS INTEGER) AS q, s_nationkey % 5 AS o, c_nationkey % 5 AS d0,
         DATE '2023-01-01' + CAST(datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) % 731 AS INTEGER) AS dt
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
),
measured AS (
  SELECT *, CASE WHEN d0 = o THEN (d0 + 1) % 5 ELSE d0 END AS d,
         CASE WHEN l_orderkey % 8 <= 2 THEN 8 WHEN l_orderkey % 8 <= 4 THEN 17
              WHEN l_orderkey % 8 = 5 THEN 6 WHEN l_orderkey % 8 = 6 THEN 13 ELSE 22 END AS hh,
         CASE WHEN l_partkey % 53 = 0 THEN NULL WHEN l_returnflag = 'N' THEN 0
              WHEN l_returnflag = 'A' THEN q WHEN l_returnflag = 'R' THEN q % 20 END AS dep,
         CASE WHEN l_partkey % 53 = 0 OR l_suppkey % 61 = 0 THEN NULL
              WHEN l_linestatus = 'O' THEN (q * 2) % 70 WHEN l_linestatus = 'F' THEN q % 12 END AS arr
  FROM lines
),
caused AS (
  SELECT *, CASE WHEN arr >= 15 THEN arr // 3 END AS cd,
         CASE WHEN arr >= 15 THEN CASE WHEN l_linenumber = 1 THEN arr // 4 ELSE 0 END END AS wd,
         CASE WHEN arr >= 15 THEN arr // 5 END AS nas,
         CASE WHEN arr >= 15 THEN CASE WHEN l_linenumber = 6 THEN 2 ELSE 0 END END AS sd
  FROM measured
),
flights AS (
  SELECT CAST(year(dt) AS INTEGER) AS Year, CAST(month(dt) AS INTEGER) AS Month,
         CAST(day(dt) AS INTEGER) AS DayofMonth,
         CAST(1 + l_orderkey % 9000 AS INTEGER) AS Flight_Number_Reporting_Airline,
         CAST(CASE WHEN l_linenumber = 7 AND l_partkey % 10 = 9 THEN NULL
                   WHEN l_partkey % 10 < 6 THEN 19790 WHEN l_partkey % 10 < 9 THEN 19805
                   ELSE 20304 END AS INTEGER) AS DOT_ID_Reporting_Airline,
         CAST(10001 + o AS INTEGER) AS OriginAirportID, CAST(10001 + d AS INTEGER) AS DestAirportID,
         CAST(CASE WHEN l_orderkey % 97 = 0 THEN NULL WHEN l_orderkey % 101 = 0 THEN 5
                   WHEN l_orderkey % 103 = 0 THEN 2400
                   ELSE hh * 100 + (l_orderkey % 4) * 15 END AS INTEGER) AS CRSDepTime,
         CAST(dep AS DOUBLE) AS DepDelayMinutes, CAST(arr AS DOUBLE) AS ArrDelayMinutes,
         CAST(CASE WHEN dep >= 15 THEN 1 WHEN dep IS NOT NULL THEN 0 END AS DOUBLE) AS DepDel15,
         CAST(CASE WHEN arr >= 15 THEN 1 WHEN arr IS NOT NULL THEN 0 END AS DOUBLE) AS ArrDel15,
         CAST(cd AS DOUBLE) AS CarrierDelay, CAST(wd AS DOUBLE) AS WeatherDelay,
         CAST(nas AS DOUBLE) AS NASDelay, CAST(sd AS DOUBLE) AS SecurityDelay,
         CAST(arr - cd - wd - nas - sd AS DOUBLE) AS LateAircraftDelay,
         CAST(60 + (200 + 450 * abs(o - d)) // 8 AS DOUBLE) AS CRSElapsedTime,
         CAST(200 + 450 * abs(o - d) AS DOUBLE) AS Distance
  FROM caused
)"""

AIRPORTS = """
geo AS (
  SELECT CAST(10001 + n_nationkey AS VARCHAR) AS code,
         CASE WHEN n_nationkey <> 3 THEN n_name END AS airport_name,
         CAST(25 + 2.5 * n_nationkey AS DOUBLE) AS latitude,
         CAST(-120 + 7.25 * n_nationkey AS DOUBLE) AS longitude
  FROM nation WHERE n_nationkey <> 4
)"""

AIRLINES = """
airlines AS (
  SELECT CASE WHEN r_regionkey = 0 THEN '19790' ELSE '19805' END AS code, r_name AS description
  FROM region WHERE r_regionkey IN (0, 1)
)"""

DOW = "CAST(isodow(make_date(Year, Month, DayofMonth)) AS INTEGER)"
LATE = "(COALESCE(ArrDel15, 0) = 1 OR COALESCE(DepDel15, 0) = 1)"
LATE_COUNT = f"CAST(SUM(CASE WHEN {LATE} THEN 1 ELSE 0 END) AS BIGINT)"
TOTAL_DELAY = "(COALESCE(ArrDelayMinutes, 0) + COALESCE(DepDelayMinutes, 0))"
HOUR = "CAST(CRSDepTime // 100 AS INTEGER)"
DATE_KEYS = "Year, Month, DayofMonth"
ORIGIN = "CAST(OriginAirportID AS VARCHAR)"
DEST = "CAST(DestAirportID AS VARCHAR)"
AIRLINE = "CAST(DOT_ID_Reporting_Airline AS VARCHAR)"


def shown_time(value: str) -> str:
    text = f"lpad(CAST({value} AS VARCHAR), 4, '0')"
    return (f"CASE WHEN {value} BETWEEN 0 AND 2400 "
            f"THEN substr({text}, 1, 2) || ':' || substr({text}, 3, 2) ELSE 'N/A' END")


def pct(ratio: str) -> str:
    return f"round_even({ratio} * 100 * 10, 0) / 10"


def pct_text(ratio: str) -> str:
    return f"CAST({pct(ratio)} AS VARCHAR) || '%'"


def color(ratio: str) -> str:
    return (f"CAST(CASE WHEN {ratio} < 0.5 THEN trunc({ratio} * 510) ELSE 255 END AS INTEGER) AS color_r, "
            f"CAST(CASE WHEN {ratio} < 0.5 THEN 255 ELSE trunc((1 - {ratio}) * 510) END AS INTEGER) AS color_g, "
            "0 AS color_b, 200 AS color_a")


def status_label(ratio: str) -> str:
    return (f"CASE WHEN {ratio} = 0 THEN 'On-Time' WHEN {ratio} = 1 THEN 'Delayed' "
            f"ELSE 'Mixed (' || CAST(CAST(round_even({ratio} * 100, 0) AS INTEGER) AS VARCHAR) || '% delayed)' END")


def time_of_day(hour: str) -> str:
    return f"CAST(CASE WHEN {hour} < 6 THEN 1 WHEN {hour} < 12 THEN 2 WHEN {hour} < 17 THEN 3 ELSE 4 END AS INTEGER)"


def band(value: str) -> str:
    return (f"CASE WHEN {value} < 10 THEN 'On-Time Expected' WHEN {value} < 30 "
            "THEN 'Minor Delay Expected' ELSE 'Significant Delay Expected' END")


def on_tables(name: str, select: str, *more: str) -> None:
    """State a query over the flight tables, after any further CTEs."""
    ORACLE[name] = "WITH " + ",".join([FLIGHTS, AIRPORTS, AIRLINES, *more]) + "\n" + select


# Sources ------------------------------------------------------------------------------

on_tables("scan_flights", "SELECT * FROM flights")
on_tables("scan_airports", "SELECT * FROM geo")
on_tables("scan_airlines", "SELECT * FROM airlines")
on_tables("sql_view_query", f"""
SELECT a.description, g.airport_name, COUNT(*) AS flights,
       SUM(COALESCE(ArrDelayMinutes, 0)) AS arrival_minutes
FROM flights LEFT JOIN airlines a ON {AIRLINE} = a.code LEFT JOIN geo g ON {ORIGIN} = g.code
GROUP BY a.description, g.airport_name""")

# Filters and projections --------------------------------------------------------------

on_tables("filter_date", "SELECT * FROM flights WHERE Year = 2024 AND Month = 7 AND DayofMonth = 15")
on_tables("filter_route", f"SELECT * FROM flights WHERE {ORIGIN} = '10001' AND {DEST} = '10002'")
on_tables("filter_dest_in", f"SELECT * FROM flights WHERE {DEST} IN ('10002', '10004')")
on_tables("filter_dep_time", "SELECT * FROM flights WHERE CRSDepTime = 815")
on_tables("filter_delayed", "SELECT * FROM flights WHERE ArrDel15 = 1 OR DepDel15 = 1")
on_tables("filter_on_time",
          "SELECT * FROM flights WHERE COALESCE(ArrDel15, 0) <> 1 AND COALESCE(DepDel15, 0) <> 1")
on_tables("filter_month_dow", f"SELECT * FROM flights WHERE Month = 7 AND {DOW} = 3")
on_tables("filter_required", """SELECT * FROM flights
WHERE DayofMonth IS NOT NULL AND Month IS NOT NULL AND CRSDepTime IS NOT NULL
  AND DOT_ID_Reporting_Airline IS NOT NULL AND OriginAirportID IS NOT NULL AND DestAirportID IS NOT NULL""")
on_tables("filter_combined", f"""SELECT * FROM flights
WHERE {ORIGIN} = '10001' AND {DEST} IN ('10002', '10004') AND CRSDepTime = 815
  AND (ArrDel15 = 1 OR DepDel15 = 1)""")

MEASURES = ["ArrDel15", "DepDel15", "ArrDelayMinutes", "DepDelayMinutes", *CAUSES]
FILLED = ", ".join(f"COALESCE({c}, 0) AS {c}" for c in MEASURES)
on_tables("null_fill", f"SELECT * REPLACE ({FILLED}) FROM flights")

ROWS = f"""
rows_std AS (
  SELECT {DATE_KEYS}, Flight_Number_Reporting_Airline AS fl_num, {ORIGIN} AS origin, {DEST} AS dest,
         CRSDepTime AS crs_dep_time_raw, {FILLED},
         CASE WHEN {LATE} THEN 1 ELSE 0 END AS is_delay,
         {shown_time('CRSDepTime')} AS crs_dep_time, COALESCE(CRSDepTime, 0) AS crs_dep_time_sort
  FROM flights
)"""
NAMES = """o.airport_name AS orig_name, o.latitude AS src_lat, o.longitude AS src_lon,
       d.airport_name AS dest_name, d.latitude AS dest_lat, d.longitude AS dest_lon"""
NAMED_ROWS = f"""
rows_named AS (
  SELECT r.*, {NAMES}
  FROM rows_std r LEFT JOIN geo o ON r.origin = o.code LEFT JOIN geo d ON r.dest = d.code
)"""
on_tables("flight_rows", "SELECT * FROM rows_std", ROWS)
on_tables("enrich_flights", "SELECT * FROM rows_named", ROWS, NAMED_ROWS)
on_tables("cross_filter", f"""
SELECT {DATE_KEYS}, fl_num, origin, dest, orig_name, dest_name, crs_dep_time, is_delay
FROM rows_named
WHERE crs_dep_time IN ('08:00', '17:30')
  AND dest_name IN (SELECT airport_name FROM geo WHERE airport_name IS NOT NULL)""", ROWS, NAMED_ROWS)

# Routes -------------------------------------------------------------------------------


def summary(counted: str, known: bool) -> str:
    keep = ("WHERE o.airport_name IS NOT NULL AND d.airport_name IS NOT NULL AND o.latitude IS NOT NULL "
            "AND o.longitude IS NOT NULL AND d.latitude IS NOT NULL AND d.longitude IS NOT NULL")
    return f"""
counted AS (
  SELECT {DATE_KEYS}, {ORIGIN} AS origin, {DEST} AS dest, {counted} AS total_flights,
         {LATE_COUNT} AS delayed_count
  FROM flights GROUP BY ALL
),
ratios AS (
  SELECT c.*, {NAMES}, delayed_count / total_flights AS delay_ratio
  FROM counted c LEFT JOIN geo o ON c.origin = o.code LEFT JOIN geo d ON c.dest = d.code
  {keep if known else ''}
),
summary AS (
  SELECT *, {pct_text('delay_ratio')} AS pct_delayed, {color('delay_ratio')} FROM ratios
)"""


SUMMARY = summary("COUNT(*)", known=False)
on_tables("route_summary", "SELECT * FROM summary", SUMMARY)
on_tables("route_summary_known", "SELECT * FROM summary",
          summary("COUNT(Flight_Number_Reporting_Airline)", known=True))
on_tables("route_arcs", f"""
SELECT {DATE_KEYS}, src_lon, src_lat, dest_lon, dest_lat, orig_name, dest_name, total_flights,
       delayed_count, pct_delayed, color_r, color_g, color_b, color_a FROM summary""", SUMMARY)
on_tables("airport_points", f"""
SELECT *, {color('delay_ratio')}, {status_label('delay_ratio')} AS status_label,
       CAST(NULL AS BIGINT) AS total_flights, CAST(NULL AS BIGINT) AS delayed_count,
       CAST(NULL AS VARCHAR) AS pct_delayed
FROM (
  SELECT DISTINCT {DATE_KEYS}, origin AS selected_origin, orig_name AS airport, src_lat AS lat,
         src_lon AS lon, delay_ratio, 'Origin' AS type FROM summary
  UNION ALL
  SELECT DISTINCT {DATE_KEYS}, origin, dest_name, dest_lat, dest_lon, delay_ratio, 'Destination'
  FROM summary
)""", SUMMARY)
on_tables("ratio_color", f"""
SELECT delay_ratio, {color('delay_ratio')}, {status_label('delay_ratio')} AS status_label,
       {pct_text('delay_ratio')} AS pct_delayed
FROM (SELECT DISTINCT delay_ratio FROM ratios)""", SUMMARY)
on_tables("route_geometry", f"""
SELECT origin, dest, o.latitude AS src_lat, o.longitude AS src_lon, d.latitude AS dest_lat,
       d.longitude AS dest_lon, (o.latitude + d.latitude) / 2 AS mid_lat,
       (o.longitude + d.longitude) / 2 AS mid_lon
FROM (SELECT DISTINCT {ORIGIN} AS origin, {DEST} AS dest FROM flights)
LEFT JOIN geo o ON origin = o.code LEFT JOIN geo d ON dest = d.code""")
on_tables("map_center", f"""
SELECT {DATE_KEYS}, AVG(src_lat) AS center_lat, AVG(src_lon) AS center_lon,
       MAX(CASE WHEN n = 1 THEN src_lat END) AS first_lat, MAX(CASE WHEN n = 1 THEN src_lon END) AS first_lon
FROM (SELECT *, row_number() OVER (PARTITION BY {DATE_KEYS} ORDER BY crs_dep_time_sort, fl_num, origin) AS n
      FROM rows_named)
GROUP BY {DATE_KEYS}""", ROWS, NAMED_ROWS)

# Choices ------------------------------------------------------------------------------

on_tables("date_range", """
SELECT MIN(make_date(Year, Month, DayofMonth)) AS min_date,
       MAX(make_date(Year, Month, DayofMonth)) AS max_date FROM flights""")
on_tables("date_range_parts", """
SELECT CASE WHEN lo IS NULL OR hi IS NULL THEN DATE '2024-01-01' ELSE lo END AS min_date,
       CASE WHEN lo IS NULL OR hi IS NULL THEN DATE '2024-12-31' ELSE hi END AS max_date
FROM (SELECT TRY_CAST(printf('%04d-%02d-%02d', MIN(Year), MIN(Month), MIN(DayofMonth)) AS DATE) AS lo,
             TRY_CAST(printf('%04d-%02d-%02d', MAX(Year), MAX(Month), MAX(DayofMonth)) AS DATE) AS hi
      FROM flights)""")
DISPLAY = "code || ' - ' || COALESCE(airport_name, 'Unknown')"
on_tables("airports_by_date", f"""
SELECT {DATE_KEYS}, code, {DISPLAY} AS display
FROM (SELECT DISTINCT {DATE_KEYS}, {ORIGIN} AS id FROM flights) JOIN geo ON id = code""")
on_tables("dests_by_origin_date", f"""
SELECT {DATE_KEYS}, origin, code, {DISPLAY} AS display
FROM (SELECT DISTINCT {DATE_KEYS}, {ORIGIN} AS origin, {DEST} AS id FROM flights)
JOIN geo ON id = code""")
on_tables("dep_times", f"""
SELECT DISTINCT {DATE_KEYS}, {ORIGIN} AS origin, CRSDepTime, {shown_time('CRSDepTime')} AS display
FROM flights WHERE CRSDepTime IS NOT NULL""")
on_tables("airlines_by_route", f"""
SELECT DISTINCT {ORIGIN} AS origin, {DEST} AS dest, {AIRLINE} AS code
FROM flights WHERE DOT_ID_Reporting_Airline IS NOT NULL""")
on_tables("airlines_all", f"""
SELECT DISTINCT {AIRLINE} AS code FROM flights WHERE DOT_ID_Reporting_Airline IS NOT NULL""")


def airline_name(code: str) -> str:
    return f"{code} || ' - ' || COALESCE(a.description, 'Unknown') AS airline_name"


on_tables("default_airlines", f"""
SELECT f.code, {airline_name('f.code')}
FROM (SELECT DISTINCT {AIRLINE} AS code FROM flights
      WHERE DOT_ID_Reporting_Airline IS NOT NULL ORDER BY code LIMIT 5) f
LEFT JOIN airlines a ON f.code = a.code""")

CUBE = f"""
cube AS (
  SELECT DISTINCT Month, {DOW} AS DayOfWeek, {ORIGIN} AS origin, {DEST} AS dest,
         {AIRLINE} AS airline, {HOUR} AS DepHour
  FROM flights
)"""


def airport_display(code: str) -> str:
    return (f"CASE WHEN airport_name IS NULL THEN {code} ELSE {code} || ' - ' || airport_name END "
            f"AS label_or_code, {code} || ' - ' || COALESCE(airport_name, 'Unknown') AS label_or_unknown")


on_tables("availability_cube", "SELECT * FROM cube", CUBE)
on_tables("availability_origins", f"""
SELECT Month, DayOfWeek, origin, {airport_display('origin')}
FROM (SELECT DISTINCT Month, DayOfWeek, origin FROM cube) LEFT JOIN geo ON origin = code""", CUBE)
on_tables("availability_dests", f"""
SELECT Month, DayOfWeek, origin, dest, {airport_display('dest')}
FROM (SELECT DISTINCT Month, DayOfWeek, origin, dest FROM cube) LEFT JOIN geo ON dest = code""", CUBE)
on_tables("availability_airlines", f"""
SELECT Month, DayOfWeek, origin, dest, airline, {airline_name('airline')}
FROM (SELECT DISTINCT Month, DayOfWeek, origin, dest, airline FROM cube WHERE airline IS NOT NULL)
LEFT JOIN airlines a ON airline = a.code""", CUBE)
on_tables("availability_hours", """
SELECT *, printf('%02d:00', DepHour) AS display FROM cube
WHERE airline IS NOT NULL AND DepHour IS NOT NULL""", CUBE)

# Reports ------------------------------------------------------------------------------

on_tables("airline_labels", f"""
SELECT f.code AS airline_code, {airline_name('f.code')}
FROM (SELECT DISTINCT {AIRLINE} AS code FROM flights WHERE DOT_ID_Reporting_Airline IS NOT NULL) f
LEFT JOIN airlines a ON f.code = a.code""")
on_tables("airport_labels", f"""
SELECT id AS code, airport_name, {airport_display('id')}
FROM (SELECT {ORIGIN} AS id FROM flights UNION SELECT {DEST} FROM flights)
LEFT JOIN geo ON id = code""")

SELECTION = f"{DATE_KEYS}, OriginAirportID"
on_tables("kpi_summary", f"""
SELECT *, total_flights - delayed_flights AS on_time_flights,
       {pct('(delayed_flights / total_flights)')} AS delayed_pct
FROM (SELECT {SELECTION}, COUNT(*) AS total_flights, {LATE_COUNT} AS delayed_flights
      FROM flights GROUP BY ALL)""")


def dest_time(keys: str) -> str:
    return f"""
dest_time AS (
  SELECT *, delayed / total AS delay_ratio
  FROM (SELECT {keys}, airport_name AS dest_name, {shown_time('CRSDepTime')} AS crs_dep_time,
               {LATE_COUNT} AS delayed, COUNT(*) AS total
        FROM flights JOIN geo ON {DEST} = code WHERE airport_name IS NOT NULL GROUP BY ALL)
)"""


# The times that the derived flights have; a view cannot take its columns from the data.
SHOWN_TIMES = ["00:05", "06:15", "08:00", "08:15", "08:30", "13:30", "17:00", "17:45", "22:45", "24:00", "N/A"]

on_tables("dest_time_ratio", "SELECT * FROM dest_time", dest_time(SELECTION))
on_tables("dest_time_matrix", """
SELECT * FROM (PIVOT (SELECT OriginAirportID, dest_name, crs_dep_time, delay_ratio FROM dest_time)
               ON crs_dep_time IN (""" + ", ".join(f"'{time}'" for time in SHOWN_TIMES) + """)
               USING max(delay_ratio) GROUP BY OriginAirportID, dest_name)""", dest_time("OriginAirportID"))
on_tables("heatmap_summary", f"""
SELECT {SELECTION}, COUNT(DISTINCT airport_name) AS destinations,
       COUNT(DISTINCT CASE WHEN airport_name IS NOT NULL THEN {shown_time('CRSDepTime')} END) AS departure_times,
       COUNT(*) AS flight_records
FROM flights LEFT JOIN geo ON {DEST} = code GROUP BY {SELECTION}""")


def per_cause(value: str, where: str, labels: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {SELECTION}, '{c}' AS cause, AVG({value.format(c=c)}) AS avg_minutes, "
        f"'{labels[c]}' AS delay_type FROM flights {where} GROUP BY {SELECTION}" for c in CAUSES)


on_tables("cause_mean_positive", "SELECT * FROM ("
          + per_cause("CASE WHEN {c} > 0 THEN {c} END", "", CAUSE_LABELS_SHORT)
          + ") WHERE avg_minutes IS NOT NULL")
on_tables("cause_mean_delayed", "SELECT * FROM ("
          + per_cause("COALESCE({c}, 0)", f"WHERE {LATE}", CAUSE_LABELS_LONG)
          + ") WHERE avg_minutes > 0")
on_tables("has_cause", f"""
SELECT {SELECTION}, bool_or({' OR '.join(f'COALESCE({c}, 0) > 0' for c in CAUSES)}) AS has_delays
FROM flights GROUP BY {SELECTION}""")

CHOSEN = f"""WHERE {AIRLINE} IN ('19790', '20304') AND Month IN (1, 2, 3, 5, 7, 8, 11, 12)"""
AVERAGES = f"AVG({TOTAL_DELAY}) AS avg_total_delay, COUNT(*) AS flight_count"
MONTH_NAME = "monthname(make_date(2024, Month, 1)) AS month_name"
on_tables("airline_average", f"""
SELECT f.*, {airline_name('airline_code')}, avg_total_delay > 30 AS over_threshold
FROM (SELECT {AIRLINE} AS airline_code, {AVERAGES} FROM flights {CHOSEN} GROUP BY ALL) f
LEFT JOIN airlines a ON airline_code = a.code""")
on_tables("monthly_average", f"""
SELECT *, {MONTH_NAME}, avg_total_delay > 30 AS over_threshold
FROM (SELECT Month, {AVERAGES} FROM flights {CHOSEN} GROUP BY ALL)""")
on_tables("daily_trend", f"""
SELECT f.*, {airline_name('airline_code')}, avg_total_delay > 30 AS over_threshold
FROM (SELECT {AIRLINE} AS airline_code, DayofMonth, {AVERAGES} FROM flights {CHOSEN} GROUP BY ALL) f
LEFT JOIN airlines a ON airline_code = a.code""")
MONTH_AIRLINE = f"""
month_airline AS (
  SELECT f.*, {airline_name('airline_code')}, {MONTH_NAME}
  FROM (SELECT Month, {AIRLINE} AS airline_code, AVG({TOTAL_DELAY}) AS avg_total_delay
        FROM flights {CHOSEN} GROUP BY ALL) f
  LEFT JOIN airlines a ON airline_code = a.code
)"""
on_tables("month_airline_average", "SELECT * FROM month_airline", MONTH_AIRLINE)
on_tables("month_airline_matrix", "SELECT airline_name, " + ", ".join(
    f"MAX(CASE WHEN month_name = '{m}' THEN avg_total_delay END) AS {m}"
    for m in ["January", "February", "March", "April", "May", "June", "July", "August",
              "September", "October", "November", "December"]
) + " FROM month_airline GROUP BY airline_name", MONTH_AIRLINE)

LISTED = f"""
fl_num AS "Flight #", orig_name AS "Origin Airport", dest_name AS "Destination Airport",
crs_dep_time AS "Scheduled Dep Time", CASE is_delay WHEN 0 THEN 'On-Time' WHEN 1 THEN 'Delayed' END AS "Status",
{', '.join(CAUSES)}"""
LISTED_ORDER = ("crs_dep_time_sort, crs_dep_time, fl_num, orig_name NULLS FIRST, dest_name NULLS FIRST, "
                "is_delay, " + ", ".join(CAUSES))
on_tables("flight_listing", f"SELECT {LISTED} FROM (SELECT * FROM rows_named ORDER BY {LISTED_ORDER} LIMIT 500)",
          ROWS, NAMED_ROWS)
on_tables("flight_listing_by_origin", f"""
SELECT origin, {LISTED} FROM rows_named
QUALIFY row_number() OVER (PARTITION BY origin ORDER BY {LISTED_ORDER}) <= 500""", ROWS, NAMED_ROWS)

# Scalar rules -------------------------------------------------------------------------

on_tables("format_time", f"SELECT CRSDepTime, {shown_time('CRSDepTime')} AS shown FROM flights")
on_tables("dep_hour", f"SELECT CRSDepTime, {HOUR} AS hour FROM flights")
on_tables("iso_dow", f"SELECT {DATE_KEYS}, {DOW} AS dow FROM flights")
on_tables("calendar_names", f"""
SELECT {DATE_KEYS}, {MONTH_NAME}, dayname(make_date(Year, Month, DayofMonth)) AS day_name,
       printf('%d-%02d-%02d', Year, Month, DayofMonth) AS date_text,
       printf('%02d:00', {HOUR}) AS hour_text
FROM flights""")

# Analog forecasts ---------------------------------------------------------------------

HISTORY = f"""
history AS (
  SELECT OriginAirportID AS origin, DestAirportID AS dest, DOT_ID_Reporting_Airline AS airline,
         Year, DayofMonth, {DOW} AS DayOfWeek, Month, {HOUR} AS DepHour, CRSDepTime AS DepTime,
         {TOTAL_DELAY} AS TotalDelay
  FROM flights WHERE DayofMonth IS NOT NULL AND Month IS NOT NULL AND CRSDepTime IS NOT NULL
)"""
CANDIDATES = """
requests AS (
  SELECT *, CAST(isodow(make_date(2024, month, day)) AS INTEGER) AS dow
  FROM (SELECT DISTINCT origin, dest, airline, Month AS month, (DepHour * 3 + Month) % 28 + 1 AS day, DepHour AS hour,
               (Month * 5 + DepHour) % 18 + 3 AS k
        FROM history WHERE airline IS NOT NULL)
),
candidates AS (
  SELECT DISTINCT r.*, h.Year, h.DayofMonth, h.DayOfWeek, h.DepTime, h.TotalDelay, 'DOW' AS "Group"
  FROM requests r JOIN history h ON h.origin = r.origin AND h.dest = r.dest AND h.airline = r.airline
   AND h.Month = r.month AND h.DepHour = r.hour AND h.DayOfWeek = r.dow
  UNION ALL
  SELECT DISTINCT r.*, h.Year, h.DayofMonth, h.DayOfWeek, h.DepTime, h.TotalDelay, 'DOM'
  FROM requests r JOIN history h ON h.origin = r.origin AND h.dest = r.dest AND h.airline = r.airline
   AND h.Month = r.month AND h.DepHour = r.hour AND h.DayofMonth = r.day
)"""
NEIGHBORS = """
neighbors AS (
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (
             PARTITION BY origin, dest, airline, month, day, dow, hour, k
             ORDER BY distance, Year DESC, DayofMonth, DepTime, TotalDelay, "Group") AS INTEGER) AS rank
    FROM (SELECT *, sqrt((day - DayofMonth) * (day - DayofMonth) + (dow - DayOfWeek) * (dow - DayOfWeek)) AS distance
          FROM candidates))
  WHERE rank <= k
)"""
on_tables("training_rows", "SELECT * FROM history", HISTORY)
on_tables("analog_candidates", "SELECT * FROM candidates", HISTORY, CANDIDATES)
on_tables("analog_neighbors", f"""
SELECT origin, dest, airline, month, day, dow, hour, k, rank,
       printf('%d-%02d-%02d', Year, month, DayofMonth) AS Date,
       dayname(make_date(2024, 1, DayOfWeek)) AS DayOfWeek,
       {shown_time('DepTime')} AS scheduled_dep_time, TotalDelay, "Group", distance
FROM neighbors""", HISTORY, CANDIDATES, NEIGHBORS)


def interpolated(p: float) -> str:
    return (f"arg_min(CASE WHEN place = 1 THEN delay ELSE before + ({p} - cum_before) / (cum - cum_before) "
            f"* (delay - before) END, place) FILTER (WHERE cum >= {p})")


on_tables("analog_forecast", f"""
SELECT origin, dest, airline, month, day, dow, hour, k, k_eff,
       round(p10, 4) AS p10, round(p50, 4) AS p50, round(p90, 4) AS p90, {band('round(p50, 6)')} AS band
FROM (
  SELECT origin, dest, airline, month, day, dow, hour, k, CAST(COUNT(*) AS INTEGER) AS k_eff,
         CASE WHEN COUNT(*) < 3 THEN AVG(delay) ELSE {interpolated(0.1)} END AS p10,
         CASE WHEN COUNT(*) < 3 THEN AVG(delay) ELSE {interpolated(0.5)} END AS p50,
         CASE WHEN COUNT(*) < 3 THEN AVG(delay) ELSE {interpolated(0.9)} END AS p90
  FROM (SELECT *, lag(cum) OVER up AS cum_before, lag(delay) OVER up AS before, row_number() OVER up AS place
        FROM (SELECT *, SUM(w) OVER (up ROWS UNBOUNDED PRECEDING) / SUM(w) OVER req AS cum
              FROM (SELECT *, greatest(TotalDelay, 0) AS delay,
                           1 / CASE WHEN distance = 0 THEN 1e-6 ELSE distance END AS w FROM neighbors)
              WINDOW req AS (PARTITION BY origin, dest, airline, month, day, dow, hour, k),
                     up AS (PARTITION BY origin, dest, airline, month, day, dow, hour, k ORDER BY delay, rank))
        WINDOW up AS (PARTITION BY origin, dest, airline, month, day, dow, hour, k ORDER BY delay, rank))
  GROUP BY origin, dest, airline, month, day, dow, hour, k)""", HISTORY, CANDIDATES, NEIGHBORS)

KNN = """
asked AS (
  SELECT DISTINCT origin, dest, (DepHour * 5 + Month * 2) % 28 + 1 AS day,
         CAST(isodow(make_date(2024, Month, (DepHour * 5 + Month * 2) % 28 + 1)) AS INTEGER) AS dow,
         Month AS month, DepHour AS hour, (Month * 7 + DepHour) % 23 + 3 AS k
  FROM history
  UNION ALL SELECT 99999, 10001, 15, 1, 7, 8, 5
),
nearest AS (
  SELECT *, CAST(row_number() OVER (
           PARTITION BY origin, dest, month, hour
           ORDER BY d2, Year DESC, at_month, at_day, DepTime, TotalDelay) AS INTEGER) AS rank
  FROM (SELECT r.*, h.Year, h.Month AS at_month, h.DayofMonth AS at_day, h.DepTime, h.TotalDelay,
               (h.DayofMonth - r.day) ** 2 + (h.DayOfWeek - r.dow) ** 2 + (h.Month - r.month) ** 2
               + (h.DepHour - r.hour) ** 2 AS d2
        FROM asked r JOIN history h ON h.origin = r.origin AND h.dest = r.dest)
  QUALIFY rank <= k
)"""
on_tables("knn_neighbors", """
SELECT origin, dest, day, dow, month, hour, k, rank, round(sqrt(d2), 6) AS distance, TotalDelay FROM nearest""", HISTORY, KNN)
on_tables("knn_mean_forecast", """
SELECT a.origin, a.dest, a.day, a.dow, a.month, a.hour, a.k, CAST(COUNT(n.rank) AS INTEGER) AS neighbors,
       round(coalesce(greatest(AVG(n.TotalDelay), 0), 0), 6) AS forecast
FROM asked a LEFT JOIN nearest n USING (origin, dest, month, hour)
GROUP BY a.origin, a.dest, a.day, a.dow, a.month, a.hour, a.k""", HISTORY, KNN)

# Lookup, scenarios and training -------------------------------------------------------

RANKS = [("p10", 1), ("p50", 2), ("p90", 3)]
HIST = [(f"hist_{p}_{stem}_delay", stem, i) for stem in CAUSE_STEMS for p, i in RANKS]
CELL_KEYS = "carrier_code, origin_id, dest_id, month, dow, time_of_day_category"
CELLS = f"""
keyed AS (
  SELECT {AIRLINE} AS carrier_code, {ORIGIN} AS origin_id, {DEST} AS dest_id, Month AS month,
         {DOW} AS dow, {time_of_day('(CRSDepTime // 100)')} AS time_of_day_category,
         CRSElapsedTime, Distance, {TOTAL_DELAY} AS total,
         {', '.join(f'COALESCE({c}, 0) AS {stem}' for c, stem in zip(CAUSES, CAUSE_STEMS))},
         CASE WHEN Month * 100 + DayofMonth IN (101, 704, 1225, 1226) THEN 1.0::DOUBLE ELSE 0 END AS holiday,
         CASE WHEN CRSDepTime // 100 IN (6, 7, 8, 16, 17, 18) THEN 1.0::DOUBLE ELSE 0 END AS peak
  FROM flights WHERE DOT_ID_Reporting_Airline IS NOT NULL AND CRSDepTime IS NOT NULL
),
ranked AS (
  SELECT {CELL_KEYS}, AVG(CRSElapsedTime) AS elapsed, AVG(Distance) AS miles,
         {', '.join(f'quantile_cont({v}, [0.1, 0.5, 0.9]) AS q_{v}' for v in [*CAUSE_STEMS, 'total'])},
         MAX(holiday) AS has_holiday_effect, MAX(peak) AS has_peak_hour
  FROM keyed GROUP BY {CELL_KEYS}
),
cells AS (
  SELECT {CELL_KEYS}, round(elapsed, 6) AS avg_crs_elapsed_time, round(miles, 6) AS avg_distance,
         {', '.join(f'round(q_{stem}[{i}], 6) AS {name}' for name, stem, i in HIST)},
         {', '.join(f'q_total[{i}] AS total_{p}' for p, i in RANKS)}, has_holiday_effect, has_peak_hour
  FROM ranked
)"""
STATS = ["avg_crs_elapsed_time", "avg_distance", *[name for name, _, _ in HIST]]
on_tables("inference_lookup", f"SELECT {CELL_KEYS}, {', '.join(STATS)} FROM cells", CELLS)


def distance_category(miles: str) -> str:
    return (f"CAST(CASE WHEN {miles} < 250 THEN 1 WHEN {miles} < 750 THEN 2 "
            f"WHEN {miles} < 1500 THEN 3 ELSE 4 END AS DOUBLE) AS distance_category")


def season(month: str) -> str:
    return (f"CAST(CASE WHEN {month} IN (12, 1, 2) THEN 1 WHEN {month} IN (3, 4, 5) THEN 2 "
            f"WHEN {month} IN (6, 7, 8) THEN 3 ELSE 4 END AS DOUBLE) AS season")


WEEKDAY = "CAST(CASE WHEN dow BETWEEN 1 AND 5 THEN 1 ELSE 0 END AS DOUBLE) AS pct_weekday"
CALENDAR = ("CAST(time_of_day_category AS DOUBLE) AS time_of_day_category, CAST(month AS DOUBLE) AS Month, "
            "CAST(dow AS DOUBLE) AS DayOfWeek")
on_tables("model_training_table", f"""
SELECT carrier_code, origin_id, dest_id, {CALENDAR}, {', '.join(STATS)}, {WEEKDAY},
       has_holiday_effect, has_peak_hour, {distance_category('avg_distance')}, {season('month')},
       {', '.join(f'round(ln(1 + total_{p}), 6) AS label_{p}' for p, _ in RANKS)}
FROM cells""", CELLS)

REQUESTS = f"""
planned AS (
  SELECT carrier_code, origin_id, dest_id,
         CAST(month_end - CAST((isodow(month_end) + 4) % 7 AS INTEGER) AS DATE) AS date, hour
  FROM (SELECT *, last_day(make_date(2024, CAST(m AS INTEGER), 1)) AS month_end
        FROM (SELECT DISTINCT {AIRLINE} AS carrier_code, {ORIGIN} AS origin_id, {DEST} AS dest_id
              FROM flights WHERE DOT_ID_Reporting_Airline IS NOT NULL),
             (SELECT unnest(range(1, 13)) AS m), (SELECT unnest([5, 8, 13, 17]) AS hour))
  UNION ALL SELECT '19790', '10001', '10001', DATE '2024-12-25', 8
),
requests AS (
  SELECT *, CAST(month(date) AS INTEGER) AS month, CAST(isodow(date) AS INTEGER) AS dow,
         {time_of_day('hour')} AS time_of_day_category
  FROM planned
)"""
DEFAULTS = {"avg_crs_elapsed_time": 180, "avg_distance": 1000}
BACKOFF = f"""
by_month AS (
  SELECT * FROM cells QUALIFY row_number() OVER (
    PARTITION BY carrier_code, origin_id, dest_id, month, time_of_day_category ORDER BY dow) = 1
),
by_route AS (
  SELECT * FROM cells QUALIFY row_number() OVER (
    PARTITION BY carrier_code, origin_id, dest_id, time_of_day_category ORDER BY month, dow) = 1
),
backoff AS (
  SELECT r.*, CASE WHEN c1.month IS NOT NULL THEN 1 WHEN c2.month IS NOT NULL THEN 2
                   WHEN c3.month IS NOT NULL THEN 3 ELSE 4 END AS match_level,
         {', '.join(f'COALESCE(c1.{s}, c2.{s}, c3.{s}, {DEFAULTS.get(s, 0)}) AS {s}' for s in STATS)}
  FROM requests r
  LEFT JOIN cells c1 USING (carrier_code, origin_id, dest_id, month, dow, time_of_day_category)
  LEFT JOIN by_month c2 USING (carrier_code, origin_id, dest_id, month, time_of_day_category)
  LEFT JOIN by_route c3 USING (carrier_code, origin_id, dest_id, time_of_day_category)
)"""
on_tables("lookup_backoff", f"""
SELECT carrier_code, origin_id, dest_id, date, hour, month, dow, time_of_day_category, match_level,
       {', '.join(STATS)} FROM backoff""", CELLS, REQUESTS, BACKOFF)
on_tables("scenario_features", f"""
SELECT carrier_code, origin_id, dest_id, date, hour, {CALENDAR}, {', '.join(STATS)}, {WEEKDAY},
       CAST(CASE WHEN (month(date), day(date)) IN ((1, 1), (7, 4), (12, 25), (12, 26)) THEN 1 ELSE 0 END AS DOUBLE)
         AS has_holiday_effect,
       CAST(CASE WHEN (hour >= 6 AND hour < 9) OR (hour >= 16 AND hour < 19) THEN 1 ELSE 0 END AS DOUBLE)
         AS has_peak_hour,
       {distance_category('avg_distance')}, {season('month')}
FROM backoff""", CELLS, REQUESTS, BACKOFF)

# Models whose answers have a closed form ----------------------------------------------

STEPS = [("p10", 0.5, 0.25), ("p50", 1.0, 0.5), ("p90", 2.0, 1.0)]
PLANNED = "carrier_code, origin_id, dest_id, date, hour"
FLAGS = """
flags AS (
  SELECT DISTINCT carrier_code, origin_id, dest_id, date, hour, CAST(month > 6 AS INTEGER) AS late, CAST(dow > 3 AS INTEGER) AS late_week
  FROM requests
)"""
SHARES = """
shares AS (
  SELECT avg(CAST(month > 6 AS INTEGER)) AS half, avg(CAST(dow > 3 AS INTEGER)) AS week,
         avg(CAST(dow > 3 AS INTEGER)) FILTER (month > 6) AS week_late, avg(CAST(dow > 3 AS INTEGER)) FILTER (month <= 6) AS week_early
  FROM cells
)"""
STEP_VALUES = ", ".join(f"round(exp({a} * late + {b} * late_week) - 1, 6) AS {p}" for p, a, b in STEPS)
on_tables("attribution_residual", f"""
SELECT DISTINCT {PLANNED}, percentile, CAST(0 AS DOUBLE) AS residual
FROM requests, (SELECT unnest(['p10', 'p50', 'p90']) AS percentile)""", CELLS, REQUESTS)
on_tables("step_forecast", f"""
SELECT *, {band('p50')} AS band, p10 > p50 OR p50 > p90 AS crossed
FROM (SELECT {PLANNED}, {STEP_VALUES} FROM flags)""", CELLS, REQUESTS, FLAGS)
on_tables("step_importance", """
SELECT percentile, CAST(rank AS INTEGER) AS rank, feature, CAST(splits AS BIGINT) AS splits
FROM (SELECT unnest(['p10', 'p50', 'p90']) AS percentile),
     (VALUES (1, 'DayOfWeek', 2), (2, 'Month', 1)) t(rank, feature, splits)""")
on_tables("step_attribution", f"""
SELECT {PLANNED}, percentile, feature,
       round(CASE feature
         WHEN 'Month' THEN a * (late - half) + b * (CASE late WHEN 1 THEN week_late ELSE week_early END - week) / 2
         WHEN 'DayOfWeek' THEN b * (late_week - week) / 2 + b * (late_week - CASE late WHEN 1 THEN week_late ELSE week_early END) / 2
         ELSE 0 END, 6) + 0.0 AS contribution,
       round(a * half + b * week, 6) AS base_value
FROM flags, shares, (SELECT unnest({FEATURES}) AS feature),
     (VALUES {', '.join(f"('{p}', CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for p, a, b in STEPS)}) s(percentile, a, b)""",
          CELLS, REQUESTS, FLAGS, SHARES)
on_tables("step_descriptions", f"""
SELECT percentile, feature, description
FROM (SELECT unnest(['p10', 'p50', 'p90']) AS percentile),
     (VALUES {', '.join(f"('{f}', '{FEATURE_DESCRIPTIONS[f]}')" for f in ('Month', 'DayOfWeek'))}) t(feature, description)""")

TOP_ATTRIBUTION = f"""
step_parts AS ({{step}}),
step_top AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY {PLANNED}, percentile ORDER BY place) AS INTEGER) AS position
  FROM (SELECT * FROM (SELECT *, list_position({FEATURES}, feature) AS place FROM step_parts)
        QUALIFY row_number() OVER (PARTITION BY {PLANNED}, percentile ORDER BY abs(contribution) DESC, place DESC) <= 10)
)"""


def top_attribution(select: str) -> str:
    """A statement over the ten largest contributions of the step models."""
    head, _, step = ORACLE["step_attribution"].rpartition("\nSELECT ")
    return f"{head},{TOP_ATTRIBUTION.format(step='SELECT ' + step)}\n{select}"


ORACLE["step_attribution_top"] = top_attribution(f"""
SELECT {PLANNED}, percentile, position, feature, round_even(contribution, 2) + 0.0 AS contribution, base_value FROM step_top""")
ORACLE["step_descriptions_union"] = top_attribution(f"""
SELECT percentile, feature, description
FROM (SELECT unnest(['p10', 'p50', 'p90']) AS percentile, 'DayOfWeek' AS feature UNION SELECT percentile, feature FROM step_top)
JOIN (VALUES {', '.join("('" + f + "', '" + t.replace("'", "''") + "')" for f, t in FEATURE_DESCRIPTIONS.items())}) d(feature, description)
USING (feature)""")

# Order as a column --------------------------------------------------------------------

on_tables("absent_causes", "SELECT * REPLACE (CAST(0 AS DOUBLE) AS WeatherDelay, CAST(0 AS DOUBLE) AS SecurityDelay) FROM flights")
for name, source, order in [
        ("origins_in_order", "airports_by_date", f"{DATE_KEYS}, code"),
        ("airline_average_in_order", "airline_average", "avg_total_delay DESC, airline_code"),
        ("daily_trend_in_order", "daily_trend", "airline_code, DayofMonth")]:
    ORACLE[name] = f"SELECT *, row_number() OVER (ORDER BY {order}) AS row FROM ({ORACLE[source]})"

# The same results through other paths -------------------------------------------------

for name, source in [
        ("sql_named_frames", "sql_view_query"), ("pushed_selection", "filter_combined"), ("pushed_date", "filter_date"),
        ("pushed_month_dow", "filter_month_dow"), ("merged_lookup", "inference_lookup"),
        ("history_kpis", "kpi_summary"), ("history_routes", "route_summary"), ("history_center", "map_center"),
        ("history_dest_by_time", "dest_time_ratio"), ("history_heatmap", "heatmap_summary"),
        ("history_causes_positive", "cause_mean_positive"), ("history_causes_delayed", "cause_mean_delayed"),
        ("history_has_cause", "has_cause"),
        *[(f"stored_availability_{x}", f"availability_{x}") for x in ("cube", "origins", "dests", "airlines", "hours")]]:
    ORACLE[name] = ORACLE[source]

# The same tables through files and readers --------------------------------------------

for name, source in [("landed_flights", "scan_flights"), ("csv_flights", "scan_flights"), ("csv_airports", "scan_airports"),
                     ("csv_airlines", "scan_airlines"), ("read_lookup_table", "inference_lookup")]:
    ORACLE[name] = ORACLE[source]
