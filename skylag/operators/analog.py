"""Forecasts from the nearest historical flights, for a whole table of requests.

A flight is described by (day, weekday, month, hour): small whole numbers, so history
falls on a lattice. Flights on one lattice cell are equally far from any request, hence
only the first ``MAX_K`` of a cell, in tie order, can ever be among its neighbours. Cutting
cells to that many rows is exact, happens inside each task before the shuffle, and bounds
what a request can meet however many flights a route has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skylag import functions as fn
from skylag.operators.filters import by_airlines, keep, require
from skylag.schemas import PERCENTILES
from skylag.session import materialize

# Bounds and defaults of k, distance used for an exact match.
MAX_K, DEFAULT_K, MEAN_K = 20, 10, 5
EXACT_DISTANCE = 1e-6
MIN_FOR_PERCENTILES = 3

ROUTE_AIRLINE = ["origin", "dest", "airline"]
LATTICE = ["DayofMonth", "DayOfWeek", "Month", "DepHour"]
HISTORY = [*ROUTE_AIRLINE, "Year", *LATTICE, "DepTime", "TotalDelay"]
REQUEST = [*ROUTE_AIRLINE, "month", "day", "dow", "hour", "k"]


def training_rows(flights: DataFrame, airlines=None) -> DataFrame:
    """Flights of every route as forecast history; day, month and time must be known.

    Codes stay numbers: requests are cast to them, never the history to text.
    """
    known = require(flights, ["DayofMonth", "Month", "CRSDepTime"])
    return keep(known, by_airlines(airlines)).select(
        F.col("OriginAirportID").alias("origin"),
        F.col("DestAirportID").alias("dest"),
        F.col("DOT_ID_Reporting_Airline").alias("airline"),
        "Year", "DayofMonth",
        fn.weekday_of(flights).alias("DayOfWeek"),
        "Month",
        fn.hour_of(flights).alias("DepHour"),
        F.col("CRSDepTime").alias("DepTime"),
        fn.total_delay().alias("TotalDelay"),
    )


def _tie_order() -> list[Column]:
    """Order of equally distant flights: later years first, then day, time and delay."""
    return [F.desc("Year"), F.col("DayofMonth"), F.col("DepTime"), F.col("TotalDelay")]


def first_per_cell(history: DataFrame, keys: list[str], max_k: int = MAX_K) -> DataFrame:
    """The first ``max_k`` flights of every lattice cell; no other can be a neighbour."""
    window = Window.partitionBy(*keys, *LATTICE).orderBy(*_tie_order())
    return (
        history.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= max_k).drop("_n")
    )


def distinct_history(history: DataFrame) -> DataFrame:
    """Equal flights of a route and airline count once.

    Dropping rows without a key here, for both matching rules, lets them share one shuffle.
    """
    return require(history.select(*HISTORY), [*ROUTE_AIRLINE, *LATTICE]).distinct()


def _bounded_k(requests: DataFrame, max_k: int) -> DataFrame:
    """A k above the bound fails rather than losing neighbours."""
    failure = F.raise_error(F.lit(f"k must lie in 1..{max_k}")).cast("int")
    return requests.withColumn(
        "k", F.when(F.col("k").between(1, max_k), F.col("k")).otherwise(failure))


def _checked(requests: DataFrame, max_k: int) -> DataFrame:
    return _bounded_k(requests, max_k).select(*REQUEST).distinct()


def match_candidates(requests: DataFrame, flights: DataFrame) -> DataFrame:
    """Same route, airline, month and hour, and the same weekday (DOW) or the same day (DOM).

    Two equi-joins, one per rule: a flight that meets both appears under both.
    """
    r, f = requests.alias("r"), flights.alias("f")
    same_slot = [
        *[F.col(f"r.{c}") == F.col(f"f.{c}") for c in ROUTE_AIRLINE],
        F.col("r.month") == F.col("f.Month"), F.col("r.hour") == F.col("f.DepHour"),
    ]
    shared = [*ROUTE_AIRLINE, "Month", "DepHour"]
    columns = [*[f"r.{c}" for c in REQUEST], *[f"f.{c}" for c in HISTORY if c not in shared]]

    def rule(same: Column, tag: str) -> DataFrame:
        return r.join(f, [*same_slot, same]).select(*columns, F.lit(tag).alias("Group"))

    return rule(F.col("r.dow") == F.col("f.DayOfWeek"), "DOW").unionByName(
        rule(F.col("r.day") == F.col("f.DayofMonth"), "DOM"))


def analog_candidates(requests: DataFrame, history: DataFrame, max_k: int = MAX_K) -> DataFrame:
    """All flights that a request may draw its neighbours from."""
    return match_candidates(_checked(requests, max_k), distinct_history(history))


def _distance() -> Column:
    """Euclidean distance; month and hour are equal within candidates."""
    day, dow = F.col("day") - F.col("DayofMonth"), F.col("dow") - F.col("DayOfWeek")
    return F.sqrt((day * day + dow * dow).cast("double"))


def analog_neighbors(requests: DataFrame, history: DataFrame, max_k: int = MAX_K) -> DataFrame:
    """The k nearest candidates of every request, ranked."""
    cells = first_per_cell(distinct_history(history), ROUTE_AIRLINE, max_k)
    candidates = match_candidates(_checked(requests, max_k), cells)
    window = Window.partitionBy(*REQUEST).orderBy(F.col("distance"), *_tie_order(), F.col("Group"))
    return (
        candidates.withColumn("distance", _distance())
        .withColumn("rank", F.row_number().over(window))
        # The literal bound lets Spark cut every request's rows before the shuffle.
        .where((F.col("rank") <= max_k) & (F.col("rank") <= F.col("k")))
    )


def shown_neighbors(neighbors: DataFrame) -> DataFrame:
    """Neighbours as listed with the forecast."""
    return neighbors.select(
        *REQUEST, "rank",
        fn.date_text(F.col("Year"), F.col("month"), F.col("DayofMonth")).alias("Date"),
        fn.day_name(F.col("DayOfWeek")).alias("DayOfWeek"),
        fn.format_time(F.col("DepTime")).alias("scheduled_dep_time"),
        "TotalDelay", "Group", "distance",
    )


def weighted_percentiles(neighbors: DataFrame, keys: list[str] = REQUEST) -> DataFrame:
    """P10, P50 and P90 of neighbour delays, weighted by inverse distance.

    The cumulative weight runs over ascending delay; between two delays the value is linear
    in it, below the first it is the first delay. With fewer than three neighbours all three
    are the mean.
    """
    request = Window.partitionBy(*keys)
    ascending = request.orderBy("delay", "rank")
    weighted = neighbors.select(
        *keys, "rank", fn.clamp_delay(F.col("TotalDelay")).alias("delay"),
        (1 / F.when(F.col("distance") == 0, EXACT_DISTANCE).otherwise(F.col("distance"))).alias("w"),
    )
    to_here = ascending.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    curve = weighted.withColumns({
        "cum": F.sum("w").over(to_here) / F.sum("w").over(request),
        "place": F.row_number().over(ascending),
    }).withColumns({
        "cum_before": F.lag("cum").over(ascending),
        "delay_before": F.lag("delay").over(ascending),
    })

    def at(p: float) -> Column:
        share = (p - F.col("cum_before")) / (F.col("cum") - F.col("cum_before"))
        between = F.col("delay_before") + share * (F.col("delay") - F.col("delay_before"))
        reached = F.col("cum") >= p
        value = F.when(reached, F.when(F.col("place") == 1, F.col("delay")).otherwise(between))
        return F.min_by(value, F.when(reached, F.col("place")))

    summary = curve.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("int").alias("k_eff"),
        F.avg("delay").alias("_mean"),
        *[at(p).alias(f"_{name}") for name, p in PERCENTILES.items()],
    )
    few = F.col("k_eff") < MIN_FOR_PERCENTILES
    return summary.select(
        *keys, "k_eff",
        *[F.when(few, F.col("_mean")).otherwise(F.col(f"_{name}")).alias(name)
          for name in PERCENTILES],
    )


def analog_forecast(requests: DataFrame, history: DataFrame, max_k: int = MAX_K) -> DataFrame:
    """P10, P50, P90 and the outlook for every request that has candidates."""
    forecast = weighted_percentiles(analog_neighbors(requests, history, max_k))
    return forecast.withColumn("band", fn.forecast_band(F.col("p50")))


# Mean of the k nearest over a whole route ---------------------------------------------

# Radii searched one after the other. The blocks of a radius are twice as wide, so a request's ball meets at most two
# along each axis; the last radius is wider than the lattice.
RADII = (2, 4, 8, 16, 32, 64)
MEAN_KEYS = ["origin", "dest"]
# Request column and the history column it is compared with.
POINT = {"day": "DayofMonth", "dow": "DayOfWeek", "month": "Month", "hour": "DepHour"}
AT = {p: f"at_{p}" for p in POINT}


def _in_blocks(cells: DataFrame, radius: int) -> DataFrame:
    """Cells with the block of a radius that each lies in."""
    return cells.withColumns({f"{p}_block": F.floor(F.col(at) / (2 * radius)) for p, at in AT.items()})


def _around(requests: DataFrame, radius: int) -> DataFrame:
    """Each request once per block that may hold a point within the radius, 16 at most."""
    for p in POINT:
        ends = F.array(*[F.floor((F.col(p) + sign * radius) / (2 * radius)) for sign in (-1, 1)])
        requests = requests.withColumn(f"{p}_block", F.explode(F.array_distinct(ends)))
    return requests


def _squared_gap() -> Column:
    """Squared Euclidean distance on the lattice, a whole number."""
    gaps = [F.col(p) - F.col(at) for p, at in AT.items()]
    return sum((g * g for g in gaps), F.lit(0))


def _nearest(pairs: DataFrame, request: list[str], max_k: int) -> DataFrame:
    window = Window.partitionBy(*request).orderBy(
        "d2", F.desc("Year"), "at_month", "at_day", "DepTime", "TotalDelay")
    return (
        pairs.withColumn("rank", F.row_number().over(window))
        .where((F.col("rank") <= max_k) & (F.col("rank") <= F.col("k")))
    )


def _met(requests: DataFrame, cells: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Requests with the cells of their route within a radius, by an equi-join on blocks."""
    blocks = [f"{p}_block" for p in POINT]
    joined = _around(requests, radius).join(_in_blocks(cells, radius), [*keys, *blocks])
    return joined.withColumn("d2", _squared_gap()).where(F.col("d2") <= radius * radius).drop(*blocks)


def _ring(requests: DataFrame, counts: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Requests with ``reach``, the squared distance of their k-th flight; null if fewer lie within the radius.

    Only the number of flights per distance is needed, so what a request meets is reduced to a short histogram where it
    arises. At the last radius all flights of the route are met, and the last one takes the place of the k-th.
    """
    request = [*keys, *POINT, "k"]
    rings = _met(requests, counts, keys, radius).groupBy(*request, "d2").agg(F.sum("n").alias("n"))
    outward = Window.partitionBy(*request).orderBy("d2")
    reach = F.min(F.when(F.col("met") >= F.col("k"), F.col("d2")))
    if radius == RADII[-1]:
        reach = F.coalesce(reach, F.max("d2"))
    reached = rings.withColumn("met", F.sum("n").over(outward)).groupBy(*request).agg(reach.alias("reach"))
    return requests.join(reached, request, "left")


def _largest_k(requests: DataFrame) -> int:
    """The bound of k is what the requests ask for; a k below 1 or none fails."""
    failure = F.raise_error(F.lit("k must be at least 1")).cast("int")
    return requests.agg(F.max(F.when(F.col("k") >= 1, F.col("k")).otherwise(failure))).first()[0] or 1


def knn_neighbors(requests: DataFrame, history: DataFrame, keys: list[str] = MEAN_KEYS,
                  max_k: int | None = None) -> DataFrame:
    """The k nearest flights of the request's route (and airline, if among ``keys``).

    How far the k-th flight lies is found by expanding rings: the radius doubles, and the blocks that requests and cells are
    joined on grow with it. Only requests that have not met k flights go on to the next ring, so a request in dense
    history meets the few cells around it and none the flights of its whole route. Each request then fetches
    the flights within its reach from the blocks of the ring where it ended, which makes the last ring exact.
    Requests, cells and rings are read by several branches and written once.
    """
    request = [*keys, *POINT, "k"]
    wanted = materialize(requests.select(*request).distinct(), "knn-requests")
    max_k = max_k or _largest_k(wanted)
    open_ = _bounded_k(wanted, max_k)
    cells = first_per_cell(
        history.select(*keys, "Year", *LATTICE, "DepTime", "TotalDelay"), keys, max_k
    ).select(*keys, *[F.col(c).alias(AT[p]) for p, c in POINT.items()], "Year", "DepTime", "TotalDelay")
    flights = materialize(cells, "knn-cells")
    counts = materialize(flights.groupBy(*keys, *AT.values()).agg(F.count(F.lit(1)).alias("n")), "knn-counts")

    # A route without history has no ring to end in.
    open_ = open_.join(counts.select(*keys).distinct(), keys, "left_semi")
    found = None
    for radius in RADII:
        ring = materialize(_ring(open_, counts, keys, radius), "knn-ring")
        near = _met(ring.where("reach is not null"), flights, keys, radius).where(F.col("d2") <= F.col("reach")).drop("reach")
        found = near if found is None else found.unionByName(near)
        open_ = ring.where("reach is null").drop("reach")
        if open_.isEmpty():
            break
    return _nearest(found, request, max_k).withColumn("distance", F.sqrt(F.col("d2").cast("double"))).drop("d2")


def knn_mean_forecast(requests: DataFrame, history: DataFrame, keys: list[str] = MEAN_KEYS,
                      max_k: int | None = None) -> DataFrame:
    """Mean delay of the k nearest flights, not below 0; 0 from no neighbours on a route without history."""
    request = [*keys, *POINT, "k"]
    means = knn_neighbors(requests, history, keys, max_k).groupBy(*request).agg(
        F.count(F.lit(1)).cast("int").alias("neighbors"),
        fn.clamp_delay(F.avg("TotalDelay")).alias("forecast"),
    )
    none = {"neighbors": F.coalesce("neighbors", F.lit(0)), "forecast": F.coalesce("forecast", F.lit(0.0))}
    return requests.select(*request).distinct().join(means, request, "left").withColumns(none)
