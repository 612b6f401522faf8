"""Check panels over the loaded tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.functions import geo
from tramline.functions.scalars import clock_text, text_head
from tramline.operators.lines import length_m, points_array, summary
from tramline.operators.spatial import nearby
from tramline.schemas import KEYS

DAY = 24 * 3600
# NOT NULL columns and references of the data model.
NOT_NULL = {
    "routes": ["route_short_name"],
    "stops": ["stop_name", "lon", "lat"],
    "trips": ["route_id", "service_id"],
    "stop_times": ["stop_id"],
    "shape_stop_positions": ["fraction"],
    "scheduled_headway": ["scheduled_trips"],
    "vehicle_positions": ["trip_id", "trip_start_date", "route_id", "observed_at"],
    "stop_events": ["route_id", "arrived_at"],
}
REFERENCES = [
    ("stops", "parent_station", "stops", "stop_id"),
    ("trips", "route_id", "routes", "route_id"),
    ("trips", "shape_id", "shapes", "shape_id"),
    ("stop_times", "trip_id", "trips", "trip_id"),
    ("stop_times", "stop_id", "stops", "stop_id"),
    ("shape_stop_positions", "shape_id", "shapes", "shape_id"),
    ("shape_stop_positions", "stop_id", "stops", "stop_id"),
    ("scheduled_headway", "stop_id", "stops", "stop_id"),
    ("scheduled_headway", "route_id", "routes", "route_id"),
]


def constraint_audit(t: dict) -> DataFrame:
    """``constraint_name, violations`` for every key, NOT NULL, check and reference whose tables are given.

    NULL and range checks of a table share one scan.
    """

    def row(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("constraint_name"), "violations")

    checks = []
    for table, keys in KEYS.items():
        if table in t:
            repeated = t[table].groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
            checks.append(row(f"{table} unique ({', '.join(keys)})", repeated))
    for table, extra in NOT_NULL.items():
        if table in t:
            broken = {f"{table}.{c} not null": F.col(c).isNull() for c in dict.fromkeys([*KEYS.get(table, []), *extra])}
            if table == "scheduled_headway":
                broken["scheduled_headway.hour_bucket range"] = ~F.col("hour_bucket").between(0, 47)
            counts = t[table].agg(*(F.count_if(c).alias(f"c{i}") for i, c in enumerate(broken.values())))
            found = F.array(*(
                F.struct(F.lit(name).alias("constraint_name"), F.col(f"c{i}").alias("violations"))
                for i, name in enumerate(broken)
            ))
            checks.append(counts.select(F.inline(found)))
    for table, column, parent, key in REFERENCES:
        if table in t and parent in t:
            # Counted per value before the shuffle.
            child = t[table].where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
            lost = child.join(t[parent].select(F.col(key).alias(column)).distinct(), column, "left_anti")
            checks.append(lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).select(
                F.lit(f"{table}.{column} -> {parent}").alias("constraint_name"), "violations"
            ))
    return reduce(DataFrame.unionByName, checks)


def row_counts(t: dict, tables: list[str]) -> DataFrame:
    """``table_name, rows``; a shape counts once, not per vertex."""

    def count(name: str) -> DataFrame:
        df = t[name].select("shape_id").distinct() if name == "shapes" else t[name]
        return df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")

    return reduce(DataFrame.unionByName, (count(name) for name in tables)).orderBy("table_name")


def past_midnight(stop_times: DataFrame) -> DataFrame:
    arrival = F.col("arrival_sec")
    return stop_times.agg(
        clock_text(F.max(arrival)).alias("max_arrival"),
        F.count_if(arrival >= DAY).alias("past_midnight"),
        F.count_if(arrival >= 28 * 3600).alias("past_28h"),
    )


def station_structure(stops: DataFrame) -> DataFrame:
    ids = stops.select(F.col("stop_id").alias("parent_station")).distinct().withColumn("_found", F.lit(True))
    parent = F.col("parent_station")
    return stops.join(ids, "parent_station", "left").agg(
        F.count_if(F.col("location_type") == 1).alias("stations"),
        F.count_if(parent.isNotNull()).alias("platforms"),
        F.count_if(parent.isNotNull() & F.col("_found").isNull()).alias("orphan_parents"),
    )


def platform_vs_station(stop_times: DataFrame, stops: DataFrame, station_id: str, platforms: tuple[str, str]) -> DataFrame:
    """Stop times of one station counted four ways, in one pass."""
    stop = F.col("stop_id")
    parents = stops.select("stop_id", "parent_station", F.lit(True).alias("_known"))
    rolled = (F.col("parent_station") == station_id) | (stop == station_id)
    # Only rows of this station can count, so the filters go below the join.
    own = parents.where((F.col("parent_station") == station_id) | stop.isin(station_id, *platforms))
    return stop_times.select("stop_id").join(own, "stop_id", "left").agg(
        F.count_if(stop == station_id).alias("by_station_id_alone"),
        F.count_if(stop == platforms[0]).alias("first_platform"),
        F.count_if(stop == platforms[1]).alias("second_platform"),
        F.count_if(F.col("_known").isNotNull() & rolled).alias("rolled_up_through_parent"),
    )


def station_rollup(stop_times: DataFrame, stops: DataFrame) -> DataFrame:
    """``station_id, stop_times``: rows per station, platforms included."""
    per_stop = stop_times.groupBy("stop_id").agg(F.count("*").alias("n"))
    return (
        per_stop.join(stops.select("stop_id", "parent_station"), "stop_id")
        .groupBy(F.coalesce("parent_station", "stop_id").alias("station_id"))
        .agg(F.sum("n").alias("stop_times"))
    )


def longest_shape_of_route(t: dict, short_name: str) -> DataFrame:
    """The longest line of a route: vertices, validity, metres, start of its GeoJSON."""
    named = t["routes"].where(F.col("route_short_name") == short_name).select("route_id", "route_short_name")
    used = t["trips"].where("shape_id is not null").join(named, "route_id").select("shape_id", "route_short_name").distinct()
    best = (
        used.join(length_m(t["segments"]), "shape_id")
        # Lengths equal to the millimetre are ties.
        .orderBy(F.desc(F.round("meters", 3)), "shape_id", "route_short_name")
        .limit(1)
    )
    vertices = t["shapes"].join(best.select("shape_id"), "shape_id", "left_semi")
    return best.join(summary(vertices), "shape_id").join(points_array(vertices), "shape_id").select(
        "shape_id", F.col("route_short_name").alias("route"), "vertices", "valid",
        F.round("meters").alias("length_meters"),
        text_head(geo.as_geojson_line(F.col("points"))).alias("geojson_head"),
    )


def station_pair_distance(stops: DataFrame, from_id: str, to_id: str) -> DataFrame:
    """One row about two stops: metres apart, and whether within 200 m and 1 km."""
    def one(stop_id: str, side: str) -> DataFrame:
        return stops.where(F.col("stop_id") == stop_id).select(
            F.lit(1).alias("_pair"),
            F.col("stop_id").alias(f"{side}_id"), F.col("stop_name").alias(f"{side}_name"),
            F.col("lon").alias(f"{side}_lon"), F.col("lat").alias(f"{side}_lat"),
        )

    metres = geo.spheroid_m(F.col("from_lon"), F.col("from_lat"), F.col("to_lon"), F.col("to_lat"))
    return one(from_id, "from").join(one(to_id, "to"), "_pair").select(
        "from_id", "from_name", "to_id", "to_name",
        F.round(metres, 1).alias("meters"), (metres <= 200).alias("within_200m"), (metres <= 1000).alias("within_1km"),
    )


def nearby_stations(stops: DataFrame, radius_m: float = 200, exclude_same_complex: bool = True) -> DataFrame:
    """Pairs of stations within ``radius_m``.

    With ``exclude_same_complex`` pairs under one parent are left out. Without it the
    literal condition ``a.parent IS DISTINCT FROM b.parent`` applies, which no two
    parentless stations can meet.
    """
    if exclude_same_complex:
        complex_of = lambda s: F.coalesce(f"{s}_parent_station", f"{s}_stop_id")
        also = complex_of("a") != complex_of("b")
    else:
        also = ~F.col("a_parent_station").eqNullSafe(F.col("b_parent_station"))
    found = stops.where("location_type = 1").select("stop_id", "parent_station", "lon", "lat")
    return nearby(found, radius_m, also).select("a_stop_id", "b_stop_id", "meters")
