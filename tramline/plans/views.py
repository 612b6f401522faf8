"""The three served queries: route lines, stations, live train positions.

``t`` is a dict of the loaded tables: routes, stops, shapes (vertex rows), segments,
trips, stop_times, shape_stop_positions, vehicle_positions.
"""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.functions import geo
from tramline.functions.scalars import clamped_progress, epoch_seconds, hex_color, iso_utc
from tramline.operators.lines import extents, place_on_line, points_array, simplify
from tramline.operators.tracking import RUN, as_of_log, latest_positions, match_shapes, previous_of, previous_stop
from tramline.schemas import DEFAULT_ROUTE_COLOR, DEFAULT_TEXT_COLOR, STOPPED_AT
from tramline.sources.store import materialise

TOLERANCE_DEG = 1e-4
MAX_TOLERANCE_DEG = 0.01
RUNNING_SPEED_MPS = 11
FRESHNESS_MIN = 10


def stop_routes(stop_times: DataFrame, trips: DataFrame) -> DataFrame:
    """``stop_id, route_id, n``: which routes serve a stop, with the number of stop times."""
    return (
        stop_times.select("trip_id", "stop_id").join(trips.select("trip_id", "route_id"), "trip_id")
        .groupBy("stop_id", "route_id").agg(F.count("*").alias("n"))
    )


def route_shapes(trips: DataFrame) -> DataFrame:
    """``route_id, direction_id, shape_id, n``: the lines of a route and direction, with the number of trips."""
    return trips.where("shape_id is not null").groupBy("route_id", "direction_id", "shape_id").agg(F.count("*").alias("n"))


def representative_shapes(drawn: DataFrame, lengths: DataFrame) -> DataFrame:
    """``route_id, direction_id, shape_id``: the longest line per route and direction.

    ``drawn`` holds distinct triples (``route_shapes``), ``lengths`` a row per line
    (``extents``). No direction is a direction of its own; ties go to the smallest shape id.
    """
    longest = F.min(F.struct((-F.col("meters")).alias("m"), "shape_id"))
    return (
        drawn.select("route_id", "direction_id", "shape_id").join(lengths.select("shape_id", "meters"), "shape_id")
        .groupBy("route_id", "direction_id")
        .agg(longest.alias("best"))
        .select("route_id", "direction_id", "best.shape_id")
    )


def _pairs(t: dict, name: str) -> DataFrame:
    """A small table that the load keeps; worked out here where the tables come without it."""
    if name in t:
        return t[name]
    if name == "stop_routes":
        return stop_routes(t["stop_times"], t["trips"])
    return route_shapes(t["trips"]) if name == "route_shapes" else extents(t["segments"])


def _check_tolerance(tolerance: float) -> float:
    tolerance = float(tolerance)
    if not math.isfinite(tolerance) or not 0 <= tolerance <= MAX_TOLERANCE_DEG:
        raise ValueError(f"tolerance must lie between 0 and {MAX_TOLERANCE_DEG} degrees")
    return tolerance


def _drawn(t: dict, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """The representative shapes and their simplified vertices. Whether some line is too long for
    one task is looked up in the lengths, a row per line."""
    lengths = _pairs(t, "extents")
    chosen = representative_shapes(_pairs(t, "route_shapes"), lengths)
    longest = lengths.agg(F.max("n")).first()[0] or 0
    vertices = t["shapes"].join(chosen.select("shape_id").distinct(), "shape_id", "left_semi")
    return chosen, simplify(vertices, tolerance, longest=longest + 1)


def route_line_vertices(t: dict, tolerance: float = TOLERANCE_DEG) -> DataFrame:
    """The drawn lines as vertex rows: ``shape_id, seq, ord, lon, lat``."""
    return _drawn(t, _check_tolerance(tolerance))[1]


def route_lines(t: dict, tolerance: float = TOLERANCE_DEG) -> DataFrame:
    """One feature per route and direction, with ``geometry`` as GeoJSON text."""
    chosen, drawn = _drawn(t, _check_tolerance(tolerance))
    geometry = points_array(drawn).select("shape_id", geo.as_geojson_line(F.col("points")).alias("geometry"))
    return (
        chosen.join(t["routes"], "route_id")
        .join(geometry, "shape_id", "left")
        .select(
            "geometry", "shape_id", "route_id", "route_short_name", "route_long_name",
            hex_color(F.col("route_color"), DEFAULT_ROUTE_COLOR).alias("route_color"),
            hex_color(F.col("route_text_color"), DEFAULT_TEXT_COLOR).alias("route_text_color"),
            "direction_id",
        )
        .orderBy("route_id", F.asc_nulls_last("direction_id"))
    )


def station_routes(t: dict) -> DataFrame:
    """``station_id, routes``: sorted distinct short names, platforms rolled up to stations.

    What is collected per station are distinct route names of the (stop, route) pairs.
    """
    return (
        _pairs(t, "stop_routes").join(t["stops"].select("stop_id", "parent_station"), "stop_id")
        .join(t["routes"].select("route_id", "route_short_name"), "route_id")
        .groupBy(F.coalesce("parent_station", "stop_id").alias("station_id"))
        .agg(F.array_sort(F.collect_set("route_short_name")).alias("routes"))
    )


def stations(t: dict) -> DataFrame:
    """Stations with service, one feature each."""
    return (
        t["stops"].where("location_type = 1")
        .join(station_routes(t), F.col("stop_id") == F.col("station_id"))
        .select(geo.as_geojson_point(F.col("lon"), F.col("lat")).alias("geometry"), "stop_id", "stop_name", "routes")
        .orderBy("stop_id")
    )


def station_layer(stations: DataFrame) -> DataFrame:
    """Station labels: the routes as one text and their number."""
    return stations.select(
        "stop_id", "stop_name", F.array_join("routes", ", ").alias("routes"), F.size("routes").alias("route_count")
    )


def located(
    t: dict, as_of: datetime, speed_mps: float = RUNNING_SPEED_MPS, freshness_min: float = FRESHNESS_MIN,
    replay: bool = False,
) -> DataFrame:
    """Fresh runs with ``fraction`` along their line where known, the line's ``total`` and ``n``,
    and ``position_source``.

    The stop before comes from ``t["halts"]``, a row per live run that the stream keeps up, so
    that only the day partitions of fresh rows are read. A replay, or tables without halts,
    look through the history, cut to the runs asked for.
    """
    known = "halts" in t and not replay
    log = as_of_log(t["vehicle_positions"], as_of) if replay else t["vehicle_positions"]
    latest = match_shapes(latest_positions(log, as_of, freshness_min), t["trips"])
    if known:
        runs = previous_of(latest, t["halts"])
    else:
        latest = materialise(latest, "latest")
        runs = previous_stop(latest, _of_live_runs(log, latest, replay))
    spots = t["shape_stop_positions"]
    following = spots.select("shape_id", "stop_id", F.col("fraction").alias("next_fraction"))
    passed = spots.select("shape_id", F.col("stop_id").alias("prev_stop_id"), F.col("fraction").alias("prev_fraction"))
    rows = (
        runs.join(following, ["shape_id", "stop_id"], "left")
        .join(passed, ["shape_id", "prev_stop_id"], "left")
        .join(_pairs(t, "extents"), "shape_id", "left")
    )
    ahead, behind = F.col("next_fraction"), F.col("prev_fraction")
    needed = F.abs(ahead - behind) * F.col("meters") / speed_mps
    progress = clamped_progress(epoch_seconds(F.lit(as_of)) - epoch_seconds(F.col("prev_at")), needed)
    standing = (F.col("current_status") == STOPPED_AT) & ahead.isNotNull()
    between = ahead.isNotNull() & behind.isNotNull()
    return rows.withColumn(
        "position_source",
        F.when(standing, "shape_stop").when(between, "interpolated").otherwise("station_fallback"),
    ).withColumn("fraction", F.when(standing, ahead).when(between, behind + (ahead - behind) * progress))


def _of_live_runs(log: DataFrame, latest: DataFrame, replay: bool) -> DataFrame:
    """In a replay, the days from the eve of the first service day asked for: a run has no rows before."""
    if not replay or "observed_date" not in log.columns:
        return log
    first = latest.agg(F.date_sub(F.min("trip_start_date"), 1)).first()[0]
    return log if first is None else log.where(F.col("observed_date") >= F.lit(first))


def vehicle_positions(
    t: dict, as_of: datetime, speed_mps: float = RUNNING_SPEED_MPS, freshness_min: float = FRESHNESS_MIN,
    replay: bool = False,
) -> DataFrame:
    """One feature per fresh train: ``lon, lat`` and properties; trains without a place drop out.

    ``replay`` ignores rows observed after ``as_of``. With ``t["halts"]`` this is one lazy plan.
    """
    columns = [*RUN, "route_id", "stop_id", "current_status", "observed_at", "position_source", "shape_id", "fraction", "total", "n"]
    runs = located(t, as_of, speed_mps, freshness_min, replay).select(*columns)
    placed = place_on_line(runs, t["segments"], [*RUN, "route_id", "stop_id", "current_status", "observed_at", "position_source"])
    stops = t["stops"].select("stop_id", "stop_name", F.col("lon").alias("stop_lon"), F.col("lat").alias("stop_lat"))
    at_stop = F.col("position_source") == "station_fallback"
    return (
        placed.join(stops, "stop_id", "left")
        .join(t["routes"].select("route_id", "route_color"), "route_id", "left")
        .withColumn("lon", F.when(at_stop, F.col("stop_lon")).otherwise(F.col("line_lon")))
        .withColumn("lat", F.when(at_stop, F.col("stop_lat")).otherwise(F.col("line_lat")))
        .where("lon is not null and lat is not null")
        .select(
            "lon", "lat", *RUN, "route_id",
            hex_color(F.col("route_color"), DEFAULT_ROUTE_COLOR).alias("route_color"),
            "stop_id", "stop_name", "current_status", iso_utc(F.col("observed_at")).alias("observed_at"),
            "position_source",
        )
    )
