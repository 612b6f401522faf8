"""Geometry, joins, aggregates, realtime operators and the composite queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from fixtures import raw, snapshots, tables
from registry.base import query
from registry.ctes import interpolated, metres, simplified, sql, vehicles
from tramline.functions import geo, scalars
from tramline.operators import lines, quality, spatial, tracking
from tramline.plans import audit, headway, positions, views
from tramline.sources import geojson
from tramline.streaming import changes

AS_OF, AS_OF_S = datetime(2024, 1, 31), 1706659200
REPLAY, REPLAY_S = datetime(2024, 1, 20, 12), 1705752000
FRESH_MIN = 720  # the polls of the test data are 12 hours apart
RADIUS_M = 3000
TOLERANCE = 1e-3


def _date(name="trip_start_date"):
    return F.col(name).cast("string").alias(name)


# --- geometry -----------------------------------------------------------------------------


@query("ewkt_points", sql("SELECT stop_id, 'SRID=4326;POINT(' || CAST(lon AS VARCHAR) || ' ' || CAST(lat AS VARCHAR) || ')' AS ewkt FROM c_stops"))
def _(spark, d):
    return tables(spark, d)["stops"].select("stop_id", geo.ewkt_point(F.col("lon"), F.col("lat")).alias("ewkt"))


@query("build_shapes", sql("SELECT shape_id, seq, lon, lat FROM c_shapes"))
def _(spark, d):
    return quality.clean_shapes(raw(spark, d)["shapes"])[0].select("shape_id", "seq", "lon", "lat")


@query("dedupe_vertices", sql("SELECT shape_id, count(*) AS points, (SELECT count(*) FROM d_points k WHERE k.shape_id = p.shape_id) AS kept FROM c_points p GROUP BY shape_id"))
def _(spark, d):
    points = quality.judge_points(raw(spark, d)["shapes"]).good.select("shape_id", "seq", "ord", "lon", "lat")
    kept = quality.dedupe_vertices(points).groupBy("shape_id").agg(F.count("*").alias("kept"))
    return points.groupBy("shape_id").agg(F.count("*").alias("points")).join(kept, "shape_id")


@query("short_shapes", sql("SELECT shape_id, count(*) >= 2 AS drawable FROM d_points GROUP BY shape_id"))
def _(spark, d):
    points = quality.judge_points(raw(spark, d)["shapes"]).good
    return quality.drawable_shapes(points).select("shape_id", "drawable")


@query("shape_segments", sql("SELECT shape_id, seq, x1, y1, x2, y2, round(len, 6) AS len, round(run, 6) AS run, round(total, 6) AS total, n FROM o_segments"))
def _(spark, d):
    rounded = [F.round(c, 6).alias(c) for c in ("len", "run", "total")]
    return lines.segments(tables(spark, d)["shapes"]).select("shape_id", "seq", "x1", "y1", "x2", "y2", *rounded, "n")


@query("shape_length_m", sql("SELECT shape_id, round(meters, 3) AS meters FROM o_meters"))
def _(spark, d):
    return lines.length_m(tables(spark, d)["segments"]).select("shape_id", F.round("meters", 3).alias("meters"))


@query("spheroid_distance", sql(f"SELECT a.stop_id, b.stop_id AS station_id, round({metres('a.lon', 'a.lat', 'b.lon', 'b.lat')}, 3) AS meters FROM c_stops a JOIN c_stops b ON b.stop_id = a.parent_station"))
def _(spark, d):
    stops = tables(spark, d)["stops"]
    stations = stops.select(F.col("stop_id").alias("station_id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    far = geo.spheroid_m(F.col("lon"), F.col("lat"), F.col("x"), F.col("y"))
    return stops.join(stations, F.col("parent_station") == F.col("station_id")).select(
        "stop_id", "station_id", F.round(far, 3).alias("meters")
    )


@query("line_locate", sql("SELECT shape_id, stop_id, round(fraction, 6) AS fraction FROM o_positions"))
def _(spark, d):
    t = tables(spark, d)
    pairs = positions.served_pairs(t["stop_times"], t["trips"]).join(t["stops"].select("stop_id", "lon", "lat"), "stop_id")
    return lines.locate(pairs, t["segments"]).select("shape_id", "stop_id", F.round("fraction", 6).alias("fraction"))


@query("line_interpolate", sql(f"SELECT shape_id, stop_id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM ({interpolated('SELECT shape_id, stop_id, fraction FROM o_positions', 'shape_id, stop_id')}) v"))
def _(spark, d):
    t = tables(spark, d)
    keys = ["shape_id", "stop_id"]
    return lines.interpolate(t["shape_stop_positions"], t["segments"], keys).select(
        *keys, F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat")
    )


@query("simplify_line", sql("SELECT shape_id, seq, lon, lat FROM o_kept", simplified(TOLERANCE)))
def _(spark, d):
    return lines.simplify(tables(spark, d)["shapes"], TOLERANCE).select("shape_id", "seq", "lon", "lat")


@query("geojson_geometry", sql("SELECT stop_id, to_json({'type': 'Point', 'coordinates': [round(lon, 6), round(lat, 6)]}) AS geometry FROM c_stops"))
def _(spark, d):
    return tables(spark, d)["stops"].select("stop_id", geo.as_geojson_point(F.col("lon"), F.col("lat")).alias("geometry"))


@query("parse_geojson", sql("SELECT stop_id, CASE WHEN location_type = 1 THEN round(lon, 6) END AS lon, CASE WHEN location_type = 1 THEN round(lat, 6) END AS lat FROM c_stops"))
def _(spark, d):
    # Platforms carry EWKT instead, which the parser must reject.
    text = F.when(F.col("location_type") == 1, geo.as_geojson_point(F.col("lon"), F.col("lat"))).otherwise(
        geo.ewkt_point(F.col("lon"), F.col("lat"))
    )
    return tables(spark, d)["stops"].select("stop_id", geo.parse_geojson_point(text).alias("p")).select("stop_id", "p.lon", "p.lat")


@query("line_summary", sql("SELECT shape_id, count(*) AS vertices, count(DISTINCT (lon, lat)) >= 2 AS valid FROM c_shapes GROUP BY shape_id"))
def _(spark, d):
    return lines.summary(tables(spark, d)["shapes"])


# --- joins --------------------------------------------------------------------------------


@query("join_inner4", sql("SELECT trip_id, stop_sequence, s.stop_name, r.route_short_name FROM c_stop_times st JOIN c_stops s USING (stop_id) JOIN c_trips t USING (trip_id) JOIN c_routes r ON r.route_id = t.route_id"))
def _(spark, d):
    t = tables(spark, d)
    return (
        t["stop_times"].select("trip_id", "stop_sequence", "stop_id")
        .join(t["trips"].select("trip_id", "route_id"), "trip_id")
        .join(t["stops"].select("stop_id", "stop_name"), "stop_id")
        .join(t["routes"].select("route_id", "route_short_name"), "route_id")
        .select("trip_id", "stop_sequence", "stop_name", "route_short_name")
    )


@query("join_left", sql("SELECT ordinal, l.stop_id, s.stop_name, l.route_id, r.route_short_name FROM o_log l LEFT JOIN c_stops s USING (stop_id) LEFT JOIN c_routes r ON r.route_id = l.route_id"))
def _(spark, d):
    t = tables(spark, d)
    return (
        t["vehicle_positions"].select("ordinal", "stop_id", "route_id")
        .join(t["stops"].select("stop_id", "stop_name"), "stop_id", "left")
        .join(t["routes"].select("route_id", "route_short_name"), "route_id", "left")
    )


@query("rt_trip_match", sql("""SELECT trip_id, trip_start_date, m.shape_id FROM (SELECT DISTINCT trip_id, trip_start_date FROM o_log) l
    LEFT JOIN (SELECT rt_trip_id, min(shape_id) AS shape_id FROM c_trips WHERE shape_id IS NOT NULL GROUP BY 1) m ON m.rt_trip_id = l.trip_id"""))
def _(spark, d):
    t = tables(spark, d)
    runs = t["vehicle_positions"].select(*tracking.RUN).distinct()
    return tracking.match_shapes(runs, t["trips"]).select("trip_id", _date(), "shape_id")


_PREV = "SELECT s.trip_id, s.trip_start_date, s.stop_id, p.prev_stop_id, p.prev_at FROM v_latest s LEFT JOIN v_prev p USING (trip_id, trip_start_date)"


@query("asof_prev_stop", sql(_PREV, vehicles(REPLAY_S, FRESH_MIN, True)))
def _(spark, d):
    log = tracking.as_of_log(tables(spark, d)["vehicle_positions"], REPLAY)
    latest = tracking.latest_positions(log, REPLAY, FRESH_MIN)
    return tracking.previous_stop(latest, log).select(
        "trip_id", _date(), "stop_id", "prev_stop_id", F.unix_seconds("prev_at").alias("prev_at")
    )


@query("station_rollup", sql("SELECT coalesce(s.parent_station, s.stop_id) AS station_id, count(*) AS stop_times FROM c_stop_times JOIN c_stops s USING (stop_id) GROUP BY 1"))
def _(spark, d):
    t = tables(spark, d)
    return audit.station_rollup(t["stop_times"], t["stops"])


@query("nearby_pairs", sql(f"SELECT * FROM (SELECT a.stop_id AS a_stop_id, b.stop_id AS b_stop_id, round({metres('a.lon', 'a.lat', 'b.lon', 'b.lat')}, 3) AS meters FROM c_stops a JOIN c_stops b ON a.stop_id < b.stop_id) v WHERE meters <= {RADIUS_M}"))
def _(spark, d):
    stops = tables(spark, d)["stops"].select("stop_id", "lon", "lat")
    return spatial.nearby(stops, RADIUS_M).select("a_stop_id", "b_stop_id", geo.rounded_to_mm(F.col("meters")).alias("meters"))


_MOVED = """(SELECT stop_id || '/52' AS stop_id, lon, lat + 12 AS lat FROM c_stops UNION ALL SELECT stop_id || '/65', lon, lat + 24 FROM c_stops
    UNION ALL SELECT stop_id || '/180', CASE WHEN lon + 254 > 180 THEN lon + 254 - 360 ELSE lon + 254 END, lat FROM c_stops)"""


@query("nearby_pairs_high_latitude", sql(f"SELECT * FROM (SELECT a.stop_id AS a_stop_id, b.stop_id AS b_stop_id, round({metres('a.lon', 'a.lat', 'b.lon', 'b.lat')}, 3) AS meters FROM {_MOVED} a JOIN {_MOVED} b ON a.stop_id < b.stop_id) v WHERE meters <= {RADIUS_M}"))
def _(spark, d):
    """The stops of the feed three times: near 52 and 65 degrees north, and across longitude 180."""
    stops, east = tables(spark, d)["stops"], F.col("lon") + 254
    moved = [
        ("/52", F.col("lon"), F.col("lat") + 12), ("/65", F.col("lon"), F.col("lat") + 24),
        ("/180", F.when(east > 180, east - 360).otherwise(east), F.col("lat")),
    ]
    each = [stops.select(F.concat("stop_id", F.lit(tag)).alias("stop_id"), x.alias("lon"), y.alias("lat")) for tag, x, y in moved]
    found = spatial.nearby(each[0].unionByName(each[1]).unionByName(each[2]), RADIUS_M)
    return found.select("a_stop_id", "b_stop_id", geo.rounded_to_mm(F.col("meters")).alias("meters"))


# --- aggregates and windows ---------------------------------------------------------------


@query("headway_percentiles", sql("""SELECT stop_id, route_id, round(quantile_cont(gap, 0.5), 6) AS p50, round(quantile_cont(gap, 0.9), 6) AS p90
    FROM o_gaps WHERE gap BETWEEN 60 AND 7200 GROUP BY stop_id, route_id"""))
def _(spark, d):
    t = tables(spark, d)
    gaps = headway.gaps(headway.departures(t["stop_times"], t["trips"])).where(F.col("gap_seconds").between(60, 7200))
    return (
        gaps.groupBy("stop_id", "route_id")
        .agg(F.percentile("gap_seconds", F.array(F.lit(0.5), F.lit(0.9))).alias("p"))
        .select("stop_id", "route_id", F.round(F.col("p")[0], 6).alias("p50"), F.round(F.col("p")[1], 6).alias("p90"))
    )


@query("station_routes", sql("SELECT station_id, array_to_string(routes, ',') AS routes FROM o_station_routes"))
def _(spark, d):
    return views.station_routes(tables(spark, d)).select("station_id", F.array_join("routes", ",").alias("routes"))


@query("station_route_count", sql("SELECT stop_id, stop_name, array_to_string(routes, ', ') AS routes, CAST(len(routes) AS INTEGER) AS route_count FROM o_stations"))
def _(spark, d):
    return views.station_layer(views.stations(tables(spark, d)))


@query("distinct_pairs", sql("SELECT DISTINCT shape_id, stop_id FROM c_stop_times JOIN c_trips USING (trip_id) WHERE shape_id IS NOT NULL"))
def _(spark, d):
    t = tables(spark, d)
    return positions.served_pairs(t["stop_times"], t["trips"])


@query("top1_per_group", sql("SELECT * FROM o_representative"))
def _(spark, d):
    t = tables(spark, d)
    return views.representative_shapes(t["route_shapes"], t["extents"]).select("route_id", "direction_id", "shape_id")


@query("departure_gaps", sql("SELECT service_id, stop_id, route_id, departure_sec, gap AS gap_seconds, count(*) AS n FROM o_gaps GROUP BY ALL"))
def _(spark, d):
    t = tables(spark, d)
    return headway.gap_rows(headway.departures(t["stop_times"], t["trips"]))


@query("consecutive_stops", sql("""SELECT shape_id, prev_stop, stop_id AS next_stop, round(prev_fraction, 6) AS prev_fraction, round(fraction, 6) AS next_fraction FROM (
    SELECT shape_id, stop_id, fraction, lag(stop_id) OVER w AS prev_stop, lag(fraction) OVER w AS prev_fraction FROM
    (SELECT shape_id, stop_id, round(fraction, 9) AS fraction FROM o_positions) p WINDOW w AS (PARTITION BY shape_id ORDER BY fraction, stop_id)) v WHERE prev_stop IS NOT NULL"""))
def _(spark, d):
    # Rounded first: stops that project to the same place must tie in both engines.
    spots = tables(spark, d)["shape_stop_positions"].withColumn("fraction", F.round("fraction", 9))
    return positions.consecutive(spots).select(
        "shape_id", "prev_stop", "next_stop",
        F.round("prev_fraction", 6).alias("prev_fraction"), F.round("next_fraction", 6).alias("next_fraction"),
    )


# --- realtime -----------------------------------------------------------------------------


@query("change_dedupe", sql("SELECT trip_id, trip_start_date, route_id, stop_id, current_status, observed, poll_seq, ordinal, changed FROM o_changes"))
def _(spark, d):
    return changes.changes(changes.normalize(snapshots(spark, d))).select(
        "trip_id", _date(), "route_id", "stop_id", "current_status", F.unix_seconds("observed_at").alias("observed"),
        "poll_seq", "ordinal", "changed",
    )


@query("appeared", sql("SELECT trip_id, trip_start_date, poll_seq, ordinal FROM o_changes WHERE appeared"))
def _(spark, d):
    return tables(spark, d)["changes"].where("appeared").select("trip_id", _date(), "poll_seq", "ordinal")


@query("arrivals", sql("SELECT trip_id, trip_start_date, route_id, stop_id, observed, poll_seq, ordinal FROM o_changes WHERE arrived"))
def _(spark, d):
    return changes.arrivals(tables(spark, d)["changes"]).select(
        "trip_id", _date(), "route_id", "stop_id", F.unix_seconds("arrived_at").alias("observed"), "poll_seq", "ordinal"
    )


@query("poll_metrics", sql("""SELECT poll_seq, count(*) AS vehicles, count(*) FILTER (changed) AS changed, count(*) FILTER (NOT changed) AS unchanged, count(*) FILTER (appeared) AS appeared,
    count(*) FILTER (arrived) AS arrivals, 0 AS failures, round(100 * count(*) FILTER (NOT changed) / count(*), 6) AS deduped_pct FROM o_changes GROUP BY poll_seq"""))
def _(spark, d):
    return changes.poll_metrics(tables(spark, d)["changes"]).withColumn("deduped_pct", F.round("deduped_pct", 6))


@query("snapshot_diff", sql("""SELECT poll_seq, count(*) FILTER (here AND NOT was) AS added, coalesce(sum(runs - CASE WHEN was THEN 0 ELSE 1 END) FILTER (here), 0) AS moved, count(*) FILTER (was AND NOT here) AS removed FROM (
    SELECT coalesce(a.poll_seq, b.poll_seq + 1) AS poll_seq, a.trip_id IS NOT NULL AS here, b.trip_id IS NOT NULL AS was, a.runs FROM o_sets a FULL JOIN o_sets b ON a.trip_id = b.trip_id AND a.poll_seq = b.poll_seq + 1) v
    WHERE poll_seq IN (SELECT poll_seq FROM o_obs) GROUP BY poll_seq""",
    "o_sets AS (SELECT poll_seq, trip_id, count(DISTINCT trip_start_date) AS runs FROM o_obs GROUP BY ALL)"))
def _(spark, d):
    return changes.snapshot_diff(changes.normalize(snapshots(spark, d)))


@query("freshness_filter", sql(f"SELECT trip_id, trip_start_date, poll_seq, ordinal, {AS_OF_S} - observed AS age_seconds FROM o_log WHERE observed > {AS_OF_S - FRESH_MIN * 60}"))
def _(spark, d):
    fresh = tracking.fresh(tables(spark, d)["vehicle_positions"], AS_OF, FRESH_MIN)
    age = scalars.epoch_seconds(F.lit(AS_OF)) - scalars.epoch_seconds(F.col("observed_at"))
    return fresh.select("trip_id", _date(), "poll_seq", "ordinal", age.cast("long").alias("age_seconds"))


@query("latest_positions", sql("SELECT trip_id, trip_start_date, route_id, stop_id, current_status, observed, poll_seq, ordinal FROM v_latest", vehicles(AS_OF_S, FRESH_MIN, False)))
def _(spark, d):
    return tracking.latest_positions(tables(spark, d)["vehicle_positions"], AS_OF, FRESH_MIN).select(
        "trip_id", _date(), "route_id", "stop_id", "current_status", F.unix_seconds("observed_at").alias("observed"), "poll_seq", "ordinal"
    )


# --- composite queries --------------------------------------------------------------------

_LINES = """SELECT r.shape_id, r.route_id, c.route_short_name, c.route_long_name, '#' || coalesce(c.route_color, '6B7280') AS route_color,
    '#' || coalesce(c.route_text_color, 'FFFFFF') AS route_text_color, r.direction_id, g.geometry
    FROM o_representative r JOIN c_routes c USING (route_id) LEFT JOIN (SELECT shape_id,
      to_json({'type': 'LineString', 'coordinates': list([round(lon, 6), round(lat, 6)] ORDER BY seq)}) AS geometry FROM o_kept GROUP BY shape_id) g USING (shape_id)"""


@query("route_lines", sql(_LINES, simplified(views.TOLERANCE_DEG)))
def _(spark, d):
    return views.route_lines(tables(spark, d))


@query("route_line_vertices", sql("SELECT shape_id, seq, lon, lat FROM o_kept WHERE shape_id IN (SELECT shape_id FROM o_representative)", simplified(TOLERANCE)))
def _(spark, d):
    return views.route_line_vertices(tables(spark, d), TOLERANCE).select("shape_id", "seq", "lon", "lat")


_LINE_PROPERTIES = ["shape_id", "route_id", "route_short_name", "route_long_name", "route_color", "route_text_color", "direction_id"]


@query("geojson_routes", sql(f"""SELECT route_id, direction_id, to_json({{'type': 'Feature', 'geometry': geometry, 'properties': {{{', '.join(f"'{p}': {p}" for p in _LINE_PROPERTIES)}}}}}) AS feature FROM ({_LINES}) v""", "o_kept AS (SELECT shape_id, seq, lon, lat FROM c_shapes)"))
def _(spark, d):
    features = geojson.line_features(views.route_lines(tables(spark, d), 0), _LINE_PROPERTIES)
    return features.select("route_id", "direction_id", "feature")


@query("stations", sql("SELECT stop_id, stop_name, array_to_string(routes, ',') AS routes, round(lon, 6) AS lon, round(lat, 6) AS lat FROM o_stations"))
def _(spark, d):
    at = geo.parse_geojson_point(F.col("geometry"))
    return views.stations(tables(spark, d)).select(
        "stop_id", "stop_name", F.array_join("routes", ",").alias("routes"), at["lon"].alias("lon"), at["lat"].alias("lat")
    )


@query("geojson_stations", sql("""SELECT stop_id, to_json({'type': 'Feature', 'geometry': {'type': 'Point', 'coordinates': [round(lon, 6), round(lat, 6)]},
    'properties': {'stop_id': stop_id, 'stop_name': stop_name, 'routes': routes}}) AS feature FROM o_stations"""))
def _(spark, d):
    return geojson.point_features(views.stations(tables(spark, d)), ["stop_id", "stop_name", "routes"]).select("stop_id", "feature")


_VEHICLE = "SELECT * EXCLUDE (lon, lat), round(lon, 6) AS lon, round(lat, 6) AS lat FROM o_vehicles WHERE lon IS NOT NULL AND lat IS NOT NULL"


def _vehicles(spark, d, as_of, replay):
    found = views.vehicle_positions(tables(spark, d), as_of, freshness_min=FRESH_MIN, replay=replay)
    return found.withColumn("lon", F.round("lon", 6)).withColumn("lat", F.round("lat", 6)).withColumn(
        "trip_start_date", F.col("trip_start_date").cast("string")
    )


@query("vehicle_positions", sql(_VEHICLE, vehicles(AS_OF_S, FRESH_MIN, False)))
def _(spark, d):
    return _vehicles(spark, d, AS_OF, False)


@query("vehicle_positions_replay", sql(_VEHICLE, vehicles(REPLAY_S, FRESH_MIN, True)))
def _(spark, d):
    return _vehicles(spark, d, REPLAY, True)


_VEHICLE_PROPERTIES = ["trip_id", "route_id", "route_color", "stop_id", "stop_name", "current_status", "observed_at", "position_source"]


@query("geojson_vehicles", sql(f"""SELECT trip_id, trip_start_date, to_json({{'type': 'Feature', 'geometry': {{'type': 'Point', 'coordinates': [lon, lat]}},
    'properties': {{{', '.join(f"'{p}': {p}" for p in _VEHICLE_PROPERTIES)}}}}}) AS feature FROM ({_VEHICLE}) v""", vehicles(AS_OF_S, FRESH_MIN, False)))
def _(spark, d):
    rows = _vehicles(spark, d, AS_OF, False).withColumn("geometry", geo.as_geojson_point(F.col("lon"), F.col("lat")))
    return geojson.point_features(rows, _VEHICLE_PROPERTIES).select("trip_id", "trip_start_date", "feature")


@query("shape_stop_positions", sql("SELECT shape_id, stop_id, round(fraction, 6) AS fraction FROM o_positions"))
def _(spark, d):
    t = tables(spark, d)
    spots = positions.shape_stop_positions(t["stop_times"], t["trips"], t["stops"], t["segments"])
    return spots.select("shape_id", "stop_id", F.round("fraction", 6).alias("fraction"))


@query("scheduled_headway", sql("SELECT * FROM o_headway"))
def _(spark, d):
    t = tables(spark, d)
    return headway.scheduled(t["stop_times"], t["trips"])


@query("headway_summary", sql("""SELECT count(*) AS rows, count(DISTINCT stop_id) AS stops, count(DISTINCT route_id) AS routes, min(hour_bucket) AS min_hour, max(hour_bucket) AS max_hour,
    round(avg(headway_p50_seconds)) AS avg_p50_seconds FROM o_headway"""))
def _(spark, d):
    return headway.summary(tables(spark, d)["scheduled_headway"])


@query("busiest_service", sql("""SELECT stop_id, stop_name, route_id, hour_bucket, headway_p50_seconds, scheduled_trips FROM o_headway JOIN c_stops USING (stop_id) WHERE scheduled_trips > 1
    ORDER BY headway_p50_seconds, scheduled_trips DESC, stop_id, route_id, hour_bucket LIMIT 5"""))
def _(spark, d):
    # At most 5 gaps fall into a group of the small test data, so the threshold is lower than the default.
    t = tables(spark, d)
    return headway.busiest(t["scheduled_headway"], t["stops"], more_than=1)


_COUNTED = ["routes", "stops", "shapes", "trips", "stop_times", "shape_stop_positions"]


def _counts_sql() -> str:
    """One count per table side by side, turned into rows."""
    what = {"shapes": "DISTINCT shape_id", "shape_stop_positions": "*"}
    source = lambda t: "o_positions" if t == "shape_stop_positions" else f"c_{t}"
    sides = ", ".join(f"(SELECT count({what.get(t, '*')}) AS {t} FROM {source(t)})" for t in _COUNTED)
    return sql(f"SELECT table_name, rows FROM (SELECT * FROM {sides}) UNPIVOT (rows FOR table_name IN ({', '.join(_COUNTED)}))")


@query("row_counts", _counts_sql())
def _(spark, d):
    return audit.row_counts(tables(spark, d), _COUNTED)


@query("past_midnight", sql("""SELECT printf('%02d:%02d:%02d', max(latest) // 3600, max(latest) // 60 % 60, max(latest) % 60) AS max_arrival,
    coalesce(sum(n * (hour > 23)::INT), 0)::BIGINT AS past_midnight, coalesce(sum(n * (hour > 27)::INT), 0)::BIGINT AS past_28h
    FROM (SELECT arrival_sec // 3600 AS hour, count(arrival_sec) AS n, max(arrival_sec) AS latest FROM c_stop_times GROUP BY hour) by_hour"""))
def _(spark, d):
    return audit.past_midnight(tables(spark, d)["stop_times"])


@query("station_structure", sql("""SELECT sum((child.location_type IS NOT DISTINCT FROM 1)::INT)::BIGINT AS stations, count(child.parent_station) AS platforms,
    count(child.parent_station) - count(parent.stop_id) AS orphan_parents FROM c_stops child LEFT JOIN c_stops parent ON child.parent_station = parent.stop_id"""))
def _(spark, d):
    return audit.station_structure(tables(spark, d)["stops"])


@query("platform_vs_station", sql("""SELECT coalesce(max(n) FILTER (stop_id = 'ST5'), 0) AS by_station_id_alone, coalesce(max(n) FILTER (stop_id = 'ST5P1'), 0) AS first_platform,
    coalesce(max(n) FILTER (stop_id = 'ST5P2'), 0) AS second_platform, coalesce(sum(n) FILTER (place = 'ST5'), 0)::BIGINT AS rolled_up_through_parent
    FROM (SELECT stop_id, coalesce(parent_station, stop_id) AS place, count(*) AS n FROM c_stop_times JOIN c_stops USING (stop_id) GROUP BY ALL) per_stop"""))
def _(spark, d):
    t = tables(spark, d)
    return audit.platform_vs_station(t["stop_times"], t["stops"], "ST5", ("ST5P1", "ST5P2"))


@query("longest_shape_of_route", sql("""SELECT shape_id, route_short_name AS route, (SELECT count(*) FROM c_shapes v WHERE v.shape_id = b.shape_id) AS vertices, TRUE AS valid, round(meters) AS length_meters,
    left((SELECT to_json({'type': 'LineString', 'coordinates': list([round(lon, 6), round(lat, 6)] ORDER BY seq)}) FROM c_shapes v WHERE v.shape_id = b.shape_id), 180) || ' ...' AS geojson_head
    FROM (SELECT DISTINCT shape_id, route_short_name, meters FROM c_trips JOIN c_routes USING (route_id) JOIN o_meters USING (shape_id) WHERE route_short_name = 'L1' ORDER BY round(meters, 3) DESC, shape_id LIMIT 1) b"""))
def _(spark, d):
    return audit.longest_shape_of_route(tables(spark, d), "L1")


@query("station_pair_distance", sql(f"""SELECT from_id, from_name, to_id, to_name, round(m, 1) AS meters, m <= 200 AS within_200m, m <= 1000 AS within_1km FROM (
    SELECT a.stop_id AS from_id, a.stop_name AS from_name, b.stop_id AS to_id, b.stop_name AS to_name, {metres('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS m FROM c_stops a, c_stops b WHERE a.stop_id = 'ST0' AND b.stop_id = 'ST5') v"""))
def _(spark, d):
    return audit.station_pair_distance(tables(spark, d)["stops"], "ST0", "ST5")


def _stations_sql(also: str) -> str:
    return sql(f"""SELECT * FROM (SELECT a.stop_id AS a_stop_id, b.stop_id AS b_stop_id, round({metres('a.lon', 'a.lat', 'b.lon', 'b.lat')}, 3) AS meters
    FROM c_stops a JOIN c_stops b ON a.stop_id < b.stop_id WHERE a.location_type = 1 AND b.location_type = 1 AND {also}) v WHERE meters <= {RADIUS_M}""")


@query("nearby_stations", _stations_sql("coalesce(a.parent_station, a.stop_id) <> coalesce(b.parent_station, b.stop_id)"))
def _(spark, d):
    return audit.nearby_stations(tables(spark, d)["stops"], RADIUS_M).withColumn("meters", F.round("meters", 3))


@query("nearby_stations_literal", _stations_sql("a.parent_station IS DISTINCT FROM b.parent_station"))
def _(spark, d):
    return audit.nearby_stations(tables(spark, d)["stops"], RADIUS_M, exclude_same_complex=False).withColumn(
        "meters", F.round("meters", 3)
    )


@query("position_sanity", sql("""SELECT sum(n)::BIGINT AS rows, count(*) AS shapes, len(list_distinct(flatten(list(stops)))) AS stops, sum(outside)::BIGINT AS out_of_range,
    sum(pinned)::BIGINT AS endpoint_pinned, round(sum(total) / sum(n), 4) AS avg_fraction, round(min(low), 6) AS min_fraction, round(max(high), 6) AS max_fraction
    FROM (SELECT shape_id, count(*) AS n, list(stop_id) AS stops, sum((f NOT BETWEEN 0 AND 1)::INT) AS outside, sum((f = 0 OR f = 1)::INT) AS pinned,
          sum(f) AS total, min(f) AS low, max(f) AS high
          FROM (SELECT shape_id, stop_id, round(fraction, 9) AS f FROM o_positions) r GROUP BY shape_id) per_shape"""))
def _(spark, d):
    return positions.sanity(tables(spark, d)["shape_stop_positions"].withColumn("fraction", F.round("fraction", 9)))


@query("endpoint_pinned", sql("SELECT count(*) AS pinned FROM o_positions WHERE round(fraction, 9) <= 0 OR round(fraction, 9) >= 1"))
def _(spark, d):
    return positions.endpoint_pinned(tables(spark, d)["shape_stop_positions"].withColumn("fraction", F.round("fraction", 9)))


_HALF = """SELECT shape_id, prev_stop, stop_id AS next_stop, prev_fraction + (fraction - prev_fraction)*0.5 AS fraction FROM (
    SELECT shape_id, stop_id, fraction, lag(stop_id) OVER w AS prev_stop, lag(fraction) OVER w AS prev_fraction FROM
    (SELECT shape_id, stop_id, round(fraction, 9) AS fraction FROM o_positions) p WINDOW w AS (PARTITION BY shape_id ORDER BY fraction, stop_id)) h WHERE prev_stop IS NOT NULL"""


@query("midpoints", sql(f"SELECT shape_id, prev_stop, next_stop, round(lon, 5) AS lon, round(lat, 5) AS lat FROM ({interpolated(_HALF, 'shape_id, prev_stop, next_stop')}) v"))
def _(spark, d):
    t = tables(spark, d)
    spots = t["shape_stop_positions"].withColumn("fraction", F.round("fraction", 9))
    return positions.midpoints(spots, t["segments"]).select(
        "shape_id", "prev_stop", "next_stop", F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat")
    )
