"""Common table expressions for the SQL side, written from the rules, not from the Spark plans."""

from __future__ import annotations

import re

from fixtures import VIEWS


def metres(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    """Lambert's distance formula as SQL text."""
    f = "(1/298.257223563::DOUBLE)"
    b1 = f"atan((1-{f})*tan(radians({lat1})))"
    b2 = f"atan((1-{f})*tan(radians({lat2})))"
    h = f"(pow(sin(({b2}-{b1})/2),2)+cos({b1})*cos({b2})*pow(sin(radians({lon2}-{lon1})/2),2))"
    s = f"(2*asin(sqrt({h})))"
    p, q = f"(({b1}+{b2})/2)", f"(({b2}-{b1})/2)"
    x = f"(({s}-sin({s}))*pow(sin({p})*cos({q}),2)/pow(cos({s}/2),2))"
    y = f"(({s}+sin({s}))*pow(cos({p})*sin({q}),2)/nullif(pow(sin({s}/2),2),0))"
    return f"CASE WHEN {lon1}={lon2} AND {lat1}={lat2} THEN 0::DOUBLE ELSE coalesce(6378137.0::DOUBLE*({s}-{f}/2*({x}+{y})),0) END"


def blank(*columns: str) -> str:
    return ", ".join(f"nullif(trim({c}), '') AS {c}" for c in columns)


def integer(c: str) -> str:
    return f"CASE WHEN regexp_full_match({c}, '[+-]?[0-9]+') THEN TRY_CAST({c} AS INTEGER) END"


def seconds(c: str) -> str:
    return (
        f"CASE WHEN regexp_full_match({c}, '[0-9]{{1,3}}:[0-5][0-9]:[0-5][0-9]') THEN "
        f"CAST(split_part({c}, ':', 1) AS INTEGER)*3600 + CAST(split_part({c}, ':', 2) AS INTEGER)*60 "
        f"+ CAST(split_part({c}, ':', 3) AS INTEGER) END"
    )


def coordinate(lon_raw: str, lat_raw: str) -> str:
    return (
        f"WHEN {lon_raw} IS NULL OR {lat_raw} IS NULL THEN 'no_position' "
        f"WHEN lon IS NULL OR lat IS NULL THEN 'position_text:' || {lat_raw} || ',' || {lon_raw} "
        f"WHEN NOT (lon BETWEEN -74.4 AND -73.6 AND lat BETWEEN 40.4 AND 41.0) "
        f"THEN 'position_outside:' || CAST(lat AS VARCHAR) || ',' || CAST(lon AS VARCHAR)"
    )


CTES: dict[str, str] = {
    **VIEWS,
    "n_routes": f"SELECT {blank('route_id', 'route_type', 'route_short_name', 'route_long_name', 'route_color', 'route_text_color')} FROM fx_routes",
    "j_routes": f"""SELECT *, CASE WHEN route_id IS NULL THEN 'required:route_id'
        WHEN ({integer('route_type')}) IS DISTINCT FROM 1
        THEN 'unwanted_route_type:' || coalesce(CAST({integer('route_type')} AS VARCHAR), 'none') END AS reason FROM n_routes""",
    "c_routes": """SELECT route_id, coalesce(route_short_name, route_id) AS route_short_name, route_long_name, route_color, route_text_color
        FROM j_routes WHERE reason IS NULL""",
    "n_stops": f"SELECT {blank('stop_id', 'stop_name', 'stop_lon', 'stop_lat', 'parent_station', 'location_type')} FROM fx_stops",
    "j_stops": f"""SELECT *, CASE WHEN stop_id IS NULL THEN 'required:stop_id' WHEN stop_name IS NULL THEN 'required:stop_name'
        {coordinate('stop_lon', 'stop_lat')} END AS reason
        FROM (SELECT *, TRY_CAST(stop_lon AS DOUBLE) AS lon, TRY_CAST(stop_lat AS DOUBLE) AS lat FROM n_stops) v""",
    "s_stops": "SELECT * FROM j_stops WHERE reason IS NULL",
    "c_stops": f"""SELECT stop_id, stop_name,
        CASE WHEN parent_station <> stop_id AND parent_station IN (SELECT stop_id FROM s_stops) THEN parent_station END AS parent_station,
        CAST(coalesce({integer('location_type')}, 0) AS SMALLINT) AS location_type, lon, lat FROM s_stops""",
    "n_points": f"SELECT {blank('shape_id', 'shape_pt_sequence', 'shape_pt_lon', 'shape_pt_lat')} FROM fx_shape_points",
    "j_points": f"""SELECT *, CASE WHEN shape_id IS NULL THEN 'required:shape_id'
        WHEN seq IS NULL THEN 'no_order:shape_pt_sequence' {coordinate('shape_pt_lon', 'shape_pt_lat')} END AS reason
        FROM (SELECT *, {integer('shape_pt_sequence')} AS seq, TRY_CAST(shape_pt_lon AS DOUBLE) AS lon, TRY_CAST(shape_pt_lat AS DOUBLE) AS lat FROM n_points) v""",
    "c_points": "SELECT shape_id, seq, lon, lat FROM j_points WHERE reason IS NULL",
    "d_points": """SELECT shape_id, seq, lon, lat FROM (SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM c_points
        WINDOW w AS (PARTITION BY shape_id ORDER BY seq)) v WHERE plon IS NULL OR plon <> lon OR plat <> lat""",
    "c_shapes": "SELECT * FROM d_points WHERE shape_id IN (SELECT shape_id FROM d_points GROUP BY shape_id HAVING count(*) >= 2)",
    "n_trips": f"SELECT {blank('trip_id', 'route_id', 'service_id', 'shape_id', 'direction_id')} FROM fx_trips",
    "j_trips": f"""SELECT *, CASE WHEN trip_id IS NULL THEN 'required:trip_id'
        WHEN route_id IS NULL OR route_id NOT IN (SELECT route_id FROM c_routes) THEN 'unknown_route'
        WHEN service_id IS NULL THEN 'required:service_id' END AS reason,
        CASE WHEN shape_id IN (SELECT shape_id FROM c_shapes) THEN shape_id END AS shape_kept,
        CAST({integer('direction_id')} AS SMALLINT) AS direction FROM n_trips""",
    "c_trips": """SELECT trip_id, route_id, service_id, shape_kept AS shape_id, direction AS direction_id,
        substring(trip_id, position('_' IN trip_id) + 1) AS rt_trip_id FROM j_trips WHERE reason IS NULL""",
    "n_stop_times": f"SELECT {blank('trip_id', 'stop_sequence', 'stop_id', 'arrival_time', 'departure_time')}, tb1, tb2, tb3 FROM fx_stop_times",
    "j_stop_times": f"""SELECT s.*, {integer('stop_sequence')} AS seq, {seconds('arrival_time')} AS arrival_sec, {seconds('departure_time')} AS departure_sec,
        CASE WHEN t.trip_id IS NULL THEN 'unknown_trip' WHEN p.stop_id IS NULL THEN 'unknown_stop'
        WHEN ({integer('stop_sequence')}) IS NULL THEN 'no_order:stop_sequence' END AS reason
        FROM n_stop_times s LEFT JOIN c_trips t ON t.trip_id = s.trip_id LEFT JOIN c_stops p ON p.stop_id = s.stop_id""",
    "g_stop_times": "SELECT trip_id, seq AS stop_sequence, stop_id, arrival_sec, departure_sec, tb1, tb2, tb3 FROM j_stop_times WHERE reason IS NULL",
    "c_stop_times": """SELECT trip_id, stop_sequence, stop_id, arrival_sec, departure_sec FROM (SELECT *, row_number() OVER
        (PARTITION BY trip_id, stop_sequence ORDER BY tb1, stop_id, tb2, tb3) AS rn FROM g_stop_times) v WHERE rn = 1""",
    "o_segments": """SELECT *, coalesce(sum(len) OVER (PARTITION BY shape_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run,
        sum(len) OVER (PARTITION BY shape_id) AS total, count(*) OVER (PARTITION BY shape_id) AS n FROM (
        SELECT shape_id, seq, x1, y1, lon AS x2, lat AS y2, sqrt((lon - x1)*(lon - x1) + (lat - y1)*(lat - y1)) AS len FROM (
        SELECT shape_id, seq, lag(lon) OVER w AS x1, lag(lat) OVER w AS y1, lon, lat FROM c_shapes WINDOW w AS (PARTITION BY shape_id ORDER BY seq)) a
        WHERE x1 IS NOT NULL) b""",
    "o_meters": f"SELECT shape_id, sum(CAST(round(({metres('x1', 'y1', 'x2', 'y2')})*1e9) AS BIGINT))/1e9 AS meters FROM o_segments GROUP BY shape_id",
    "o_positions": """SELECT shape_id, stop_id, fraction FROM (SELECT *, row_number() OVER (PARTITION BY shape_id, stop_id ORDER BY d, seq) AS rn FROM (
        SELECT shape_id, stop_id, seq, (run + t*len)/total AS fraction,
        pow(lon - (x1 + t*(x2 - x1)), 2) + pow(lat - (y1 + t*(y2 - y1)), 2) AS d FROM (
        SELECT p.shape_id, p.stop_id, s.lon, s.lat, g.*EXCLUDE (shape_id),
        least(1.0::DOUBLE, greatest(0.0::DOUBLE, ((s.lon - x1)*(x2 - x1) + (s.lat - y1)*(y2 - y1))/(len*len))) AS t
        FROM (SELECT DISTINCT shape_id, stop_id FROM c_stop_times JOIN c_trips USING (trip_id) WHERE shape_id IS NOT NULL) p
        JOIN c_stops s USING (stop_id) JOIN o_segments g ON g.shape_id = p.shape_id) a) b) c WHERE rn = 1""",
    "o_gaps": """SELECT stop_id, route_id, service_id, departure_sec, departure_sec - lag(departure_sec) OVER (PARTITION BY service_id, stop_id, route_id ORDER BY departure_sec) AS gap
        FROM c_stop_times JOIN c_trips USING (trip_id) WHERE departure_sec IS NOT NULL""",
    "o_headway": """SELECT stop_id, route_id, CAST(departure_sec // 3600 AS SMALLINT) AS hour_bucket, CAST(count(*) AS INTEGER) AS scheduled_trips,
        CAST(round(quantile_cont(gap, 0.5), 6) AS INTEGER) AS headway_p50_seconds, CAST(round(quantile_cont(gap, 0.9), 6) AS INTEGER) AS headway_p90_seconds
        FROM o_gaps WHERE gap BETWEEN 60 AND 7200 AND departure_sec // 3600 BETWEEN 0 AND 47 GROUP BY ALL""",
    "o_snapshots": """SELECT feed, CAST(poll_seq AS BIGINT) AS poll_seq, 1704067200 + (CAST(poll_seq AS BIGINT) + 1)*43200 AS poll_epoch, ordinal, trip_id, start_date,
        route_id, stop_id, status_code, CASE WHEN ordinal % 73 = 72 THEN 0 ELSE CAST(floor(epoch(feed_ts)) AS BIGINT) END AS feed_epoch FROM fx_observations""",
    "o_obs": """SELECT trip_id, CASE WHEN regexp_full_match(start_date, '[0-9]{8}') THEN strftime(strptime(start_date, '%Y%m%d'), '%Y-%m-%d')
        ELSE strftime(to_timestamp(poll_epoch) AT TIME ZONE 'UTC', '%Y-%m-%d') END AS trip_start_date,
        coalesce(nullif(route_id, ''), '?') AS route_id, nullif(stop_id, '') AS stop_id,
        CASE status_code WHEN 0 THEN 'INCOMING_AT' WHEN 1 THEN 'STOPPED_AT' WHEN 2 THEN 'IN_TRANSIT_TO' END AS current_status,
        CASE WHEN feed_epoch <> 0 THEN feed_epoch ELSE poll_epoch END AS observed, poll_seq, ordinal
        FROM o_snapshots WHERE coalesce(trip_id, '') <> ''""",
    "o_changes": """SELECT *, changed AND coalesce(current_status = 'STOPPED_AT', FALSE) AND stop_id IS NOT NULL AS arrived FROM (
        SELECT * EXCLUDE (pstop, pstatus, ppoll), NOT known AS appeared,
        NOT known OR pstop IS DISTINCT FROM stop_id OR pstatus IS DISTINCT FROM current_status AS changed FROM (
        SELECT *, coalesce(ppoll >= poll_seq - 1, FALSE) AS known FROM (
        SELECT *, lag(stop_id) OVER w AS pstop, lag(current_status) OVER w AS pstatus, lag(poll_seq) OVER w AS ppoll
        FROM o_obs WINDOW w AS (PARTITION BY trip_id, trip_start_date ORDER BY poll_seq, ordinal)) a) b) c""",
    "o_log": "SELECT * FROM o_changes WHERE changed",
    "o_events": """SELECT trip_id, trip_start_date, route_id, stop_id, observed FROM (SELECT *, row_number() OVER
        (PARTITION BY trip_id, trip_start_date, stop_id ORDER BY poll_seq, ordinal) AS rn FROM o_changes WHERE arrived) v WHERE rn = 1""",
    "o_stations": """SELECT s.stop_id, s.stop_name, s.lon, s.lat, r.routes FROM c_stops s JOIN o_station_routes r ON r.station_id = s.stop_id WHERE s.location_type = 1""",
    "o_station_routes": """SELECT coalesce(c.parent_station, c.stop_id) AS station_id, list_sort(list(DISTINCT r.route_short_name)) AS routes
        FROM c_stop_times st JOIN c_stops c USING (stop_id) JOIN c_trips t USING (trip_id) JOIN c_routes r ON r.route_id = t.route_id GROUP BY 1""",
    "o_representative": """SELECT route_id, direction_id, shape_id FROM (SELECT *, row_number() OVER (PARTITION BY route_id, direction_id ORDER BY meters DESC, shape_id) AS rn
        FROM (SELECT DISTINCT route_id, direction_id, shape_id FROM c_trips WHERE shape_id IS NOT NULL) p JOIN o_meters USING (shape_id)) v WHERE rn = 1""",
}


def simplified(tolerance: float) -> str:
    """Recursive simplification of every line of ``c_shapes``: kept ``shape_id, pos`` as CTE ``o_kept``."""
    return f"""
pos_v AS (SELECT shape_id, lon, lat, seq, row_number() OVER (PARTITION BY shape_id ORDER BY seq) AS pos FROM c_shapes),
splits AS (
  SELECT shape_id, min(pos) AS a, max(pos) AS b, CAST(NULL AS BIGINT) AS c FROM pos_v GROUP BY shape_id
  UNION ALL
  SELECT shape_id, unnest([a, c]) AS a, unnest([c, b]) AS b, CAST(NULL AS BIGINT) AS c FROM (
    SELECT shape_id, a, b, arg_min(pos, (-d, pos)) AS c, max(d) AS far FROM (
      SELECT r.shape_id, r.a, r.b, v.pos,
        pow((v.lon - va.lon) - t*(vb.lon - va.lon), 2) + pow((v.lat - va.lat) - t*(vb.lat - va.lat), 2) AS d
      FROM splits r JOIN pos_v va ON va.shape_id = r.shape_id AND va.pos = r.a JOIN pos_v vb ON vb.shape_id = r.shape_id AND vb.pos = r.b
      JOIN pos_v v ON v.shape_id = r.shape_id AND v.pos > r.a AND v.pos < r.b,
      LATERAL (SELECT coalesce(least(1.0::DOUBLE, greatest(0.0::DOUBLE, ((v.lon - va.lon)*(vb.lon - va.lon) + (v.lat - va.lat)*(vb.lat - va.lat))
        / nullif(pow(vb.lon - va.lon, 2) + pow(vb.lat - va.lat, 2), 0))), 0) AS t) l) g GROUP BY shape_id, a, b) h
  WHERE far > {tolerance * tolerance!r}::DOUBLE),
o_kept AS (SELECT DISTINCT v.shape_id, v.seq, v.lon, v.lat FROM (SELECT shape_id, unnest([a, b]) AS pos FROM splits) k JOIN pos_v v USING (shape_id, pos))"""


def interpolated(targets: str, keys: str) -> str:
    """SQL giving ``keys, lon, lat`` for a query with ``keys, shape_id, fraction``."""
    return f"""SELECT {keys}, x1 + t*(x2 - x1) AS lon, y1 + t*(y2 - y1) AS lat FROM (
      SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (fraction*total - run)/len)) AS t,
        row_number() OVER (PARTITION BY {keys} ORDER BY seq) AS rn
      FROM ({targets}) tg JOIN o_segments USING (shape_id) WHERE fraction*total <= run + len + 1e-12*total) i WHERE rn = 1"""


def vehicles(as_of: int, minutes: int, upper: bool) -> str:
    """CTEs up to ``o_vehicles`` for a moment in epoch seconds."""
    limit = f" AND observed <= {as_of}" if upper else ""
    return f"""
v_log AS (SELECT * FROM o_log WHERE TRUE{limit}),
v_latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trip_id, trip_start_date ORDER BY observed DESC, poll_seq DESC, ordinal DESC) AS rn
  FROM v_log WHERE observed > {as_of - minutes * 60}) a WHERE rn = 1),
v_shaped AS (SELECT l.*, m.shape_id FROM v_latest l LEFT JOIN (SELECT rt_trip_id, min(shape_id) AS shape_id FROM c_trips WHERE shape_id IS NOT NULL GROUP BY 1) m ON m.rt_trip_id = l.trip_id),
v_prev AS (SELECT trip_id, trip_start_date, prev_stop_id, prev_at FROM (SELECT s.trip_id, s.trip_start_date, p.stop_id AS prev_stop_id, p.observed AS prev_at,
  row_number() OVER (PARTITION BY s.trip_id, s.trip_start_date ORDER BY p.observed DESC, p.poll_seq DESC, p.ordinal DESC) AS rn
  FROM v_shaped s JOIN v_log p ON p.trip_id = s.trip_id AND p.trip_start_date = s.trip_start_date AND p.current_status = 'STOPPED_AT'
  AND p.stop_id IS DISTINCT FROM s.stop_id AND p.observed <= s.observed) a WHERE rn = 1),
v_located AS (SELECT s.*, p.prev_stop_id, p.prev_at, n.fraction AS ahead, b.fraction AS behind, m.meters FROM v_shaped s
  LEFT JOIN v_prev p USING (trip_id, trip_start_date) LEFT JOIN o_positions n ON n.shape_id = s.shape_id AND n.stop_id = s.stop_id
  LEFT JOIN o_positions b ON b.shape_id = s.shape_id AND b.stop_id = p.prev_stop_id LEFT JOIN o_meters m ON m.shape_id = s.shape_id),
v_source AS (SELECT *, CASE WHEN current_status = 'STOPPED_AT' AND ahead IS NOT NULL THEN 'shape_stop'
  WHEN ahead IS NOT NULL AND behind IS NOT NULL THEN 'interpolated' ELSE 'station_fallback' END AS position_source,
  CASE WHEN current_status = 'STOPPED_AT' AND ahead IS NOT NULL THEN ahead WHEN ahead IS NOT NULL AND behind IS NOT NULL
  THEN behind + (ahead - behind)*least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({as_of} - prev_at)/nullif(abs(ahead - behind)*meters/11, 0))) END AS fraction FROM v_located),
v_line AS ({interpolated('SELECT trip_id, trip_start_date, shape_id, fraction FROM v_source WHERE fraction IS NOT NULL', 'trip_id, trip_start_date')}),
o_vehicles AS (SELECT CASE WHEN position_source = 'station_fallback' THEN s.lon ELSE l.lon END AS lon,
  CASE WHEN position_source = 'station_fallback' THEN s.lat ELSE l.lat END AS lat, v.trip_id, v.trip_start_date, v.route_id,
  '#' || coalesce(r.route_color, '6B7280') AS route_color, v.stop_id, s.stop_name, v.current_status,
  strftime(to_timestamp(v.observed) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS observed_at, v.position_source
  FROM v_source v LEFT JOIN v_line l USING (trip_id, trip_start_date) LEFT JOIN c_stops s ON s.stop_id = v.stop_id LEFT JOIN c_routes r ON r.route_id = v.route_id)"""


def _needed(text: str, found: list[str]) -> None:
    for name in CTES:
        if name not in found and re.search(rf"\b{name}\b", text):
            _needed(CTES[name], found)
            if name not in found:
                found.append(name)


def sql(body: str, extra: str = "") -> str:
    """``body`` with the CTEs it uses in front; ``extra`` holds further CTEs after them."""
    found: list[str] = []
    _needed(extra + " " + body, found)
    parts = [f"{name} AS ({CTES[name]})" for name in found]
    if extra:
        parts.append(extra.strip())
    recursive = "RECURSIVE " if "UNION ALL" in extra else ""
    return (f"WITH {recursive}" + ",\n".join(parts) + "\n" if parts else "") + body
