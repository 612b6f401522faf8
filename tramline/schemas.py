"""Explicit schemas. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


# Raw feed files: every field arrives as text.
FEED_FILES = {
    "routes": _strings(
        "route_id", "route_type", "route_short_name", "route_long_name",
        "route_color", "route_text_color",
    ),
    "stops": _strings(
        "stop_id", "stop_name", "stop_lon", "stop_lat", "parent_station", "location_type",
    ),
    "shapes": _strings("shape_id", "shape_pt_sequence", "shape_pt_lon", "shape_pt_lat"),
    "trips": _strings("trip_id", "route_id", "service_id", "shape_id", "direction_id"),
    "stop_times": _strings(
        "trip_id", "stop_sequence", "stop_id", "arrival_time", "departure_time",
    ),
}

# One landed realtime record: one train in one poll of one feed.
SNAPSHOT = T.StructType([
    T.StructField("feed", T.StringType()),
    T.StructField("poll_seq", T.LongType()),
    T.StructField("poll_ts", T.TimestampType()),
    T.StructField("ordinal", T.LongType()),
    T.StructField("trip_id", T.StringType()),
    T.StructField("start_date", T.StringType()),
    T.StructField("route_id", T.StringType()),
    T.StructField("stop_id", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("feed_epoch", T.LongType()),
])

# Primary keys of the loaded tables.
KEYS = {
    "routes": ["route_id"],
    "stops": ["stop_id"],
    "shapes": ["shape_id", "seq", "ord"],
    "trips": ["trip_id"],
    "stop_times": ["trip_id", "stop_sequence"],
    "shape_stop_positions": ["shape_id", "stop_id"],
    "scheduled_headway": ["stop_id", "route_id", "hour_bucket"],
    "stop_events": ["trip_id", "trip_start_date", "stop_id"],
}

# Fixed values of the data model.
ROUTE_TYPES = (1,)
BBOX = (-74.40, 40.40, -73.60, 41.00)  # min lon, min lat, max lon, max lat
STATUS_TEXT = {0: "INCOMING_AT", 1: "STOPPED_AT", 2: "IN_TRANSIT_TO"}
STOPPED_AT = "STOPPED_AT"
UNKNOWN_ROUTE = "?"
DEFAULT_ROUTE_COLOR = "6B7280"
DEFAULT_TEXT_COLOR = "FFFFFF"
