"""Geometry as plain columns: longitude/latitude in degrees, WGS84.

*Planar* functions work in degrees, *metre* functions on the spheroid; the
function name says which, so no cast between the two exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# WGS84 ellipsoid.
EQUATOR_RADIUS_M = 6378137.0
FLATTENING = 1 / 298.257223563
SRID = 4326

POINT = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("coordinates", T.ArrayType(T.DoubleType())),
])
LINE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("coordinates", T.ArrayType(T.ArrayType(T.DoubleType()))),
])


def point(lon: Column, lat: Column) -> Column:
    return F.struct(lon.alias("lon"), lat.alias("lat"))


def ewkt_point(lon: Column, lat: Column) -> Column:
    return F.concat(F.lit(f"SRID={SRID};POINT("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")"))


def ewkt_line(points: Column) -> Column:
    """EWKT of an array of point structs."""
    body = F.array_join(
        F.transform(points, lambda p: F.concat(p["lon"].cast("string"), F.lit(" "), p["lat"].cast("string"))),
        ", ",
    )
    return F.concat(F.lit(f"SRID={SRID};LINESTRING("), body, F.lit(")"))


def in_box(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    min_lon, min_lat, max_lon, max_lat = box
    return lon.between(min_lon, max_lon) & lat.between(min_lat, max_lat)


def spheroid_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance in metres by Lambert's formula for long lines (first order in flattening).

    Within 5 cm of Vincenty's solution for pairs up to some 30 km. NULL if any input is.
    """
    b1, b2 = reduced_latitude(lat1), reduced_latitude(lat2)
    half_b, mid_b = (b2 - b1) / 2, (b1 + b2) / 2
    sigma = _angle(b1, b2, F.sin(half_b), F.radians(lon2 - lon1) / 2)
    squares = F.pow(F.cos(sigma / 2), 2), F.pow(F.sin(sigma / 2), 2)
    return _metres(lon1, lat1, lon2, lat2, half_b, F.sin(half_b), mid_b, sigma, *squares)


def with_spheroid_m(
    df: DataFrame, name: str, lon1: str, lat1: str, lon2: str, lat2: str, reduced: tuple[str, str] | None = None
) -> DataFrame:
    """``spheroid_m`` of four columns as column ``name``. One expression holds each part many times,
    which makes it too long to compile well; here every part is a column of its own. ``reduced``
    names columns that hold the reduced latitudes already."""
    at = [F.col(c) for c in (lon1, lat1, lon2, lat2)]
    if reduced is None:
        df = df.withColumns({"_b1": reduced_latitude(at[1]), "_b2": reduced_latitude(at[3])})
    b1, b2 = map(F.col, reduced or ("_b1", "_b2"))
    parts = df.withColumns({"_half_b": (b2 - b1) / 2, "_mid_b": (b1 + b2) / 2}).withColumn("_sin_half_b", F.sin("_half_b"))
    parts = parts.withColumn("_sigma", _angle(b1, b2, F.col("_sin_half_b"), F.radians(at[2] - at[0]) / 2))
    parts = parts.withColumns({"_cos2": F.pow(F.cos(F.col("_sigma") / 2), 2), "_sin2": F.pow(F.sin(F.col("_sigma") / 2), 2)})
    metres = _metres(*at, *(F.col(c) for c in ("_half_b", "_sin_half_b", "_mid_b", "_sigma", "_cos2", "_sin2")))
    return parts.withColumn(name, metres).drop("_b1", "_b2", "_half_b", "_mid_b", "_sin_half_b", "_sigma", "_cos2", "_sin2")


def rounded_to_mm(metres: Column) -> Column:
    """The same number as ``round(metres, 3)``, which goes through decimal text: whole millimetres are
    exact and their thousandth is rounded once. Only what is nearly half way, or huge, is left to it."""
    mm = metres * 1000
    plain = (F.abs(mm) < 1e9) & (F.abs(mm - F.floor(mm) - 0.5) > 1e-4)
    return F.when(metres.isNull() | plain, F.floor(mm + 0.5) / 1000).otherwise(F.round(metres, 3))


def reduced_latitude(lat: Column) -> Column:
    return F.atan((1 - FLATTENING) * F.tan(F.radians(lat)))


def _angle(b1: Column, b2: Column, sin_half_b: Column, half_lon: Column) -> Column:
    haversine = F.pow(sin_half_b, 2) + F.cos(b1) * F.cos(b2) * F.pow(F.sin(half_lon), 2)
    return 2 * F.asin(F.sqrt(F.least(F.lit(1.0), haversine)))


def _metres(
    lon1: Column, lat1: Column, lon2: Column, lat2: Column, half_b: Column, sin_half_b: Column, mid_b: Column,
    sigma: Column, cos2: Column, sin2: Column,
) -> Column:
    """``cos2`` and ``sin2`` are the squares at half the angle."""
    x = (sigma - F.sin(sigma)) * F.pow(F.sin(mid_b) * F.cos(half_b), 2) / F.nullif(cos2, F.lit(0.0))
    y = (sigma + F.sin(sigma)) * F.pow(F.cos(mid_b) * sin_half_b, 2) / F.nullif(sin2, F.lit(0.0))
    metres = EQUATOR_RADIUS_M * (sigma - FLATTENING / 2 * (x + y))
    # Identical points leave no angle to divide by.
    known = lon1.isNotNull() & lat1.isNotNull() & lon2.isNotNull() & lat2.isNotNull()
    return F.when(known & (lon1 == lon2) & (lat1 == lat2), F.lit(0.0)).when(known, F.coalesce(metres, F.lit(0.0)))


def within_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius_m: float) -> Column:
    return spheroid_m(lon1, lat1, lon2, lat2) <= F.lit(float(radius_m))


def planar_length(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    return F.sqrt(dx * dx + dy * dy)


def segment_share(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Where on a segment a point projects to, within [0, 1]; 0 on a zero-length one."""
    dx, dy = x2 - x1, y2 - y1
    share = ((px - x1) * dx + (py - y1) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)), F.lit(0.0))


def as_geojson_point(lon: Column, lat: Column) -> Column:
    """GeoJSON text with six decimals."""
    value = F.struct(
        F.lit("Point").alias("type"),
        F.array(F.round(lon, 6), F.round(lat, 6)).alias("coordinates"),
    )
    return F.when(lon.isNotNull() & lat.isNotNull(), F.to_json(value))


def as_geojson_line(points: Column) -> Column:
    """GeoJSON text of an array of point structs, six decimals."""
    value = F.struct(
        F.lit("LineString").alias("type"),
        F.transform(points, lambda p: F.array(F.round(p["lon"], 6), F.round(p["lat"], 6))).alias("coordinates"),
    )
    return F.when(points.isNotNull(), F.to_json(value))


def parse_geojson_point(text: Column) -> Column:
    """Point struct of GeoJSON text; NULL for anything that is not a point."""
    value = F.from_json(text, POINT)
    pair = value["coordinates"]
    ok = (value["type"] == "Point") & (F.size(pair) >= 2) & pair[0].isNotNull() & pair[1].isNotNull()
    return F.when(ok, point(F.get(pair, F.lit(0)), F.get(pair, F.lit(1))))


def parse_geojson_line(text: Column) -> Column:
    """Array of point structs of GeoJSON text; NULL for anything that is not a line."""
    value = F.from_json(text, LINE)
    pairs = value["coordinates"]
    ok = (value["type"] == "LineString") & F.forall(
        pairs, lambda p: (F.size(p) >= 2) & F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull()
    )
    return F.when(ok, F.transform(pairs, lambda p: point(F.get(p, F.lit(0)), F.get(p, F.lit(1)))))


def line_valid(points: Column) -> Column:
    """A line needs two different vertices."""
    return F.size(F.array_distinct(points)) >= 2
