"""Where stops lie along the lines that serve them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.functions import geo
from tramline.operators.lines import interpolate, locate
from tramline.operators.ordered import plain, ranged, with_previous


def served_pairs(stop_times: DataFrame, trips: DataFrame) -> DataFrame:
    """Distinct ``shape_id, stop_id``: collapsed before any geometry is touched."""
    return (
        stop_times.select("trip_id", "stop_id")
        .join(trips.where("shape_id is not null").select("trip_id", "shape_id"), "trip_id")
        .select("shape_id", "stop_id")
        .distinct()
    )


def shape_stop_positions(stop_times: DataFrame, trips: DataFrame, stops: DataFrame, segs: DataFrame) -> DataFrame:
    """``shape_id, stop_id, fraction``. The pairs are few and come from the largest join: ``locate``
    writes them out before it uses them more than once."""
    return locate(served_pairs(stop_times, trips).join(stops.select("stop_id", "lon", "lat"), "stop_id"), segs)


def consecutive(positions: DataFrame) -> DataFrame:
    """``shape_id, prev_stop, next_stop, prev_fraction, next_fraction`` of neighbours on a line."""
    key = ["shape_id"]
    rows = with_previous(ranged(positions, key, ["fraction", "stop_id"]), key, ["stop_id", "fraction"])
    return plain(rows.where("previous is not null")).select(
        "shape_id", F.col("previous.stop_id").alias("prev_stop"), F.col("stop_id").alias("next_stop"),
        F.col("previous.fraction").alias("prev_fraction"), F.col("fraction").alias("next_fraction"),
    )


def midpoints(positions: DataFrame, segs: DataFrame) -> DataFrame:
    """The place half way between every two neighbouring stops of a line."""
    half = F.col("prev_fraction") + (F.col("next_fraction") - F.col("prev_fraction")) * 0.5
    pairs = consecutive(positions)
    keys = ["shape_id", "prev_stop", "next_stop"]
    places = interpolate(pairs.select(*keys, half.alias("fraction")), segs, keys)
    return places.withColumn("midpoint", geo.as_geojson_point(F.col("lon"), F.col("lat")))


def sanity(positions: DataFrame) -> DataFrame:
    """One row; ``out_of_range`` must be 0."""
    f = F.col("fraction")
    return positions.agg(
        F.count("*").alias("rows"),
        F.count_distinct("shape_id").alias("shapes"),
        F.count_distinct("stop_id").alias("stops"),
        F.count_if((f < 0) | (f > 1)).alias("out_of_range"),
        F.count_if(f.isin(0.0, 1.0)).alias("endpoint_pinned"),
        F.round(F.avg(f), 4).alias("avg_fraction"),
        F.round(F.min(f), 6).alias("min_fraction"),
        F.round(F.max(f), 6).alias("max_fraction"),
    )


def endpoint_pinned(positions: DataFrame) -> DataFrame:
    return positions.where("fraction <= 0 or fraction >= 1").agg(F.count("*").alias("pinned"))
