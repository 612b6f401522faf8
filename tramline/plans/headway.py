"""Scheduled headway: how often a route is scheduled at a stop in a service-day hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.scalars import half_even_int, hour_bucket

SERVED = ["service_id", "stop_id", "route_id"]
MIN_GAP = 60  # below: a data artefact
MAX_GAP = 7200  # above: an overnight gap
MAX_HOUR = 47


def departures(stop_times: DataFrame, trips: DataFrame) -> DataFrame:
    return (
        stop_times.where("departure_sec is not null")
        .select("trip_id", "stop_id", "departure_sec")
        .join(trips.select("trip_id", "route_id", "service_id"), "trip_id")
        .drop("trip_id")
    )


def gaps(departed: DataFrame) -> DataFrame:
    """One row per distinct departure: ``departures`` at that second, ``gap_seconds`` to the one before.

    Gaps stay within a service. Departures are reduced to distinct seconds with their
    counts before the window, so a group holds at most as many rows as a service day has
    seconds, however many trips it has; the other departures of a second have gap 0.
    """
    per_second = departed.groupBy(*SERVED, "departure_sec").agg(F.count("*").alias("departures"))
    before = F.lag("departure_sec").over(Window.partitionBy(*SERVED).orderBy("departure_sec"))
    return per_second.withColumn("gap_seconds", F.col("departure_sec") - before)


def _second_gaps(departed: DataFrame) -> DataFrame:
    """``SERVED, departure_sec, gap_seconds`` of ``gaps`` without first departures and counts: the
    distinct seconds of a service day as one array, so that departures are shuffled once."""
    seconds = F.array_sort(F.collect_set("departure_sec"))
    pairs = F.zip_with(
        F.slice("_seconds", F.lit(2), F.size("_seconds")), "_seconds",
        lambda at, before: F.struct(at.alias("departure_sec"), (at - before).alias("gap_seconds")),
    )
    gathered = departed.groupBy(*SERVED).agg(seconds.alias("_seconds"))
    # The pair of the last second and nothing has no gap.
    return gathered.select(*SERVED, F.inline(pairs)).where("gap_seconds is not null")


def gap_rows(departed: DataFrame) -> DataFrame:
    """All gaps with multiplicity: ``SERVED, departure_sec, gap_seconds, n``."""
    first = F.struct(F.col("gap_seconds").alias("gap_seconds"), F.lit(1).cast("long").alias("n"))
    others = F.struct(F.lit(0).alias("gap_seconds"), (F.col("departures") - 1).alias("n"))
    return (
        gaps(departed)
        .select(*SERVED, "departure_sec", F.explode(F.array(first, others)).alias("gap"))
        .select(*SERVED, "departure_sec", "gap.*")
        .where("n > 0")
    )


def scheduled(
    stop_times: DataFrame, trips: DataFrame,
    min_gap: int = MIN_GAP, max_gap: int = MAX_GAP, max_hour: int = MAX_HOUR,
) -> DataFrame:
    """``stop_id, route_id, hour_bucket, scheduled_trips, headway_p50_seconds, headway_p90_seconds``.

    ``scheduled_trips`` counts the gaps kept. Percentiles are exact; a group keeps counts
    of at most ``max_gap`` different values.
    """
    if min_gap < 1:
        raise ValueError("min_gap must be at least 1: gap 0 joins departures of the same second")
    hour = hour_bucket(F.col("departure_sec"))
    # A gap only looks back, so later hours can go before the seconds are gathered.
    kept = _second_gaps(departures(stop_times, trips).where(hour.between(0, max_hour)))
    return (
        kept.where(F.col("gap_seconds").between(min_gap, max_gap))
        .groupBy("stop_id", "route_id", hour.alias("hour_bucket"))
        .agg(
            F.count("*").alias("scheduled_trips"),
            F.percentile("gap_seconds", F.array(F.lit(0.5), F.lit(0.9))).alias("p"),
        )
        .select(
            "stop_id", "route_id", "hour_bucket", F.col("scheduled_trips").cast("int").alias("scheduled_trips"),
            half_even_int(F.col("p")[0]).alias("headway_p50_seconds"),
            half_even_int(F.col("p")[1]).alias("headway_p90_seconds"),
        )
    )


def summary(headway: DataFrame) -> DataFrame:
    return headway.agg(
        F.count("*").alias("rows"),
        F.count_distinct("stop_id").alias("stops"),
        F.count_distinct("route_id").alias("routes"),
        F.min("hour_bucket").alias("min_hour"),
        F.max("hour_bucket").alias("max_hour"),
        F.round(F.avg("headway_p50_seconds")).alias("avg_p50_seconds"),
    )


def busiest(headway: DataFrame, stops: DataFrame, n: int = 5, more_than: int = 5) -> DataFrame:
    """The ``n`` groups with the lowest median headway among those with more than ``more_than`` gaps."""
    return (
        headway.where(F.col("scheduled_trips") > more_than)
        .join(stops.select("stop_id", "stop_name"), "stop_id")
        .orderBy("headway_p50_seconds", F.desc("scheduled_trips"), "stop_id", "route_id", "hour_bucket")
        .limit(n)
        .select("stop_id", "stop_name", "route_id", "hour_bucket", "headway_p50_seconds", "scheduled_trips")
    )
