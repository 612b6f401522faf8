"""Operators on the log of train observations.

The log has ``trip_id, trip_start_date, route_id, stop_id, current_status, observed_at,
poll_seq, ordinal``; a run of a train is (trip_id, trip_start_date).
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.functions.scalars import rt_trip_id
from tramline.schemas import STOPPED_AT

RUN = ["trip_id", "trip_start_date"]
_HALT = "struct<observed_at:timestamp,poll_seq:bigint,ordinal:bigint,stop_id:string>"
HALTS = f"trip_id string, trip_start_date date, halt {_HALT}, other {_HALT}"


def as_of_log(log: DataFrame, as_of: datetime) -> DataFrame:
    """The log as it stood at ``as_of``, for replays."""
    log = log.where(F.col("observed_at") <= F.lit(as_of))
    if "observed_date" in log.columns:
        log = log.where(F.col("observed_date") <= F.lit(as_of.date()))
    return log


def fresh(log: DataFrame, as_of: datetime, freshness_min: float = 10) -> DataFrame:
    """Rows strictly newer than ``as_of`` minus ``freshness_min``; prunes day partitions."""
    oldest = as_of - timedelta(minutes=freshness_min)
    log = log.where(F.col("observed_at") > F.lit(oldest))
    if "observed_date" in log.columns:
        # Spark does not derive the partition bound from observed_at.
        log = log.where(F.col("observed_date") >= F.lit(oldest.date()))
    return log


def latest_positions(log: DataFrame, as_of: datetime, freshness_min: float = 10) -> DataFrame:
    """The newest fresh row of every run. An aggregation, so a run with very many rows
    leaves each map task as one row."""
    rows = fresh(log, as_of, freshness_min)
    moment = F.struct("observed_at", "poll_seq", "ordinal")
    value = F.struct("route_id", "stop_id", "current_status", "observed_at", "poll_seq", "ordinal")
    return rows.groupBy(*RUN).agg(F.max_by(value, moment).alias("row")).select(*RUN, "row.*")


def match_shapes(runs: DataFrame, trips: DataFrame) -> DataFrame:
    """Add ``shape_id``: the smallest shape of the timetable trips whose realtime id is the run's.

    The timetable side is reduced to one row per realtime id first, so a left equi-join suffices.
    """
    ids = trips if "rt_trip_id" in trips.columns else trips.withColumn("rt_trip_id", rt_trip_id(F.col("trip_id")))
    shapes = (
        ids.where("shape_id is not null")
        .groupBy(F.col("rt_trip_id").alias("trip_id"))
        .agg(F.min("shape_id").alias("shape_id"))
    )
    return runs.join(shapes, "trip_id", "left")


def previous_stop(latest: DataFrame, log: DataFrame, max_lookback_days: int | None = None) -> DataFrame:
    """Add ``prev_stop_id, prev_at``: the last stop a run halted at other than its present one.

    A backward as-of join whose inequality depends on the probe row. ``latest`` must hold
    each run's newest row of ``log``, so only halts up to it exist. The log is cut to the
    runs asked for and reduced to the last halt per (run, stop), so that the as-of step
    sees stops, not observations. By default the whole history counts;
    ``max_lookback_days`` bounds it, and the day partitions read, where that is enough.
    """
    moment = F.struct("observed_at", "poll_seq", "ordinal")
    if max_lookback_days is not None:
        oldest = latest.agg(F.date_sub(F.to_date(F.min("observed_at")), max_lookback_days)).first()[0]
        log = log.where(F.col("observed_date" if "observed_date" in log.columns else "observed_at") >= F.lit(oldest))
    halts = (
        log.where(F.col("current_status") == STOPPED_AT)
        .join(latest.select(*RUN), RUN, "left_semi")
        .groupBy(*RUN, "stop_id")
        .agg(F.max(moment).alias("_at"))
        .withColumnRenamed("stop_id", "_stop")
    )
    found = (
        latest.select(*RUN, "stop_id", "observed_at")
        .join(halts, RUN)
        .where(~F.col("_stop").eqNullSafe(F.col("stop_id")) & (F.col("_at.observed_at") <= F.col("observed_at")))
        .groupBy(*RUN)
        .agg(F.max_by(F.struct("_stop", "_at"), F.col("_at")).alias("_found"))
        .select(*RUN, F.col("_found._stop").alias("prev_stop_id"), F.col("_found._at.observed_at").alias("prev_at"))
    )
    return latest.join(found, RUN, "left")


def last_halts(log: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """``trip_id, trip_start_date, halt, other``: each run's newest halt, and its newest at a
    different stop, as structs with ``stop_id``; those two suffice for the stop before any stop.

    ``before`` are the same of an older part of the log: the two combine like sums, so the
    table is kept up to date from new rows alone.
    """
    at = F.struct("observed_at", "poll_seq", "ordinal", "stop_id")
    halts = log.where(F.col("current_status") == STOPPED_AT).select(*RUN, at.alias("at"))
    if before is not None:
        kept = before.select(*RUN, F.explode(F.array("halt", "other")).alias("at")).where("at is not null")
        halts = halts.unionByName(kept)
    # The newest per stop first: a run stops at few places, however often it is seen there.
    per_stop = halts.groupBy(*RUN, F.col("at.stop_id").alias("stop_id")).agg(F.max("at").alias("at"))
    newest_two = F.slice(F.sort_array(F.collect_list("at"), asc=False), 1, 2)
    return (
        per_stop.groupBy(*RUN).agg(newest_two.alias("_two"))
        .select(*RUN, F.get("_two", F.lit(0)).alias("halt"), F.get("_two", F.lit(1)).alias("other"))
    )


def previous_of(latest: DataFrame, halts: DataFrame) -> DataFrame:
    """The same as ``previous_stop`` from the table of ``last_halts``, without the log."""
    found = latest.join(halts, RUN, "left")
    elsewhere = ~F.col("halt.stop_id").eqNullSafe(F.col("stop_id"))
    before = F.when(F.col("halt").isNull(), None).when(elsewhere, F.col("halt")).otherwise(F.col("other"))
    return found.withColumn("_before", before).select(
        *latest.columns, F.col("_before.stop_id").alias("prev_stop_id"), F.col("_before.observed_at").alias("prev_at")
    )
