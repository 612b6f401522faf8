"""Train observations: normalisation, change detection and per-poll figures.

These functions take batch frames; ``poller`` runs the same ones on a stream.
``poll_seq`` numbers all polls without gaps, empty ones included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.functions.scalars import service_date, status_text
from tramline.operators.ordered import plain, ranged, with_previous
from tramline.operators.tracking import RUN
from tramline.schemas import STOPPED_AT, UNKNOWN_ROUTE

ORDER = ["poll_seq", "ordinal"]
OBSERVATION = [*RUN, "route_id", "stop_id", "current_status", "observed_at", *ORDER]


def normalize(snapshots: DataFrame) -> DataFrame:
    """Landed snapshot records as observations; works on batch and streaming frames.

    Records without a trip are dropped. The feed's own timestamp wins over the poll's.
    """
    absent = lambda c: F.nullif(F.col(c), F.lit(""))
    stamped = F.nullif(F.col("feed_epoch"), F.lit(0).cast("long"))
    return snapshots.where(absent("trip_id").isNotNull()).select(
        "trip_id",
        service_date(F.col("start_date"), F.col("poll_ts")).alias("trip_start_date"),
        F.coalesce(absent("route_id"), F.lit(UNKNOWN_ROUTE)).alias("route_id"),
        absent("stop_id").alias("stop_id"),
        status_text(F.col("status_code")).alias("current_status"),
        F.coalesce(F.timestamp_seconds(stamped), F.col("poll_ts")).alias("observed_at"),
        *ORDER,
    )


def changes(obs: DataFrame) -> DataFrame:
    """Add ``changed, appeared, arrived`` to every observation.

    A run's last state counts only if the run was in the poll before (or earlier in the
    same poll): a run missing from one poll is forgotten and appears anew.
    """
    rows = with_previous(ranged(obs, RUN, ORDER), RUN, ["stop_id", "current_status", "poll_seq"])
    before = F.col("previous")
    known = F.coalesce(before["poll_seq"] >= F.col("poll_seq") - 1, F.lit(False))
    same = before["stop_id"].eqNullSafe(F.col("stop_id")) & before["current_status"].eqNullSafe(F.col("current_status"))
    return plain(
        rows.withColumn("changed", ~(known & same))
        .withColumn("appeared", ~known)
        # An arrival is a change into standing at a stop, not merely standing there.
        .withColumn(
            "arrived",
            F.col("changed")
            & F.coalesce(F.col("current_status") == STOPPED_AT, F.lit(False))
            & F.col("stop_id").isNotNull(),
        )
        .drop("previous")
    )


def positions(changed: DataFrame) -> DataFrame:
    """Rows for the day-partitioned position table: state changes only."""
    return changed.where("changed").select(*OBSERVATION, F.to_date("observed_at").alias("observed_date"))


def arrivals(changed: DataFrame) -> DataFrame:
    """Rows for the stop event table, before repeated arrivals are ignored."""
    return changed.where("arrived").select(
        *RUN, "route_id", "stop_id", F.col("observed_at").alias("arrived_at"), *ORDER
    )


def poll_metrics(changed: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Figures per poll. ``failures`` has ``feed, poll_seq`` rows of feeds that could not be read."""
    per_poll = changed.groupBy("poll_seq").agg(
        F.count("*").alias("vehicles"),
        F.count_if("changed").alias("changed"),
        F.count_if(~F.col("changed")).alias("unchanged"),
        F.count_if("appeared").alias("appeared"),
        F.count_if("arrived").alias("arrivals"),
    )
    if failures is None:
        per_poll = per_poll.withColumn("failures", F.lit(0).cast("long"))
    else:
        failed = failures.groupBy("poll_seq").agg(F.count_distinct("feed").alias("failures"))
        per_poll = per_poll.join(failed, "poll_seq", "full_outer").na.fill(0)
    share = 100 * F.col("unchanged") / F.nullif(F.col("vehicles"), F.lit(0))
    return per_poll.withColumn("deduped_pct", F.coalesce(share, F.lit(0.0)))


def snapshot_diff(obs: DataFrame, polls: DataFrame | None = None) -> DataFrame:
    """``poll_seq, added, moved, removed`` against the poll before, by trip id.

    ``polls`` lists the polls to report, empty ones included; default: those with rows.
    The join is on (poll, trip), so a long poll or trip spreads over all tasks.
    """
    sets = obs.groupBy("poll_seq", "trip_id").agg(F.count_distinct("trip_start_date").alias("runs"))
    before = sets.select((F.col("poll_seq") + 1).alias("poll_seq"), "trip_id", F.lit(True).alias("was"))
    both = sets.join(before, ["poll_seq", "trip_id"], "full_outer")
    here, was = F.col("runs").isNotNull(), F.col("was").isNotNull()
    per_poll = both.groupBy("poll_seq").agg(
        F.count_if(here & ~was).alias("added"),
        # Every run of a trip already shown is moved, also the second run of a new trip.
        F.coalesce(F.sum(F.col("runs") - F.when(was, 0).otherwise(1)), F.lit(0)).alias("moved"),
        F.count_if(~here & was).alias("removed"),
    )
    polls = sets.select("poll_seq").distinct() if polls is None else polls.select("poll_seq").distinct()
    return polls.join(per_poll, "poll_seq", "left").na.fill(0)
