"""Table maintenance as DataFrame algebra: upsert, prune, insert-if-absent, partitions."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.operators.quality import dedupe

KEEP_DAYS = 7
DAYS_AHEAD = 2


def upsert(target: DataFrame, staged: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``target`` with the staged rows inserted or, where the key exists, replacing it.

    Repeated staged keys collapse to the first by ``order``. Without non-key columns
    existing rows stay as they are.
    """
    columns = target.columns
    fresh = dedupe(staged, keys, order).select(*columns)
    if set(columns) == set(keys):
        return target.unionByName(fresh.join(target.select(*keys), keys, "left_anti").select(*columns))
    return target.join(fresh.select(*keys), keys, "left_anti").select(*columns).unionByName(fresh)


def prune(target: DataFrame, feed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``target`` whose key the feed still has."""
    return target.join(feed.select(*keys), keys, "left_semi")


def pruned(target: DataFrame, feed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``target`` that ``prune`` removes."""
    return target.join(feed.select(*keys), keys, "left_anti")


def prune_orphans(positions: DataFrame, shapes: DataFrame, stops: DataFrame) -> DataFrame:
    """Stop positions whose shape and stop both still exist."""
    return positions.join(shapes.select("shape_id"), "shape_id", "left_semi").join(
        stops.select("stop_id"), "stop_id", "left_semi"
    ).select(*positions.columns)


def insert_if_absent(target: DataFrame | None, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows of ``new`` to append: the first per key by ``order``, unless the key exists."""
    first = dedupe(new, keys, order)
    return first if target is None else first.join(target.select(*keys), keys, "left_anti")


def partition_plan(existing_days: DataFrame, today: date, days_ahead: int = DAYS_AHEAD) -> DataFrame:
    """``day``: days from yesterday to ``days_ahead`` days ahead that have no partition yet."""
    spark = existing_days.sparkSession
    bounds = (F.lit(today - timedelta(days=1)), F.lit(today + timedelta(days=days_ahead)))
    wanted = spark.range(1).select(F.explode(F.sequence(*bounds)).alias("day"))
    return wanted.join(existing_days.select("day").distinct(), "day", "left_anti")


def retention_expired(existing_days: DataFrame, today: date, keep_days: int = KEEP_DAYS) -> DataFrame:
    """``day``: partition days strictly older than ``today`` minus ``keep_days``."""
    return existing_days.select("day").distinct().where(F.col("day") < F.lit(today - timedelta(days=keep_days)))
