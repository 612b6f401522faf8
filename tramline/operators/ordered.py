"""Ordered operators whose cost does not hang on the largest key: scans over range partitions.

A plain window sorts each key's rows in one task, so a key with a third of all rows stalls
the job. Here rows are range-partitioned by (keys, order), which cuts long keys anywhere and
leaves no partition larger than its share, and written with their partition and place in it
(``ranged``). Windows then run within a partition; what crosses a border (the row before, the
sum so far) is carried from partition to partition in a table of one or two rows for each,
joined back by partition number. Every key is treated alike, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.sources.store import materialise

PART, PLACE = "_part", "_place"


def ranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` written in range partitions of (keys, order), with ``_part`` and ``_place``: the
    partition's number and the row's number in it. Rows equal in both come in any order."""
    return _placed(df, [F.col(c) for c in [*keys, *order]], "ranged")


def _placed(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.spark_partition_id()
    return materialise(
        df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .withColumn(PART, part)
        .withColumn(PLACE, F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)),
        name,
    )


def _last_rows(rows: DataFrame, cols: list[Column]) -> DataFrame:
    """``cols`` of the last row of every partition: as many rows as partitions."""
    last = rows.groupBy(PART).agg(F.max(PLACE).alias(PLACE))
    return rows.join(F.broadcast(last), [PART, PLACE]).select(PART, *cols)


def with_previous(rows: DataFrame, keys: list[str], cols: list[str], name: str = "previous") -> DataFrame:
    """``name``: struct of ``cols`` of the row before, NULL on a key's first row. ``rows`` come from ``ranged``."""
    value, key = F.struct(*cols), F.struct(*keys)
    after = Window.orderBy(PART)
    carried = _last_rows(rows, [key.alias("_key"), value.alias("_carried")]).select(
        F.lead(PART).over(after).alias(PART), F.lit(0).cast("long").alias(PLACE), "_key", "_carried"
    )
    here = Window.partitionBy(PART, *keys).orderBy(PLACE)
    before = F.when(F.col("_key").eqNullSafe(key), F.col("_carried"))
    return (
        rows.withColumn(name, F.lag(value).over(here))
        .join(F.broadcast(carried.where(F.col(PART).isNotNull())), [PART, PLACE], "left")
        # A struct is never NULL itself, so lag is NULL on a key's first row in the partition only.
        .withColumn(name, F.coalesce(name, before))
        .drop("_key", "_carried")
    )


def with_running(rows: DataFrame, keys: list[str], value: Column, before: str, total: str, count: str) -> DataFrame:
    """Sum of ``value`` before each row, and its total and row count per key. ``rows`` come from
    ``ranged``, some perhaps left out; they are written with what their partition knows."""
    whole = Window.partitionBy(PART, *keys)
    so_far = whole.orderBy(PLACE).rowsBetween(Window.unboundedPreceding, -1)
    inner = materialise(
        rows.withColumn("_value", value)
        .withColumn(before, F.coalesce(F.sum("_value").over(so_far), F.lit(0.0)))
        .withColumn(total, F.sum("_value").over(whole))
        .withColumn(count, F.count("*").over(whole))
        .drop("_value"),
        "running",
    )
    # Only a partition's first and last key can go on beyond it.
    ends = inner.groupBy(PART).agg(F.min(PLACE).alias("_low"), F.max(PLACE).alias("_high"))
    border = inner.join(F.broadcast(ends), PART).where(f"{PLACE} = _low or {PLACE} = _high")
    held = border.select(PART, *keys, F.col(total).alias("_sum"), F.col(count).alias("_count")).distinct()
    by_key = Window.partitionBy(*keys)
    earlier = by_key.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = held.select(
        F.struct(PART, *keys).alias("_at"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0.0)).alias("_offset"),
        F.sum("_sum").over(by_key).alias("_total"),
        F.sum("_count").over(by_key).alias("_rows"),
        F.count("*").over(by_key).alias("_parts"),
    ).where("_parts > 1").drop("_parts")
    return (
        inner.withColumn("_at", F.struct(PART, *keys))
        .join(F.broadcast(carried), "_at", "left")
        .withColumn(before, F.col(before) + F.coalesce("_offset", F.lit(0.0)))
        .withColumn(total, F.coalesce("_total", total))
        .withColumn(count, F.coalesce("_rows", count))
        .drop("_at", "_offset", "_total", "_rows")
    )


def plain(df: DataFrame) -> DataFrame:
    """Drop the columns of ``ranged``."""
    return df.drop(PART, PLACE)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number all rows 1, 2, 3 … by ``order``, without a window over all rows: places in range
    partitions, and one row per partition with the number of rows before it."""
    rows = _placed(df, order, "numbered")
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(PART).agg(F.count("*").alias("_n"))
    offsets = counts.select(PART, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return plain(
        rows.join(F.broadcast(offsets), PART).withColumn(name, F.col("_offset") + F.col(PLACE) + 1).drop("_offset")
    )


def dense_ordinal(df: DataFrame, name: str) -> DataFrame:
    """Number rows 0, 1, 2 … in their present partition order, without a global window.

    ``monotonically_increasing_id`` numbers rows inside a partition; the offsets come
    from one count per partition, a table as long as the partition count.
    """
    marked = df.withColumn("_mid", F.monotonically_increasing_id()).withColumn(
        "_pid", F.shiftright("_mid", 33)
    )
    counts = marked.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (
        marked.join(F.broadcast(offsets), "_pid")
        .withColumn(name, F.col("_offset") + within)
        .drop("_mid", "_pid", "_offset")
    )


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by ``order``.

    The rank filter is pushed below the shuffle, so each map task sends at most one
    row per key however many copies a key has.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
