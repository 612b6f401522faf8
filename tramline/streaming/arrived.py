"""Which arrivals are already known: a Bloom filter and the exact keys of each service day.

The filter of a day is a table of at most ``SLOTS`` 64-bit words; a key sets three bits of one
word. It tells for most new arrivals that they are new; only the others are looked up in the
day's events, which are read by address.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.operators.tables import insert_if_absent
from tramline.schemas import KEYS
from tramline.streaming import upkeep

SLOTS = 1 << 16
DAY = "trip_start_date"
WORDS = f"{DAY} date, slot long, bits long"


def _bits(events: DataFrame) -> DataFrame:
    """Add ``slot`` and ``mask`` of the key."""
    bit = lambda shift: f"shiftleft(1L, cast(shiftright(_hash, {shift}) & 63 as int))"
    return (
        events.withColumn("_hash", F.xxhash64(*KEYS["stop_events"]))
        .withColumn("slot", F.pmod("_hash", F.lit(SLOTS)))
        .withColumn("mask", F.expr(f"{bit(20)} | {bit(30)} | {bit(40)}"))
        .drop("_hash")
    )


def words(events: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """``trip_start_date, slot, bits``: the filters of the days of ``events``, with those of ``old``."""
    bits = _bits(events).select(DAY, "slot", F.col("mask").alias("bits"))
    return (bits if old is None else bits.unionByName(old)).groupBy(DAY, "slot").agg(F.bit_or("bits").alias("bits"))


def filters(spark: SparkSession, root: str, held: dict, days: list[str]) -> DataFrame:
    """The words of some days."""
    folders = [f"{root}/bloom/{DAY}={d}/part={held['bloom'][d]}" for d in days if d in held["bloom"]]
    schema = f"{WORDS}, part string"
    if not folders:
        return spark.createDataFrame([], schema).drop("part")
    return spark.read.schema(schema).option("basePath", f"{root}/bloom").parquet(*folders).drop("part")


def unseen(spark: SparkSession, root: str, held: dict, arrived: DataFrame, order: list[str], but: str) -> tuple[DataFrame, list[str]]:
    """The first arrival of every key that the events written before do not have, and the folders
    looked into. ``but`` is the part that this batch writes; a day without filter is looked up."""
    first = insert_if_absent(None, arrived, KEYS["stop_events"], order).persist()
    days = sorted(str(row[0]) for row in first.select(DAY).distinct().collect())
    held_days = [d for d in days if upkeep.addresses(held, "stop_events", [d], but)]
    unfiltered = [d for d in held_days if d not in held["bloom"]]
    seen = filters(spark, root, held, days)
    marked = _bits(first).join(seen, [DAY, "slot"], "left").withColumn(
        "_maybe", F.coalesce(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False))
        | F.col(DAY).cast("string").isin(unfiltered)
    ).drop("slot", "mask", "bits")
    doubtful = sorted(str(row[0]) for row in marked.where("_maybe").select(DAY).distinct().collect())
    folders = upkeep.addresses(held, "stop_events", doubtful, but)
    if not folders:
        return marked.drop("_maybe"), []
    known = upkeep.read(spark, root, held, "stop_events", folders).select(*KEYS["stop_events"])
    sure, doubt = marked.where("not _maybe").drop("_maybe"), marked.where("_maybe").drop("_maybe")
    return sure.unionByName(doubt.join(known, KEYS["stop_events"], "left_anti")), folders


def remember(spark: SparkSession, root: str, held: dict, fresh: DataFrame, days: list[str], part: str) -> None:
    """Write the filters of ``days`` with the keys of ``fresh`` added; ``held`` is changed."""
    if not days:
        return
    new = words(fresh, filters(spark, root, held, days))
    (
        new.withColumn("part", F.lit(part)).repartition(len(days), DAY).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(DAY, "part").parquet(f"{root}/bloom")
    )
    for day in days:
        old = held["bloom"].get(day)
        if old and old != part:
            held["trash"].append([f"bloom/{DAY}={day}/part={old}", held["batch"]])
        held["bloom"][day] = part
