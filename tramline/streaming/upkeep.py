"""What the realtime job's folder holds, and its upkeep: folding, retention, removal.

Every table is a set of *parts*, folders that are written once: one per micro-batch and day
(``b…``), and folded ones (``f…``). The manifest of the folder names the parts of every day,
so readers and batches go to them by address and never list a table. Folding writes the small
parts of a day as one part of few files and puts it in their place with the next commit; the
replaced folders stay for a while, for readers that started before.
"""

from __future__ import annotations

import json
import uuid
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.operators.tables import KEEP_DAYS, retention_expired
from tramline.operators.tracking import RUN
from tramline.sources import manifest

# Tables by their day column; None: not cut by day.
DAY = {"positions": "observed_date", "stop_events": "trip_start_date", "metrics": None, "failures": None}
CLUSTER = {"positions": [*RUN, "poll_seq", "ordinal"], "stop_events": [*RUN, "stop_id"], "metrics": ["poll_seq"], "failures": ["poll_seq"]}
RETAINED = ["positions"]
FOLD_AT = 32  # loose parts of a day before they are folded
TARGET_BYTES = 128 << 20  # of a file, and of a part that folding leaves alone
OPEN_DAYS = 1  # days before today that still get rows as a rule


def address(table: str, day: str, part: str) -> str:
    column = DAY.get(table)
    return f"{table}/{column}={day}/part={part}" if column else f"{table}/part={part}"


def addresses(held: dict, table: str, days: list[str] | None = None, but: str | None = None) -> list[str]:
    """Folders of a table, of some days where these are given, without those of one part."""
    parts = held.get("parts", {}).get(table, {})
    chosen = sorted(parts) if days is None else [d for d in days if d in parts]
    return [address(table, day, part) for day in chosen for part in parts[day] if part != but]


def read(spark: SparkSession, root: str, held: dict, table: str, folders: list[str]) -> DataFrame:
    """The rows of some folders of a table, without their part; the day column prunes."""
    schema = T.StructType.fromJson(json.loads(held["schemas"][table]))
    if not folders:
        return spark.createDataFrame([], schema).drop("part")
    reader = spark.read.schema(schema).option("basePath", f"{root}/{table}")
    return reader.parquet(*(f"{root}/{folder}" for folder in folders)).drop("part")


def write(df: DataFrame, root: str, table: str, part: str) -> list[str]:
    """Write one part of every day in ``df``, replacing what an earlier try left; returns the days."""
    day = DAY[table]
    if day is None:
        df.write.mode("overwrite").parquet(f"{root}/{address(table, '', part)}")
        return [""]
    # A batch's rows are of few days.
    days = sorted(str(row[0]) for row in df.select(day).distinct().collect())
    if days:
        (
            df.withColumn("part", F.lit(part)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy(day, "part").parquet(f"{root}/{table}")
        )
    return days


def schema_of(df: DataFrame, table: str) -> str:
    day = DAY[table]
    fields = [f for f in df.schema.fields if f.name != day] + [f for f in df.schema.fields if f.name == day]
    return json.dumps(T.StructType([*fields, T.StructField("part", T.StringType())]).jsonValue())


def expired(spark: SparkSession, held: dict, table: str, today: date, keep_days: int) -> list[str]:
    """Days of a table that retention drops."""
    days = [(date.fromisoformat(day),) for day in held["parts"].get(table, {})]
    gone = retention_expired(spark.createDataFrame(days, "day date"), today, keep_days) if days else None
    return [] if gone is None else sorted(row["day"].isoformat() for row in gone.collect())


def fold_day(spark: SparkSession, root: str, held: dict, table: str, day: str, name: str, but: str | None, target: int) -> None:
    """Write a day's small parts as one and name it in their place; ``held`` is changed."""
    parts = held["parts"][table][day]
    sizes = {p: manifest.folder_bytes(spark, f"{root}/{address(table, day, p)}") for p in parts if p != but}
    small = [p for p in parts if p != but and sizes[p] < target]
    if len(small) < 2:
        return
    files = max(1, -(-sum(sizes[p] for p in small) // target))
    rows = read(spark, root, held, table, [address(table, day, p) for p in small])
    rows = rows.drop(DAY[table]) if DAY[table] else rows
    # Runs lie together, so that a reader of few runs skips most of a day.
    order = [c for c in CLUSTER[table] if c in rows.columns]
    (rows.coalesce(1) if files == 1 else rows.repartitionByRange(files, *order)).sortWithinPartitions(*order).write.mode(
        "overwrite"
    ).parquet(f"{root}/{address(table, day, name)}")
    held["parts"][table][day] = [name, *(p for p in parts if p not in small)]
    held["trash"] += [[address(table, day, p), held["batch"]] for p in small]


def maintain(
    spark: SparkSession, root: str, held: dict, today: date, but: str | None = None, keep_days: int = KEEP_DAYS,
    fold_at: int = FOLD_AT, target: int = TARGET_BYTES,
) -> dict:
    """Retention, folding and removal on a manifest's content, which is changed and returned; the
    caller commits it. ``but`` names the running batch's part, which a repeated batch writes anew.

    A day with ``fold_at`` loose parts is folded. Closed days are folded to one part below
    ``target`` bytes, every ``fold_at`` batches. Replaced folders go ``fold_at`` batches later.
    """
    batch = held["batch"]
    for table in RETAINED:
        for day in expired(spark, held, table, today, keep_days):
            held["trash"] += [[address(table, day, part), batch] for part in held["parts"][table].pop(day)]
    closing = batch % fold_at == fold_at - 1
    for table, days in held["parts"].items():
        for day in list(days):
            loose = [p for p in days[day] if p.startswith("b") and p != but]
            closed = bool(day) and date.fromisoformat(day) < today - timedelta(days=OPEN_DAYS)
            if len(loose) >= fold_at or (closing and closed and len(days[day]) > 1):
                fold_day(spark, root, held, table, day, f"f{batch:012d}-{uuid.uuid4().hex[:8]}", but, target)
    due = [entry for entry in held["trash"] if entry[1] + fold_at <= batch]
    for path, _ in due:
        manifest.delete(spark, f"{root}/{path}")
    held["trash"] = [entry for entry in held["trash"] if entry not in due]
    return held
