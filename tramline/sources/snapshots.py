"""Landed realtime snapshots: JSON lines under ``poll_seq=<n>/feed=<name>/``.

Poll number and feed are part of the path, so they are known for unreadable records
too. An empty poll lands as an empty file, or not at all: its number is skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.schemas import SNAPSHOT

CORRUPT = "_corrupt_record"
_WITH_CORRUPT = T.StructType([*SNAPSHOT.fields, T.StructField(CORRUPT, T.StringType())])
ENVELOPE = ["feed", "poll_seq"]
_LINES = "value string, poll_seq long, feed string"


def parse(lines: DataFrame) -> DataFrame:
    """Snapshot records of JSON text in ``value``; works on batch and streaming frames.

    ``lines`` also has ``feed`` and ``poll_seq`` of the landed file. Text that does not
    parse is kept in ``_corrupt_record``.
    """
    body = F.from_json(
        "value", _WITH_CORRUPT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    )
    fields = [f"body.{name}" for name in [*SNAPSHOT.names, CORRUPT] if name not in ENVELOPE]
    return lines.withColumn("body", body).select(*ENVELOPE, *fields)


def failures(records: DataFrame) -> DataFrame:
    """``feed, poll_seq, error, n``: polls of a feed that could not be read."""
    return (
        records.where(F.col(CORRUPT).isNotNull())
        .groupBy("feed", "poll_seq")
        .agg(F.lit("unreadable record").alias("error"), F.count("*").alias("n"))
    )


def readable(records: DataFrame) -> DataFrame:
    """Records of the feeds that could be read; a poll of a feed fails as a whole."""
    bad = records.where(F.col(CORRUPT).isNotNull()).select("feed", "poll_seq").distinct()
    return records.join(bad, ["feed", "poll_seq"], "left_anti").select(*SNAPSHOT.names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON snapshots as a batch frame, unreadable records in ``_corrupt_record``."""
    return parse(spark.read.schema(_LINES).text(path))


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """The same as a stream. Polls must land in order; a poll may be split between two batches."""
    return parse(spark.readStream.schema(_LINES).option("maxFilesPerTrigger", files_per_batch).text(path))
