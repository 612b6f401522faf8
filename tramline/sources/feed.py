"""Timetable feed files: header-driven CSV, all text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.schemas import FEED_FILES
from tramline.sources.records import read_records


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One feed file with ``ord``, a number rising in file order.

    The header decides which columns exist; those of the schema that the file lacks come
    back as NULL. Quoted fields may hold line breaks; the file is read in blocks all the same
    (``records``), and ``ord`` follows the file. A folder of parts is read too, but which part
    comes first is then up to Spark.
    """
    # Only the header line is read here; every column is text.
    present = spark.read.option("header", True).csv(path).schema
    if not present.fields:
        return spark.createDataFrame([], T.StructType([*FEED_FILES[table], T.StructField("ord", T.LongType())]))
    options = {"quote": '"', "escape": '"', "multiLine": "true"}
    parsed = F.from_csv("record", ", ".join(f"c{i} string" for i in range(len(present.names))), options)
    # Through a generator: parsed once, not in every filter above.
    rows = read_records(spark, path).select("ord", F.explode(F.array(parsed)).alias("row"))
    fields = [
        (F.col("row")[f"c{present.names.index(name)}"] if name in present.names else F.lit(None).cast("string")).alias(name)
        for name in FEED_FILES[table].names
    ]
    return rows.select(*fields, "ord")


def read_feed(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All five tables of an extracted feed folder."""
    return {table: read_table(spark, f"{folder}/{table}.txt", table) for table in FEED_FILES}
