"""Parquet tables: versions committed together, day-partitioned append, retention, scratch."""

from __future__ import annotations

import tempfile
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from tramline.sources import manifest
from tramline.sources.manifest import delete, exists, listed, modified


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir``; a temporary one where that is
    unset and driver and executors are one process, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not one_process(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        folder = tempfile.mkdtemp(prefix="tramline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def one_process(master: str) -> bool:
    """Whether a master runs its executor in the driver, so that local folders are shared."""
    return master == "local" or master.startswith("local[")


def _scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tramline/{spark.sparkContext.applicationId}"


_open = threading.local()


@contextmanager
def scratch() -> Iterator[None]:
    """Remove what this thread materialises inside, on leaving: results must be written by then."""
    outer, _open.paths = getattr(_open, "paths", None), []
    try:
        yield
    finally:
        paths, _open.paths = _open.paths, outer
        for spark, path in paths:
            delete(spark, path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; survives lost executors."""
    spark = df.sparkSession
    path = f"{_scratch(spark)}/{name}-{uuid.uuid4().hex}"
    if getattr(_open, "paths", None) is not None:
        _open.paths.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, name: str | None = None) -> int:
    """Remove what this application materialised, all of it or under one name; returns how
    many folders. Call it once results built on them are written."""
    folder = _scratch(spark)
    chosen = [entry for entry in listed(spark, folder) if name is None or entry.rsplit("-", 1)[0] == name]
    return sum(delete(spark, f"{folder}/{entry}") for entry in chosen)


# --- versioned tables ---------------------------------------------------------------------


def stage_version(df: DataFrame, root: str, table: str) -> str:
    """Write a new version of a table beside the others; nobody reads it before it is committed."""
    version = uuid.uuid4().hex
    df.write.parquet(f"{root}/{table}/version={version}")
    return version


def commit_versions(spark: SparkSession, root: str, versions: dict[str, str], base: int) -> int:
    """Make versions of any number of tables current, all at once. ``base`` is the number of the
    manifest they were worked out from; raises ``manifest.Conflict`` if it is not the newest."""
    number, content = manifest.latest(spark, root)
    if number != base:
        raise manifest.Conflict(f"{root} went from manifest {base} to {number}")
    return manifest.commit(spark, root, base, {"tables": {**content.get("tables", {}), **versions}})


def write_version(df: DataFrame, root: str, table: str) -> str:
    """Write a new version of one table and make it current."""
    spark = df.sparkSession
    base = manifest.latest(spark, root)[0]
    version = stage_version(df, root, table)
    commit_versions(spark, root, {table: version}, base)
    return version


def read_versions(spark: SparkSession, root: str) -> tuple[int, dict[str, DataFrame]]:
    """Number of the newest manifest, and the tables it names: one state of all of them."""
    number, content = manifest.latest(spark, root)
    tables = content.get("tables", {})
    return number, {t: spark.read.parquet(f"{root}/{t}/version={v}") for t, v in tables.items()}


def read_version(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """The current version of a table, None before the first."""
    version = manifest.latest(spark, root)[1].get("tables", {}).get(table)
    return None if version is None else spark.read.parquet(f"{root}/{table}/version={version}")


def remove_versions(spark: SparkSession, root: str, keep: int = 2, older_than_hours: float = 24) -> int:
    """Remove versions that none of the newest ``keep`` manifests names, unless they are younger
    than ``older_than_hours`` (a refresh may be writing them); returns how many."""
    named = {f"{t}/version={v}" for content in manifest.history(spark, root, keep) for t, v in content.get("tables", {}).items()}
    old = time.time() - 3600 * older_than_hours
    found = [f"{t}/{v}" for t in listed(spark, root) if not t.startswith("_") for v in listed(spark, f"{root}/{t}") if v.startswith("version=")]
    gone = [path for path in found if path not in named and modified(spark, f"{root}/{path}") <= old]
    return sum(delete(spark, f"{root}/{path}") for path in gone)


# --- day partitions -----------------------------------------------------------------------


def append_days(df: DataFrame, path: str, day: str = "observed_date") -> None:
    """Append to a day-partitioned table; each day's rows go to one set of tasks."""
    df.write.mode("append").partitionBy(day).parquet(path)


def existing_days(spark: SparkSession, path: str, day: str = "observed_date") -> DataFrame:
    """``day`` of every partition folder, from the file listing alone."""
    names = listed(spark, path)
    days = [(date.fromisoformat(n.split("=", 1)[1]),) for n in names if n.startswith(day + "=") and "HIVE" not in n]
    return spark.createDataFrame(days, "day date")


def drop_days(spark: SparkSession, path: str, days: DataFrame, column: str = "observed_date") -> int:
    """Remove whole day partitions of a path-based table; a day list is short by nature."""
    rows = days.select("day").collect()
    return sum(delete(spark, f"{path}/{column}={row['day'].isoformat()}") for row in rows)


def drop_table_days(spark: SparkSession, table: str, days: DataFrame, column: str = "observed_date") -> int:
    """The same for a catalogue table."""
    rows = days.select("day").collect()
    for row in rows:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({column} = DATE'{row['day'].isoformat()}')")
    return len(rows)
