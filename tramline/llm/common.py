"""Small helpers of the operators: tables, written intermediates, Arrow passes, hashing."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.sources.store import materialise

# Bytes of one Arrow batch, and of what is turned into Python objects at a time.
PART_BYTES = 8 << 20
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: evaluated once, safe from lost executors."""
    return materialise(df, name)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, through Spark's file server;
    bound Arrow batches where the session does not."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(PART_BYTES))
    context = spark.sparkContext
    if getattr(context, "_tramline_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="tramline-"), "tramline_package.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(top)))
    context.addPyFile(archive)
    context._tramline_shipped = True


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_caches: dict[str, Callable[[], None]] = {}


def cache(owner: str, clear: Callable[[], None]) -> None:
    """Name what a worker remembers between tasks, and how to forget it."""
    _caches[owner] = clear


def release(owner: str | None = None) -> None:
    """Forget what other operators left in this worker: one remembers at a time."""
    for name, clear in _caches.items():
        if name != owner:
            clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


def parts(batch: pa.RecordBatch, size: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of about ``size`` bytes and one row at least."""
    rows = max(1, batch.num_rows // max(1, -(-batch.nbytes // size)))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def per_batch(df: DataFrame, function: Callable[[dict], dict | None], schema: str, remembers: str | None = None) -> DataFrame:
    """Apply ``function`` to pieces of every Arrow batch: lists by column name in, lists by column
    name out.

    Batches are bounded in rows and bytes by Spark; a task holds one batch, and Python objects
    of one piece of it, at a time. ``remembers`` names the cache that ``function`` uses.
    """
    ship(df.sparkSession)
    names = [part.strip().split(" ")[0] for part in _fields(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        release(remembers)
        for part in (part for batch in batches for part in parts(batch)):
            out = function({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
            if out and len(out[names[0]]):
                kinds = kinds or arrow_schema(schema)
                yield pa.RecordBatch.from_arrays([pa.array(out[n], kinds.field(n).type) for n in names], names)

    return df.mapInArrow(run, schema)


def _fields(schema: str) -> list[str]:
    """Split a DDL list at its outer commas."""
    parts, depth, last = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            parts.append(schema[last:i])
            last = i + 1
    return [*parts, schema[last:]]


_KINDS = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(),
    "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
    "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string()),
}


def arrow_schema(schema: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[kind]) for n, kind in (part.strip().split(" ") for part in _fields(schema))])


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that their order and high bits look random."""
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * GOLDEN
    return x ^ (x >> np.uint64(32))


def with_totals(rows: DataFrame, totals: DataFrame, keys: str | list[str], size: str) -> DataFrame:
    """``rows`` with the columns of ``totals`` (one row per key, ``size`` rows of ``rows`` each), NULL keys alike.

    Keys with more than a thousandth of all rows are fewer than a thousand: their totals are
    broadcast and their rows stay where they are, so no task gets all rows of a key. ``totals``
    must be cheap to read twice (a written table).
    """
    keys = [keys] if isinstance(keys, str) else keys
    every = totals.agg(F.sum(size)).first()[0] or 0
    often = F.col(size) * 1000 > every
    marked = [F.struct(*(F.col(k) for k in keys)).alias("_key")]
    rest = [c for c in totals.columns if c not in keys]
    hot = totals.where(often).select(*marked, F.struct(*rest).alias("_hot"))
    seldom = totals.where(~often).select(*(F.col(k).alias(f"_{k}") for k in keys), F.struct(*rest).alias("_total"))
    found = rows.withColumn("_key", F.struct(*keys)).join(F.broadcast(hot), "_key", "left").drop("_key")
    known = found.where("_hot IS NOT NULL").select(*rows.columns, "_hot.*")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    others = found.where("_hot IS NULL").drop("_hot").join(seldom, same).select(*rows.columns, "_total.*")
    return known.unionByName(others)


def odd_numbers(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random odd 64-bit multipliers."""
    with np.errstate(over="ignore"):
        return mixed(np.arange(1, n + 1, dtype=np.uint64) * GOLDEN + np.uint64(seed)) | np.uint64(1)


def crc_of_id(doc_id: str = "doc_id") -> Column:
    """CRC-32 of the id as text; NULL for a NULL id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def words_in(text: str = "text") -> Column:
    """Number of words: runs without space, tab, line break, vertical tab, form feed."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
