"""One small file that says what a folder of tables holds, replaced as a whole.

A manifest is JSON under ``root/_manifest/<number>.json``. A new one is written aside and then
renamed to the next number, which fails if that number exists: of two writers that started
from the same manifest one wins, the other gets ``Conflict``. Readers take the newest number,
so they see all of a commit or nothing of it. What a manifest names is never overwritten.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

KEPT = 20


class Conflict(RuntimeError):
    """Another writer has committed since the manifest was read."""


def file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no folder."""
    target, files = file_system(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(target)) if files.exists(target) else []


def exists(spark: SparkSession, path: str) -> bool:
    target, files = file_system(spark, path)
    return files.exists(target)


def delete(spark: SparkSession, path: str) -> bool:
    """Remove a file or folder; False when there is none."""
    target, files = file_system(spark, path)
    return files.delete(target, True)


def folder_bytes(spark: SparkSession, path: str) -> int:
    target, files = file_system(spark, path)
    return files.getContentSummary(target).getLength()


def modified(spark: SparkSession, path: str) -> float:
    """Seconds since 1970 of the last change of a file or folder."""
    target, files = file_system(spark, path)
    return files.getFileStatus(target).getModificationTime() / 1000


def _numbers(spark: SparkSession, root: str) -> list[int]:
    names = listed(spark, f"{root}/_manifest")
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _load(spark: SparkSession, root: str, number: int) -> dict:
    target, files = file_system(spark, f"{root}/_manifest/{number:012d}.json")
    stream = files.open(target)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def latest(spark: SparkSession, root: str) -> tuple[int, dict]:
    """Number and content of the newest manifest; 0 and nothing before the first."""
    numbers = _numbers(spark, root)
    return (numbers[-1], _load(spark, root, numbers[-1])) if numbers else (0, {})


def history(spark: SparkSession, root: str, n: int) -> list[dict]:
    """Contents of the newest ``n`` manifests, newest first."""
    return [_load(spark, root, number) for number in reversed(_numbers(spark, root)[-n:])]


def commit(spark: SparkSession, root: str, number: int, content: dict, kept: int = KEPT) -> int:
    """Write ``content`` as the manifest after ``number``; older ones than the newest ``kept`` go."""
    folder = f"{root}/_manifest"
    aside, files = file_system(spark, f"{folder}/.{uuid.uuid4().hex}")
    out = files.create(aside, False)
    out.write(json.dumps(content, sort_keys=True).encode())
    out.close()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    final = jvm.org.apache.hadoop.fs.Path(f"{folder}/{number + 1:012d}.json")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    # The same class by its binary name: a nested class.
    rename = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
    how = gateway.new_array(rename, 1)
    how[0] = rename.NONE
    try:
        context.rename(files.makeQualified(aside), files.makeQualified(final), how)
    except Exception as error:
        files.delete(aside, False)
        if files.exists(final):
            raise Conflict(f"manifest {number + 1} of {root} is already written") from error
        raise
    for old in _numbers(spark, root)[:-kept]:
        delete(spark, f"{folder}/{old:012d}.json")
    return number + 1
