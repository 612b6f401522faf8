"""Exact duplicates by skew-safe combining; DataFrame functions only.

Three stages compare full contents: every input partition collapses its own equal texts
(the map side of the first aggregation), groups of one digest and salt are merged, and the
winners of all salts are merged globally. A text held by a third of all rows so reaches a
task as one row per salt. Rows then find their group by digest; digests that turn out to
hold different texts are told apart by content.

Texts are equal when identical after every run of space, tab, line break, vertical tab and
form feed became one space. A NULL text counts as empty. ``digest`` may be any function of
the normalised text; a weak one costs time, not correctness.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import keep, tasks, with_totals


def normalised(text: str = "text") -> Column:
    """The text with every run of blanks as one space; single spaces are not touched."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _marked(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("text"))
    return rows.withColumn("digest", digest(F.col("text")))


def winners(rows: DataFrame, salts: int) -> DataFrame:
    """(digest, text, keep_id, group_size): a row per distinct text of ``rows`` (doc_id, text, digest).

    The salt is the number of the input partition, so a partition's copies of a text are one
    row before anything is sent, and a salt's task merges those of a share of the partitions.
    """
    salt = F.pmod(F.spark_partition_id(), F.lit(salts))
    salted = rows.withColumn("salt", salt).groupBy("digest", "salt", "text").agg(
        F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    )
    return salted.groupBy("digest", "text").agg(
        F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )


def _members(rows: DataFrame, salts: int | None) -> DataFrame:
    """``rows`` (doc_id, text, digest and others) without text, with keep_id, group_size and a ``class`` per text."""
    salts = salts or max(2, math.isqrt(tasks(rows.sparkSession)))
    others = [c for c in rows.columns if c != "text"]
    found = keep(winners(rows, salts).select("digest", "keep_id", "group_size"), "winners")
    collided = found.groupBy("digest").count().where("count > 1").select("digest")
    clashes = not collided.isEmpty()
    single = found.join(collided, "digest", "left_anti") if clashes else found
    slim = keep(rows.select(*others), "digests")
    members = with_totals(slim, single, "digest", "group_size").withColumn("class", F.col("digest"))
    if clashes:
        # All stages once more on the rows of these digests, which are then joined by content.
        same = rows.join(collided, "digest", "left_semi")
        number = F.monotonically_increasing_id().cast("string")
        variants = keep(winners(same, salts).withColumn("class", F.concat("digest", F.lit(" "), number)), "variants")
        by_text = with_totals(same, variants, ["digest", "text"], "group_size")
        members = members.unionByName(by_text.drop("text"))
    return members


def _chosen(placed: DataFrame) -> DataFrame:
    """(place): of every class one row that holds its keep_id."""
    own = placed.where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return own.groupBy("class").agg(F.min("place").alias("place")).select("place")


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs`` (doc_id, text, ...).

    Of equal texts the row with the smallest doc_id stays; a NULL doc_id stays only where all
    are NULL. Exactly one row of a group is kept: of rows that repeat the smallest doc_id, any
    one, the others counting as dropped copies. Other columns are not read. An empty table
    gives an empty result. ``salts``: default the root of the session's shuffle partitions, so
    that both merges have equal fan-in.
    """
    rows = _marked(docs, digest).withColumn("text_sha256", sha256(F.col("text")))
    # Rows that repeat the smallest doc_id are told apart by their place in the written table.
    placed = keep(_members(rows, salts).withColumn("place", F.monotonically_increasing_id()), "groups")
    chosen = _chosen(placed).withColumn("chosen", F.lit(True))
    return placed.join(chosen, "place", "left").select(
        "doc_id", "keep_id", "group_size", F.coalesce("chosen", F.lit(False)).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with different texts: of equal ones the row with the smallest
    doc_id, all its columns as they are. Of rows that repeat that doc_id and text one stays."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    placed = keep(docs.select(row, F.monotonically_increasing_id().alias("place")), "placed")
    rows = placed.select(F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").alias("text"), "place")
    marked = rows.withColumn("text", normalised()).withColumn("digest", sha256(F.col("text")))
    return placed.join(_chosen(_members(marked, None)), "place", "left_semi").select("row.*")


SQL = r"""
SELECT doc_id,
       min(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept,
       sha256(body) AS text_sha256
FROM (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
)
WINDOW same AS (PARTITION BY body)
"""
