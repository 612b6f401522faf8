"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import keep


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``id``, ``component`` (smallest id reachable) of every end of ``edges`` (a, b: long).

    Alternates large-star and small-star steps: each points the neighbours of a node at their
    smallest, first those above the node, then those below. Every step is one aggregation and
    one join, written to the shared folder; it ends when a step changes nothing, after a
    number of rounds that grows with the logarithm of the longest path. Loops and repeated
    edges change nothing; an empty table gives an empty one.
    """
    current = keep(_ordered(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))), name)
    before = _digest(current)
    while True:
        current = keep(_small_star(_large_star(current)), name)
        after = _digest(current)
        if after == before:
            return current.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
                current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            )
        before = after


def _ordered(edges: DataFrame) -> DataFrame:
    """Distinct edges with u > v."""
    return (
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )


def _digest(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # No more rows than edges; the next step makes them distinct.
    return both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    below = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _ordered(below.unionByName(least.select("u", F.col("m").alias("v"))))
