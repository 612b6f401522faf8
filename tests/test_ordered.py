"""Scans over range partitions: how rows are cut never changes the result."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tramline.operators import ordered
from tramline.operators.quality import dedupe_vertices, noncontiguous
from tramline.operators.lines import segments
from tramline.plans.positions import consecutive
from tramline.streaming import changes


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows has one key; many rows share a lead value."""
    rng = random.Random(7)
    rows = []
    for i in range(900):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(60)}"
        rows.append((key, rng.randrange(40), i, rng.random()))
    return spark.createDataFrame(rows, "k string, lead int, tie long, v double").cache()


@pytest.fixture
def partitions(spark):
    """Set the number of range partitions for one test."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", n)
    spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("parts", [1, 2, 7, 40, 300])
def test_previous_and_running(skewed, partitions, parts):
    partitions(parts)
    keys, order = ["k"], ["lead", "tie"]
    cut = ordered.with_previous(ordered.ranged(skewed, keys, order), keys, ["v"])
    got = ordered.plain(ordered.with_running(cut, keys, F.col("v"), "before", "total", "n"))
    by = Window.partitionBy("k")
    at = by.orderBy(*order)
    expected = (
        skewed.withColumn("p", F.lag("v").over(at))
        .withColumn("b", F.coalesce(F.sum("v").over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("t", F.sum("v").over(by)).withColumn("c", F.count("*").over(by))
    )
    both = got.join(expected.drop("v"), ["k", "lead", "tie"])
    assert got.count() == both.count() == skewed.count()
    wrong = both.where(
        ~F.col("previous.v").eqNullSafe(F.col("p")) | (F.abs(F.col("before") - F.col("b")) > 1e-9)
        | (F.abs(F.col("total") - F.col("t")) > 1e-9) | (F.col("n") != F.col("c"))
    )
    assert wrong.count() == 0


def test_running_without_some_rows(skewed, partitions):
    """First and last rows of partitions may be left out; whole partitions too."""
    partitions(30)
    rows = ordered.ranged(skewed, ["k"], ["lead", "tie"])
    left = rows.where("_place % 7 not in (0, 3) and _part not in (4, 5, 11)")
    got = ordered.with_running(left, ["k"], F.lit(1.0), "before", "total", "n")
    at = Window.partitionBy("k").orderBy("lead", "tie")
    wrong = got.withColumn("rank", F.row_number().over(at)).withColumn("all", F.count("*").over(Window.partitionBy("k")))
    assert wrong.where("before != rank - 1 or total != all or n != all").count() == 0
    assert got.count() == left.count()


def test_null_keys_are_a_key(spark, partitions):
    partitions(5)
    rows = spark.createDataFrame([(None if i % 2 else "k", i, float(i)) for i in range(100)], "k string, at int, v double")
    got = ordered.with_running(ordered.with_previous(ordered.ranged(rows, ["k"], ["at"]), ["k"], ["at"]), ["k"], F.lit(1.0), "b", "t", "n")
    for r in got.collect():
        assert (r.previous and r.previous["at"]) == (r["at"] - 2 if r["at"] > 1 else None)
        assert (r.b, r.t, r.n) == (r["at"] // 2, 50.0, 50)


def test_partitions_are_even_whatever_the_keys(skewed, partitions):
    partitions(30)
    rows = ordered.ranged(skewed, ["k"], ["lead", "tie"])
    assert rows.groupBy("_part").count().agg(F.max("count")).first()[0] <= 3 * skewed.count() / 30
    assert rows.where("k = 'hot'").select("_part").distinct().count() >= 9
    inputs = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    previous = ordered.with_previous(rows, ["k"], ["v"])
    # All reads are of the written table, and the only joins are with a row per partition.
    assert "LogicalRDD" not in inputs(previous) and "InMemoryRelation" not in inputs(previous)
    plan = previous._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_numbered(spark, partitions):
    partitions(6)
    rows = spark.range(0, 500, 1, 7).withColumn("score", F.col("id") % 50)
    got = ordered.numbered(rows, [F.desc("score"), F.col("id")], "rank").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 501))
    assert [(r["score"], r["id"]) for r in got] == sorted(((i % 50, i) for i in range(500)), key=lambda x: (-x[0], x[1]))
    assert ordered.numbered(rows.limit(0), [F.col("id")], "rank").count() == 0


def test_dense_ordinal(spark):
    rows = spark.range(0, 1000, 1, 7).where("id % 3 <> 1").checkpoint()
    got = ordered.dense_ordinal(rows, "ord").orderBy("id").collect()
    assert [r["ord"] for r in got] == list(range(len(got)))


def test_first_per_key_ranks_before_the_shuffle(skewed):
    df = ordered.first_per_key(skewed, ["k"], [F.col("v")])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    best = {r["k"]: r["v"] for r in df.collect()}
    assert best == {r["k"]: r["m"] for r in skewed.groupBy("k").agg(F.min("v").alias("m")).collect()}


def test_operators_agree_however_cut(spark, partitions):
    rng = random.Random(3)
    points = spark.createDataFrame(
        [("long" if i % 3 else f"s{i % 7}", i // 4, i, round(rng.random(), 1), round(rng.random(), 1)) for i in range(600)],
        "shape_id string, seq int, ord long, lon double, lat double",
    ).checkpoint()
    obs = spark.createDataFrame(
        [("t" if i % 3 else f"u{i % 5}", "2024-01-01", "R", f"S{rng.randrange(2)}", "STOPPED_AT", i // 20, i) for i in range(400)],
        "trip_id string, trip_start_date string, route_id string, stop_id string, current_status string, poll_seq long, ordinal long",
    ).checkpoint()
    spots = spark.createDataFrame(
        [("l" if i % 3 else f"s{i % 5}", f"S{i}", [0.5, rng.random()][i % 2]) for i in range(300)],
        "shape_id string, stop_id string, fraction double",
    ).checkpoint()
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    near = lambda df: df.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
    found = []
    for parts in (1, 50):
        partitions(parts)
        kept = dedupe_vertices(points)
        found.append([rows(kept), rows(near(segments(kept))), rows(changes.changes(obs)), rows(consecutive(spots))])
    assert found[0] == found[1]


def test_noncontiguous(spark):
    keys = ["a", "a", "b", "a", "c", "c", "b", "a"]
    df = spark.createDataFrame(list(zip(keys, range(len(keys)))), "k string, ord long")
    assert {r["k"]: r["reentries"] for r in noncontiguous(df, "k", "ord").collect()} == {"a": 2, "b": 1}
