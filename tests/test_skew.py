"""One key holds a third of all rows: no task may get a third of the work."""

from pyspark.sql import functions as F

from tramline.operators import ordered
from tramline.operators.tracking import latest_positions, previous_stop
from tramline.plans import headway
from tramline.streaming import changes

ROWS = 600_000


def observations(spark):
    i = F.col("id")
    hot = i % 3 == 0
    return spark.range(0, ROWS, 1, 8).select(
        F.when(hot, "hot").otherwise(F.concat(F.lit("t"), i % 5000)).alias("trip_id"),
        F.lit("2024-01-01").cast("date").alias("trip_start_date"),
        F.lit("R").alias("route_id"),
        F.concat(F.lit("S"), F.floor(i / 1000) % 40).alias("stop_id"),
        F.when(i % 7 < 3, "STOPPED_AT").otherwise("IN_TRANSIT_TO").alias("current_status"),
        F.timestamp_seconds(F.lit(1704067200) + F.floor(i / 30)).alias("observed_at"),
        F.floor(i / 5000).alias("poll_seq"),
        i.alias("ordinal"),
    )


def test_change_detection_spreads_a_hot_train(spark):
    obs = observations(spark)
    spark.conf.set("spark.sql.shuffle.partitions", 24)
    try:
        sizes = ordered.ranged(obs, ["trip_id", "trip_start_date"], ["poll_seq", "ordinal"]).groupBy("_part").count()
        # The hot train's 200,000 rows lie in a third of the partitions, none of which is much larger than its share.
        assert sizes.agg(F.max("count")).first()[0] <= 2 * ROWS / 24
        flags = lambda df: tuple(df.agg(*(F.count_if(c) for c in ("changed", "appeared", "arrived"))).first())
        many = flags(changes.changes(obs))
        spark.conf.set("spark.sql.shuffle.partitions", 1)
        assert many == flags(changes.changes(obs))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_partitions_are_even_where_rows_crowd(spark):
    i = F.col("id")
    # 90 % of a key at one value, and a key whose values crowd at the start of their range.
    rows = spark.range(0, 100_000, 1, 8).select(
        F.when(i % 2 == 0, "one").otherwise("crowd").alias("k"),
        F.when(i % 2 == 1, F.pow(i / 100_000.0, 6) * 1e6).when(i % 20 < 18, 500.0).otherwise(i / 100.0).alias("lead"),
        i.alias("tie"),
    )
    sizes = ordered.ranged(rows, ["k"], ["lead", "tie"]).groupBy("_part").count()
    assert sizes.agg(F.max("count")).first()[0] <= 2 * 100_000 / 8
    assert sizes.agg(F.sum("count")).first()[0] == 100_000


def test_previous_stop_joins_stops_not_observations(spark):
    from datetime import datetime

    log = observations(spark)
    latest = latest_positions(log, datetime(2024, 1, 1, 12), 24 * 60)
    found = previous_stop(latest, log).where("trip_id = 'hot'").first()
    best = (
        log.where("trip_id = 'hot' and current_status = 'STOPPED_AT'").where(F.col("stop_id") != found["stop_id"])
        .agg(F.max_by("stop_id", F.struct("observed_at", "poll_seq", "ordinal"))).first()[0]
    )
    assert found["prev_stop_id"] == best


def test_headway_group_is_bounded_by_the_day(spark):
    i = F.col("id")
    rows = spark.range(0, ROWS, 1, 8).select(
        F.concat(F.lit("t"), i).alias("trip_id"),
        F.when(i % 3 == 0, "hot").otherwise(F.concat(F.lit("S"), i % 900)).alias("stop_id"),
        ((i * 7919) % 90_000).cast("int").alias("departure_sec"),
    )
    trips = rows.select("trip_id", F.lit("R").alias("route_id"), F.lit("w").alias("service_id"))
    gaps = headway.gaps(headway.departures(rows, trips))
    assert gaps.where("stop_id = 'hot'").count() <= 48 * 3600
    assert gaps.agg(F.sum("departures")).first()[0] == ROWS


def test_headway_shuffles_departures_once(spark):
    """One exchange takes departures to their group, with the seconds of each input partition combined
    before it, and the figures are those of gaps between distinct departures."""
    i = F.col("id")
    rows = spark.range(0, 3_000, 1, 4).select(
        F.concat(F.lit("t"), i % 700).alias("trip_id"), F.concat(F.lit("S"), i % 5).alias("stop_id"),
        ((i * 7919) % 9_000 + 3600).cast("int").alias("departure_sec"),
    )
    trips = rows.select("trip_id", F.concat(F.lit("R"), F.substring("trip_id", 2, 1)).alias("route_id"), F.concat(F.lit("w"), F.length("trip_id")).alias("service_id")).distinct()
    found = headway.scheduled(rows, trips)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(service_id") == 1 and "Window" not in plan
    kept = headway.gaps(headway.departures(rows, trips)).where(F.col("gap_seconds").between(60, 7200))
    counts = kept.groupBy("stop_id", "route_id", F.floor(F.col("departure_sec") / 3600).cast("smallint").alias("hour_bucket")).count()
    key = ["stop_id", "route_id", "hour_bucket"]
    assert sorted(map(tuple, found.select(*key, "scheduled_trips").collect())) == sorted(map(tuple, counts.collect()))
    assert found.count() > 20
