"""Live positions, table maintenance and GeoJSON output on hand-made tables."""

import json
import re
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tramline.operators import tables
from tramline.operators import tracking
from tramline.operators.lines import length_m, segments
from tramline.plans import views
from tramline.sources import geojson, store
from tramline.streaming import changes

NOW = datetime(2024, 1, 2, 12)


@pytest.fixture(scope="module")
def t(spark):
    make = spark.createDataFrame
    shapes = make(
        [("S1", 0, 0, -73.95, 40.70), ("S1", 1, 0, -73.95, 40.75), ("S1", 2, 0, -73.95, 40.80), ("S2", 0, 0, -73.95, 40.70), ("S2", 1, 0, -73.95, 40.80),
         ("S3", 0, 0, -73.95, 40.70), ("S3", 1, 0, -73.95, 40.71)],
        "shape_id string, seq int, ord long, lon double, lat double",
    )
    log = [
        # Standing at a stop of the line.
        ("t1", "B", "STOPPED_AT", "11:59:00"),
        # Between A, where it halted at 11:58, and B.
        ("t2", "A", "STOPPED_AT", "11:55:00"), ("t2", "A", "STOPPED_AT", "11:58:00"), ("t2", "B", "IN_TRANSIT_TO", "11:59:30"),
        # No static trip, known stop.
        ("t9", "A", "INCOMING_AT", "11:59:00"),
        # No static trip, unknown stop: dropped.
        ("t8", "Q", "INCOMING_AT", "11:59:00"),
        # Exactly as old as the limit: dropped.
        ("t3", "A", "STOPPED_AT", "11:50:00"),
        # Back at its only halt: no other stop before it.
        ("t4", "A", "STOPPED_AT", "11:53:00"), ("t4", None, "IN_TRANSIT_TO", "11:58:00"),
    ]
    positions = make(
        [(trip, date(2024, 1, 2), "R1", stop, status, datetime.fromisoformat(f"2024-01-02T{at}"), i, 0) for i, (trip, stop, status, at) in enumerate(log)],
        "trip_id string, trip_start_date date, route_id string, stop_id string, current_status string, observed_at timestamp, poll_seq long, ordinal long",
    )
    return {
        "routes": make([("R1", "one", None, "EE352E", None), ("R2", "two", "Two", None, None)], "route_id string, route_short_name string, route_long_name string, route_color string, route_text_color string"),
        "stops": make(
            [("ST", "Station", None, 1, -73.95, 40.70), ("A", "Alpha", "ST", 0, -73.95, 40.70), ("B", "Beta", None, 0, -73.95, 40.75), ("IDLE", "Idle", None, 1, -73.9, 40.7)],
            "stop_id string, stop_name string, parent_station string, location_type smallint, lon double, lat double"),
        "shapes": shapes,
        "segments": segments(shapes),
        "trips": make(
            [("x_t1", "R1", "w", "S2", 0, "t1"), ("y_t1", "R1", "w", "S1", 0, "t1"), ("x_t2", "R1", "w", "S1", 0, "t2"), ("x_t4", "R1", "w", "S1", None, "t4"), ("x_t5", "R2", "w", "S3", 1, "t5"), ("x_t6", "R2", "w", None, 1, "t6")],
            "trip_id string, route_id string, service_id string, shape_id string, direction_id smallint, rt_trip_id string"),
        "stop_times": make([("x_t1", 1, "A"), ("x_t5", 1, "A"), ("x_t5", 2, "B"), ("y_t1", 1, "A")], "trip_id string, stop_sequence int, stop_id string"),
        "shape_stop_positions": make([("S1", "A", 0.0), ("S1", "B", 0.5), ("S2", "A", 0.0), ("S2", "B", 0.5)], "shape_id string, stop_id string, fraction double"),
        "vehicle_positions": positions,
    }


def test_vehicle_positions(t):
    got = {r["trip_id"]: r for r in views.vehicle_positions(t, NOW).collect()}
    assert set(got) == {"t1", "t2", "t9"}
    assert {k: r["position_source"] for k, r in got.items()} == {"t1": "shape_stop", "t2": "interpolated", "t9": "station_fallback"}
    assert got["t1"]["lat"] == pytest.approx(40.75) and got["t9"]["lat"] == pytest.approx(40.70)
    metres = {r["shape_id"]: r["meters"] for r in length_m(t["segments"]).collect()}["S1"]
    # 120 s since the last halt at A, at 11 m/s, out of the half line to B.
    share = 120 / (0.5 * metres / 11)
    assert got["t2"]["lat"] == pytest.approx(40.70 + 0.05 * share, abs=1e-6)
    assert got["t2"]["observed_at"] == "2024-01-02T11:59:30Z" and got["t2"]["route_color"] == "#EE352E"


def test_live_positions_without_history(spark, t, tmp_path):
    """With the table of last halts, one lazy plan reads the day partitions of fresh rows only."""
    path = str(tmp_path / "positions")
    t["vehicle_positions"].withColumn("observed_date", F.to_date("observed_at")).write.partitionBy("observed_date").parquet(path)
    log = spark.read.parquet(path)
    halts = tracking.last_halts(t["vehicle_positions"]).checkpoint()
    found = views.vehicle_positions({**t, "vehicle_positions": log, "halts": halts}, NOW)
    plan = found._jdf.queryExecution().executedPlan().toString()
    reads = [line for line in plan.splitlines() if "FileScan" in line and "observed_date" in line]
    assert len(reads) == 1 and "PartitionFilters: [isnotnull(observed_date" in reads[0]
    text = lambda df: sorted(map(str, df.collect()))
    assert text(found) == text(views.vehicle_positions(t, NOW))
    # A replay looks through the days since the runs asked for began.
    earlier = datetime(2024, 1, 2, 11, 58, 30)
    old = views.located({**t, "vehicle_positions": log}, earlier, replay=True)
    # Conditions on the day alone become partition filters; the plan's text cuts their list short.
    assert re.search(r"\(observed_date#\d+ >= 2024-01-01\)", old._jdf.queryExecution().optimizedPlan().toString())
    assert "PartitionFilters: [isnotnull(observed_date" in old._jdf.queryExecution().executedPlan().toString()
    assert text(views.vehicle_positions({**t, "vehicle_positions": log}, earlier, replay=True)) == text(views.vehicle_positions(t, earlier, replay=True))


def test_replay_ignores_later_rows(t):
    earlier = datetime(2024, 1, 2, 11, 58, 30)
    assert {r["trip_id"] for r in views.vehicle_positions(t, earlier, replay=True).collect()} == {"t2", "t3"}


def test_route_lines(t):
    got = [(r["route_id"], r["direction_id"], r["shape_id"], r["route_color"]) for r in views.route_lines(t).collect()]
    # S1 and S2 run along one meridian; the longer wins, no direction is its own group and comes last.
    assert [g[:2] for g in got] == [("R1", 0), ("R1", None), ("R2", 1)]
    assert got[1][2] == "S1" and got[2] == ("R2", 1, "S3", "#6B7280")
    line = json.loads(views.route_lines(t, 1e-3).where("direction_id is null").first()["geometry"])
    assert line == {"type": "LineString", "coordinates": [[-73.95, 40.7], [-73.95, 40.8]]}
    whole = json.loads(views.route_lines(t, 0).where("direction_id is null").first()["geometry"])
    assert len(whole["coordinates"]) == 3
    for bad in (-1, 0.02, float("nan")):
        with pytest.raises(ValueError):
            views.route_lines(t, bad)


def document_at(path):
    return json.loads("".join(p.read_text() for p in sorted(path.glob("part-*"))))


def test_stations(t, tmp_path):
    found = views.stations(t)
    assert [(r["stop_id"], r["routes"]) for r in found.collect()] == [("ST", ["one", "two"])]
    assert [tuple(r)[2:] for r in views.station_layer(found).collect()] == [("one, two", 2)]
    features = geojson.point_features(found, ["stop_id", "stop_name", "routes"])
    document = json.loads(geojson.collection(features, ["stop_id"]).first()[0])
    assert document["features"][0]["properties"] == {"stop_id": "ST", "stop_name": "Station", "routes": ["one", "two"]}
    assert json.loads(geojson.collection(features.where("false"), ["stop_id"]).first()[0]) == {"type": "FeatureCollection", "features": []}
    lines = geojson.line_features(views.route_lines(t), ["route_id", "route_long_name", "direction_id"])
    order = ["route_id", "direction_id"]
    geojson.write_collection(lines, str(tmp_path / "g"), order)
    written = document_at(tmp_path / "g")
    assert [f["properties"]["route_id"] for f in written["features"]] == ["R1", "R1", "R2"]
    # Properties without a value stay, as null.
    assert written["features"][0]["properties"]["route_long_name"] is None
    # Piecewise writing gives the same document, also with pieces of one or two vertices.
    vertices = views.route_line_vertices(t)
    for rows in (50_000, 1):
        geojson.write_lines(lines, vertices, ["route_id", "route_long_name", "direction_id"], str(tmp_path / f"p{rows}"), order, rows)
        assert document_at(tmp_path / f"p{rows}") == written
    geojson.write_lines(lines, vertices.where("false"), ["route_id"], str(tmp_path / "n"), order)
    assert [f["geometry"] for f in document_at(tmp_path / "n")["features"]] == [None] * 3


def test_snapshot_diff(spark):
    obs = spark.createDataFrame(
        [(0, "a", 1), (0, "b", 1), (1, "a", 1), (1, "c", 1), (1, "c", 2), (3, "a", 1)], "poll_seq long, trip_id string, trip_start_date int"
    )
    polls = spark.range(5).withColumnRenamed("id", "poll_seq")
    got = {tuple(r) for r in changes.snapshot_diff(obs, polls).select("poll_seq", "added", "moved", "removed").collect()}
    assert got == {(0, 2, 0, 0), (1, 1, 2, 1), (2, 0, 0, 2), (3, 1, 0, 0), (4, 0, 0, 1)}


def test_table_maintenance(spark, tmp_path):
    make = spark.createDataFrame
    target = make([("a", 1), ("b", 1)], "k string, v int")
    staged = make([("b", 3), ("b", 2), ("c", 4)], "k string, v int")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(tables.upsert(target, staged, ["k"], ["v"])) == [("a", 1), ("b", 2), ("c", 4)]
    keys = target.select("k")
    assert rows(tables.upsert(keys, staged.select("k"), ["k"], ["k"])) == [("a",), ("b",), ("c",)]
    assert rows(tables.insert_if_absent(target, staged, ["k"], ["v"])) == [("c", 4)]
    days = make([(date(2024, 1, d),) for d in (1, 5, 9)], "day date")
    assert rows(tables.partition_plan(days, date(2024, 1, 9), 2)) == [(date(2024, 1, d),) for d in (8, 10, 11)]
    assert rows(tables.retention_expired(days, date(2024, 1, 12), 7)) == [(date(2024, 1, 1),)]
    # Day partitions on a path and in the catalogue.
    path = str(tmp_path / "days")
    store.append_days(days.select(F.col("day").alias("observed_date"), F.lit(1).alias("x")), path)
    assert rows(store.existing_days(spark, path)) == rows(days)
    assert store.drop_days(spark, path, days.where("day < '2024-01-05'")) == 1
    assert rows(store.existing_days(spark, path)) == [(date(2024, 1, 5),), (date(2024, 1, 9),)]
    assert rows(store.existing_days(spark, str(tmp_path / "none"))) == []
    spark.sql("DROP TABLE IF EXISTS day_log")
    spark.sql(f"CREATE TABLE day_log (x INT, observed_date DATE) USING parquet PARTITIONED BY (observed_date) LOCATION '{tmp_path}/log'")
    spark.sql("INSERT INTO day_log SELECT 1, DATE'2024-01-01' UNION ALL SELECT 2, DATE'2024-01-05'")
    assert store.drop_table_days(spark, "day_log", days.where("day < '2024-01-05'")) == 1
    assert [r[0] for r in spark.table("day_log").select("x").collect()] == [2]
    spark.sql("DROP TABLE day_log")


def test_versions(spark, tmp_path):
    root = str(tmp_path)
    assert store.read_version(spark, root, "v") is None
    for n in (1, 2):
        store.write_version(spark.range(n), root, "v")
        assert store.read_version(spark, root, "v").count() == n


def test_discard(spark):
    kept = store.materialise(spark.range(3), "kept")
    store.materialise(spark.range(3), "short_lived")
    assert store.discard(spark, "short_lived") == 1
    assert store.discard(spark, "short_lived") == 0
    assert kept.count() == 3
