"""Feed files to tables: rules, repairs, refreshes, reports."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tramline.functions import scalars
from tramline.operators import ordered, quality
from tramline.plans import audit, headway, load, views
from tramline.sources import feed, manifest, store

ROUTES = """﻿route_id,route_type,route_short_name,route_color
R1,1,1,EE352E
R2,1,,
R3,2,9,FFFFFF
,1,x,
R4,1.0,4,
"""
STOPS = """stop_id,stop_name,stop_lon,stop_lat,parent_station,location_type
A1,"Alpha, north",-73.95,40.75,A,
A,Alpha,-73.95,40.75,,1
B1,Beta platform,-73.94,40.76,LOST,x
B,Beta,-73.94,40.76,B,1
C,Gamma,0,0,,1
C1,Gamma platform,-73.93,40.77,C,0
D,,-73.9,40.7,,1
E,Edge,-74.40,41.00,,1
F,Swapped,40.75,-73.95,,1
G,Text,-73.9x,40.7,,1
H,Blank, ,40.7,,1
"""
SHAPES = """shape_id,shape_pt_sequence,shape_pt_lon,shape_pt_lat
S1,3,-73.93,40.77
S1,1,-73.95,40.75
S1,2,-73.94,40.76
S1,4,-73.93,40.77
S2,1,-73.95,40.75
S2,2,-73.95,40.75
S3,one,-73.95,40.75
"""
TRIPS = """trip_id,route_id,service_id,shape_id,direction_id
X_t1,R1,W,S1,0
X_t2,R1,W,S2,
X_t3,R3,W,S1,0
X_t4,R2,,S1,0
X_t5,R2,W,,1
"""
STOP_TIMES = """trip_id,stop_sequence,stop_id,arrival_time,departure_time
X_t1,1,A1,24:47:00,24:47:30
X_t1,2,B1,28:02:00,7:1:2
X_t2,1,A1,08:00:00,08:00:00
X_t1,2,C1,09:00:00,09:00:00
X_t3,1,A1,08:00:00,08:00:00
X_t2,2,Z9,08:10:00,08:10:00
X_t2,x,A1,08:10:00,08:10:00
"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("feed")
    for name, text in (("routes", ROUTES), ("stops", STOPS), ("shapes", SHAPES), ("trips", TRIPS), ("stop_times", STOP_TIMES)):
        (path / f"{name}.txt").write_text(text, encoding="utf-8")
    return str(path)


@pytest.fixture(scope="module")
def cleaned(spark, folder):
    return load.clean(feed.read_feed(spark, folder), stage=store.materialise)


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_tables(cleaned):
    t = load.collapse(cleaned[0])
    assert rows(t["routes"], "route_id", "route_short_name", "route_color", "route_long_name") == [
        ("R1", "1", "EE352E", None), ("R2", "R2", None, None),
    ]
    assert rows(t["stops"], "stop_id", "parent_station", "location_type") == [
        ("A", None, 1), ("A1", "A", 0), ("B", None, 1), ("B1", None, 0), ("C1", None, 0), ("E", None, 1),
    ]
    assert [r[0] for r in t["shapes"].orderBy("seq").select("lon").collect()] == [-73.95, -73.94, -73.93]
    assert rows(t["trips"], "trip_id", "shape_id", "direction_id", "rt_trip_id") == [
        ("X_t1", "S1", 0, "t1"), ("X_t2", None, None, "t2"), ("X_t5", None, 1, "t5"),
    ]
    assert rows(t["stop_times"]) == [
        ("X_t1", 1, "A1", 89220, 89250), ("X_t1", 2, "B1", 100920, None), ("X_t2", 1, "A1", 28800, 28800),
    ]
    panel = audit.past_midnight(t["stop_times"]).first()
    assert tuple(panel) == ("28:02:00", 2, 1)


def test_ledger(cleaned):
    staged, logs = cleaned
    copies = quality.duplicate_log(staged["stop_times"], "stop_times", ["trip_id", "stop_sequence"])
    got = {(r["table"], r["kind"], r["reason"]): (r["n"], r["examples"]) for r in quality.ledger(*logs.values(), copies).collect()}
    assert got[("routes", "skipped", "unwanted_route_type:2")] == (1, ["R3"])
    assert got[("routes", "skipped", "unwanted_route_type:none")] == (1, ["R4"])
    assert got[("routes", "skipped", "required:route_id")] == (1, [])
    assert got[("stops", "skipped", "no_position")] == (1, ["H"])
    assert got[("stops", "skipped", "position_text:40.7,-73.9x")] == (1, ["G"])
    assert got[("stops", "skipped", "position_outside:-73.95,40.75")] == (1, ["F"])
    assert got[("stops", "repaired", "unknown_parent")] == (2, ["B1->LOST", "C1->C"])
    assert got[("stops", "repaired", "parent_of_itself")] == (1, ["B"])
    assert got[("shapes", "skipped", "line_of_one_place")] == (1, ["S2"])
    assert got[("trips", "skipped", "unknown_route")] == (1, ["X_t3 (R3)"])
    assert got[("trips", "repaired", "unknown_shape")] == (1, ["X_t2 (S2)"])
    assert got[("stop_times", "repaired", "bad_clock:departure_time")] == (1, ["X_t1 7:1:2"])
    assert got[("stop_times", "skipped", "repeated_key:trip_id,stop_sequence")] == (1, ["X_t1 #2"])
    assert sum(n for (_, kind, _), (n, _) in got.items() if kind == "skipped") == 3 + 5 + 2 + 2 + 4


def test_report(cleaned):
    got = {r["table"]: tuple(r)[1:] for r in load.report(*cleaned).collect()}
    assert got == {
        "routes": (2, 0, 3, 0), "stops": (6, 0, 5, 0), "shapes": (1, 0, 2, 0), "trips": (3, 0, 2, 0), "stop_times": (3, 1, 3, 0),
    }


@pytest.mark.parametrize("mode,keep_absent", [("upsert", False), ("replace", True)])
def test_refresh(spark, folder, tmp_path, mode, keep_absent):
    raw, root = feed.read_feed(spark, folder), str(tmp_path / "tables")
    found = load.refresh(spark, raw, root, mode)["ledger"].collect()
    assert ("stop_times", "repeated_key:trip_id,stop_sequence", 1) in {(r["table"], r["reason"], r["n"]) for r in found}
    assert [r["n"] for r in found] == sorted((r["n"] for r in found), reverse=True)
    load.build_derived(spark, root)
    first = load.read_tables(spark, root)
    assert first["shape_stop_positions"].count() == 2
    # The next feed lacks stop A1 and trip t2, and renames route R1.
    newer = {
        **raw,
        "routes": raw["routes"].withColumn("route_short_name", F.when(F.col("route_id") == "R1", "one").otherwise(F.col("route_short_name"))),
        "stops": raw["stops"].where("stop_id <> 'A1' or stop_id is null"),
        "trips": raw["trips"].where("trip_id <> 'X_t2'"),
    }
    result = load.refresh(spark, newer, root, mode, keep_absent)
    t = load.read_tables(spark, root)
    assert rows(t["routes"], "route_short_name") == [("R2",), ("one",)]
    assert ("A1" in {r[0] for r in rows(t["stops"], "stop_id")}) == keep_absent
    assert ("X_t2" in {r[0] for r in rows(t["trips"], "trip_id")}) == keep_absent
    # Stop times of the lost stop and trip go: pruned, or not reloaded.
    assert rows(t["stop_times"], "trip_id", "stop_sequence") == [("X_t1", 2)]
    assert t["shape_stop_positions"].count() == (2 if keep_absent else 1)
    pruned = {r["table"]: r["pruned"] for r in result["report"].collect()}
    assert pruned["stops"] == (0 if keep_absent else 1) and pruned["trips"] == (0 if keep_absent else 1)
    # Stop positions of the lost stop are accounted for too.
    assert pruned.get("shape_stop_positions") == (None if keep_absent else 1)
    with pytest.raises(ValueError):
        load.refresh(spark, raw, root, "merge")


def test_a_failed_refresh_leaves_the_old_tables(spark, folder, tmp_path, monkeypatch):
    raw, root = feed.read_feed(spark, folder), str(tmp_path / "tables")
    load.refresh(spark, raw, root)
    before = {name: rows(df) for name, df in load.read_tables(spark, root).items()}
    newer = {**raw, "routes": raw["routes"].where("route_id <> 'R2'"), "stops": raw["stops"].where("stop_id <> 'E'")}
    whole = load.stage_version

    def failing(df, where, table):
        if table == "trips":
            raise OSError("no space left")
        return whole(df, where, table)

    monkeypatch.setattr(load, "stage_version", failing)
    with pytest.raises(OSError):
        load.refresh(spark, newer, root)
    # Routes and stops were written by then, but no reader sees them.
    assert {name: rows(df) for name, df in load.read_tables(spark, root).items()} == before
    monkeypatch.setattr(load, "stage_version", whole)

    # Another refresh commits while this one is being worked out: the later one loses.
    def overtaken(*args):
        monkeypatch.setattr(load, "report", plain_report)
        load.refresh(spark, raw, root)
        return plain_report(*args)

    plain_report = load.report
    monkeypatch.setattr(load, "report", overtaken)
    with pytest.raises(manifest.Conflict):
        load.refresh(spark, newer, root)
    assert {name: rows(df) for name, df in load.read_tables(spark, root).items()} == before
    # Versions of the failed, overtaken and earlier refreshes can go.
    assert store.remove_versions(spark, root, keep=1, older_than_hours=1) == 0
    assert store.remove_versions(spark, root, keep=1, older_than_hours=0) >= 2 + 5 + 5
    assert {name: rows(df) for name, df in load.read_tables(spark, root).items()} == before


def test_served_pairs_follow_every_refresh(spark, folder, tmp_path):
    """Stations and route lines read pairs kept by the load; they equal the full computation."""
    raw, root, rng = feed.read_feed(spark, folder), str(tmp_path / "tables"), random.Random(4)
    for turn in range(3):
        some = lambda key: F.xxhash64(F.lit(rng.random()), key) % 4 != 0
        part = raw if turn == 0 else {**raw, "trips": raw["trips"].where(some("trip_id")), "stop_times": raw["stop_times"].where(some("stop_id"))}
        load.refresh(spark, part, root, keep_absent=turn == 2)
        if turn == 0:
            load.build_derived(spark, root)
        t = load.read_tables(spark, root)
        bare = {name: df for name, df in t.items() if name not in ("stop_routes", "route_shapes", "extents")}
        assert {"stop_routes", "route_shapes", "extents"} <= set(t)
        assert rows(views.stations(t)) == rows(views.stations(bare)) and rows(views.route_lines(t)) == rows(views.route_lines(bare))
        plan = views.stations(t)._jdf.queryExecution().executedPlan().toString()
        assert "stop_times" not in plan and "trips/" not in plan


def test_scratch_folders_go(spark, folder, tmp_path):
    there = lambda: manifest.listed(spark, store._scratch(spark))
    before = there()
    load.refresh(spark, feed.read_feed(spark, folder), str(tmp_path / "tables"))
    load.build_derived(spark, str(tmp_path / "tables"))
    assert there() == before


def test_scattered_trips_are_in_the_ledger(spark):
    trips = ["a", "a", "b", "a", "c", "b", "c"]
    df = spark.createDataFrame([(t, i + 5, i * 10) for i, t in enumerate(trips)], "trip_id string, n int, ord long")
    found = quality.ledger(quality.reentry_log(df, "stop_times", "trip_id")).collect()
    # One row of b stands between rows of a, and so on: a, b and c start again once each.
    assert [tuple(r) for r in found] == [("stop_times", "repaired", "scattered:trip_id", 3, ["a", "b", "c"])]
    unordered = df.withColumn("ord", F.lit(0).cast("long"))
    assert quality.reentry_log(unordered, "stop_times", "trip_id").isEmpty()


def test_no_task_takes_all_rows_of_a_feed_without_order(spark, monkeypatch):
    """Without a file order there is nothing to number; rows of one place in the file are parted by key."""
    written = []
    keep = ordered.materialise
    monkeypatch.setattr(ordered, "materialise", lambda df, name: written.append(keep(df, name)) or written[-1])
    rows = spark.range(20_000).select(F.concat(F.lit("t"), F.col("id") % 500).alias("trip_id"), F.lit(0).cast("long").alias("ord"))
    assert quality.reentry_log(rows, "stop_times", "trip_id").isEmpty()
    assert written.pop().isEmpty()
    late = rows.withColumn("ord", F.when(F.col("trip_id") == "t7", spark_id()).otherwise(0))
    assert quality.reentry_log(late, "stop_times", "trip_id").count() <= 1
    sizes = [r["count"] for r in written.pop().groupBy(ordered.PART).count().collect()]
    assert max(sizes) < 10_000


def spark_id():
    return F.monotonically_increasing_id() % 3


def test_staged_stop_times_are_shuffled_once(spark):
    """Rows that met their trip by a shuffle are ordered within their key where they are, and tell
    which of them stays as ``dedupe`` would."""
    values = [(f"t{i % 40}", str(i % 3) if i % 11 else "x", f"S{i % 4}", "8:00:00", "08:00:00", i * 7919 % 101) for i in range(600)]
    raw = spark.createDataFrame(values, "trip_id string, stop_sequence string, stop_id string, arrival_time string, departure_time string, tb int")
    trips = spark.createDataFrame([(f"t{i}",) for i in range(30)], "trip_id string")
    stops = spark.createDataFrame([(f"S{i}",) for i in range(3)], "stop_id string")
    order, found = ["tb", "stop_id"], []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = quality.judge_stop_times(raw, trips, stops, ("tb",), texts=False, first=order).df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange hashpartitioning(trip_id" in plan and "Window" in plan
    assert not any("Exchange" in line and "seq#" in line.split("Exchange", 1)[1].split("ENSURE")[0] for line in plan.splitlines())
    for first in (order, None):
        staged = quality.clean_stop_times(raw, trips, stops, ("tb",), store.materialise, first)[0]
        found.append(rows(load.collapse_table({"stop_times": staged}, "stop_times", {"stop_times": order})))
    assert found[0] == found[1] and len(found[0]) > 50


def test_accounts_scan_little(spark, cleaned):
    """The accounts read the judged rows a few times each, without nested loops."""
    staged, logs = cleaned
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    report, entries = plan(load.report(*cleaned)), plan(load.ledger(*cleaned, reentries=False))
    gathered = plan(quality.log_rows(*logs.values(), quality.duplicate_log(staged["stop_times"], "stop_times", ["trip_id", "stop_sequence"])))
    assert report.count("FileScan") <= 15 and entries.count("FileScan") + gathered.count("FileScan") <= 15
    assert not any(loop in text for text in (report, entries, gathered) for loop in ("NestedLoop", "CartesianProduct"))


def test_constraint_audit_finds_violations(spark):
    t = {
        "routes": spark.createDataFrame([("R", "r"), ("R", None)], "route_id string, route_short_name string"),
        "trips": spark.createDataFrame([("t", "R", "s", None), ("u", "Q", "s", None)], "trip_id string, route_id string, service_id string, shape_id string"),
        "scheduled_headway": spark.createDataFrame([("s", "R", 48, 1)], "stop_id string, route_id string, hour_bucket int, scheduled_trips int"),
    }
    got = {r[0]: r[1] for r in audit.constraint_audit(t).collect()}
    assert got["routes unique (route_id)"] == 1 and got["routes.route_short_name not null"] == 1
    assert got["trips.route_id -> routes"] == 1 and got["scheduled_headway.hour_bucket range"] == 1
    assert got["trips unique (trip_id)"] == 0


def test_scalars(spark):
    cases = spark.createDataFrame(
        [(" \t x ",), ("  ",), (None,), ("07",), ("+5",), ("1.0",), ("1e2",), ("1.5d",), ("99999999999",), ("nan",)], "c string"
    )
    c = F.col("c")
    got = cases.select(scalars.blank_to_null(c), scalars.lenient_int(c), scalars.lenient_double(c), scalars.location_type(c)).collect()
    assert [r[0] for r in got[:3]] == ["x", None, None]
    assert [r[1] for r in got[3:]] == [7, 5, None, None, None, None, None]
    assert [r[2] for r in got[3:]] == [7.0, 5.0, 1.0, 100.0, None, 99999999999.0, None]
    assert [r[3] for r in got[3:6]] == [7, 5, 0]
    ids = spark.createDataFrame([("L0S1-SI-3017-S13_000600_SI.S03R",), ("plain",)], "i string")
    assert [r[0] for r in ids.select(scalars.rt_trip_id(F.col("i"))).collect()] == ["000600_SI.S03R", "plain"]
    codes = spark.createDataFrame([(0,), (1,), (2,), (7,), (None,)], "i int")
    assert [r[0] for r in codes.select(scalars.status_text(F.col("i"))).collect()] == ["INCOMING_AT", "STOPPED_AT", "IN_TRANSIT_TO", None, None]
    times = spark.createDataFrame([("24:47:00", 89220), ("124:00:59", 446459), ("7:01:02", 25262), ("7:1:2", None), ("12:34", None), ("12:60:00", None), (None, None)], "c string, s int")
    for text, seconds, parsed, printed in times.select("c", "s", scalars.clock_seconds(c), scalars.clock_text(F.col("s"))).collect():
        assert parsed == seconds and (seconds is None or printed == text.zfill(len(printed)))
    halves = spark.createDataFrame([(2.5,), (3.5,), (2.4999999999,), (None,)], "x double")
    assert [r[0] for r in halves.select(scalars.half_even_int(F.col("x"))).collect()] == [2, 4, 2, None]
    # Nothing to travel: progress 0, and no division by zero.
    progress = spark.createDataFrame([(5.0, 10.0), (50.0, 10.0), (-1.0, 10.0), (5.0, 0.0)], "e double, n double")
    assert [r[0] for r in progress.select(scalars.clamped_progress(F.col("e"), F.col("n"))).collect()] == [0.5, 1.0, 0.0, 0.0]
    assert math.isclose(spark.range(1).select(scalars.clock_interval(F.lit(100920))).first()[0].total_seconds(), 100920)


def test_headway(spark):
    at = lambda service, *seconds: [(f"{service}{i}", "S", s, "R", service) for i, s in enumerate(seconds)]
    h = 3600
    rows_ = at("w", 8 * h, 8 * h, 8 * h + 59, 8 * h + 119, 8 * h + 120 + 61, 8 * h + 181 + 7200) + at("e", 8 * h + 30, 8 * h + 30 + 7201, 25 * h, 25 * h + 300, 48 * h, 48 * h + 60)
    df = spark.createDataFrame(rows_, "trip_id string, stop_id string, departure_sec int, route_id string, service_id string")
    got = rows(headway.scheduled(df.select("trip_id", "stop_id", "departure_sec"), df.select("trip_id", "route_id", "service_id")))
    # Kept gaps at 8h: 60 and 62; at 10h: 7200; at 25h: 300. Dropped: 0, 59, 7201, overnight, hour 48.
    assert got == [("S", "R", 10, 1, 7200, 7200), ("S", "R", 25, 1, 300, 300), ("S", "R", 8, 2, 61, 62)]
    with pytest.raises(ValueError):
        headway.scheduled(df, df, min_gap=0)


def test_a_table_is_loaded_with_those_it_refers_to_only(spark, folder, monkeypatch):
    raw, staged = feed.read_feed(spark, folder), []

    def stage(df, name):
        staged.append(name)
        return df

    cleaned = load.Cleaned(raw, stage=stage)
    cleaned["routes"]
    assert staged == ["judged_routes"]
    cleaned["trips"]
    assert set(staged) == {"judged_routes", "ids_routes", "judged_shapes", "shapes", "ids_shapes", "judged_trips"}
    assert sorted(cleaned.logs) == ["routes", "shapes", "trips"]


def test_stop_times_are_staged_without_texts_that_parsed(spark, folder):
    staged = {}

    def stage(df, name):
        staged[name] = df
        return df

    load.Cleaned(feed.read_feed(spark, folder), stage=stage)["stop_times"]
    judged = staged["judged_stop_times"]
    assert "stop_sequence" not in judged.columns
    assert {r["departure_time"] for r in judged.collect()} == {None, "7:1:2"}


def test_references_are_counted_before_the_shuffle(spark):
    """A value that many rows hold leaves an input partition once; all its rows count as violations."""
    t = {
        "routes": spark.createDataFrame([("R", "r")], "route_id string, route_short_name string"),
        "trips": spark.createDataFrame([(f"t{i}", "Q" if i < 7 else "R", "s", None) for i in range(20)], "trip_id string, route_id string, service_id string, shape_id string"),
    }
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = audit.constraint_audit(t)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert {r["constraint_name"]: r["violations"] for r in found.collect()}["trips.route_id -> routes"] == 7
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    below = [lines[at + 1] for at, line in enumerate(lines) if "Exchange hashpartitioning(route_id" in line]
    assert below and all("HashAggregate(keys=[route_id" in line for line in below)
