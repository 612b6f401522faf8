"""The stream gives what the batch twin gives on the same polls."""

import json
import os
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tramline.schemas import KEYS
from tramline.operators import tracking
from tramline.sources import manifest, snapshots
from tramline.streaming import changes, poller, upkeep
from tramline.operators.tables import insert_if_absent

A, B, C = "000001_X", "000002_X", "000003_X"
# (poll, feed, trip, stop, status code); poll 3 is empty, feed2 fails in poll 5.
RECORDS = [
    (0, "feed1", A, "S1", 1), (0, "feed2", B, "S1", 2),
    (1, "feed1", A, "S1", 1), (1, "feed2", B, "S2", 1), (1, "feed2", C, "", 1),
    (2, "feed1", A, "S2", 2), (2, "feed1", A, "S2", 1), (2, "feed2", B, "S2", 1),
    (4, "feed1", A, "S2", 1), (4, "feed2", B, "S2", 1),
    (5, "feed1", A, "S3", 1),
    (6, "feed1", A, "S3", 1), (6, "feed2", B, "S2", 1), (6, "feed2", "", "S2", 1), (6, "feed2", C, "S9", 7),
]


def land(folder, polls):
    for poll in polls:
        rows = [r for r in RECORDS if r[0] == poll]
        for feed in ("feed1", "feed2"):
            path = folder / f"poll_seq={poll}" / f"feed={feed}"
            path.mkdir(parents=True)
            lines = [
                json.dumps({
                    "poll_ts": f"2024-01-01T00:{poll:02d}:00Z", "ordinal": i, "trip_id": trip, "start_date": "20240101",
                    "route_id": "R1", "stop_id": stop, "status_code": code, "feed_epoch": 1704067200 + 60 * poll,
                })
                for i, (_, f, trip, stop, code) in enumerate(rows) if f == feed
            ]
            if poll == 5 and feed == "feed2":
                lines = ['{"trip_id": "000002_X", "start']
            (path / "part.json").write_text("\n".join(lines))
            # The file source goes by modification time; real polls land seconds apart.
            os.utime(path / "part.json", (1704067200 + 30 * poll, 1704067200 + 30 * poll))


def outputs(spark, root):
    read = lambda name: poller.read(spark, root, name)
    return {
        "positions": sorted((tuple(r) for r in read("positions").select("trip_id", "stop_id", "current_status", "poll_seq").collect()), key=repr),
        "events": sorted((tuple(r) for r in read("stop_events").select("trip_id", "stop_id", "poll_seq").collect()), key=repr),
        "metrics": sorted((tuple(r) for r in poller.metrics(spark, root).select(
            "poll_seq", "vehicles", "changed", "unchanged", "appeared", "arrivals", "failures").collect()), key=repr),
    }


def batch(spark, landed):
    records = snapshots.read(spark, landed)
    changed = changes.changes(changes.normalize(snapshots.readable(records)))
    events = insert_if_absent(None, changes.arrivals(changed), KEYS["stop_events"], changes.ORDER)
    text = lambda df, *c: sorted((tuple(r) for r in df.select(*c).collect()), key=repr)
    return {
        "positions": text(changes.positions(changed), "trip_id", "stop_id", "current_status", "poll_seq"),
        "events": text(events, "trip_id", "stop_id", "poll_seq"),
        "metrics": text(poller.dry_run(records), "poll_seq", "vehicles", "changed", "unchanged", "appeared", "arrivals", "failures"),
    }


@pytest.mark.parametrize("files_per_batch", [4, 100])
def test_stream_equals_batch(spark, tmp_path, files_per_batch):
    landed, root, checkpoint = tmp_path / "landed", str(tmp_path / "out"), str(tmp_path / "cp")
    # Two runs of one checkpoint: a restart in between.
    for polls in ([0, 1, 2], [4, 5, 6]):
        land(landed, polls)
        poller.start(snapshots.read_stream(spark, str(landed), files_per_batch), root, checkpoint).awaitTermination(120)
    got, expected = outputs(spark, root), batch(spark, str(landed))
    assert got == expected
    by_poll = {row[0]: row for row in got["metrics"]}
    # Poll 4 follows an empty poll: both trains are forgotten and appear anew.
    assert by_poll[4][4] == 2
    # Poll 6: B was lost with the failed feed, C was away.
    assert by_poll[5][6] == 1 and by_poll[6][4] == 2


def test_repeated_batch_changes_nothing(spark, tmp_path):
    landed, root = tmp_path / "landed", str(tmp_path / "out")
    land(landed, [0, 1, 2])
    records = snapshots.read(spark, str(landed))
    poller.process(records.where("poll_seq < 2"), 0, root)
    poller.process(records.where("poll_seq = 2"), 1, root)
    once = outputs(spark, root)
    poller.process(records.where("poll_seq = 2"), 1, root)
    assert outputs(spark, root) == once


@pytest.mark.parametrize("broken", [False, True])
def test_a_first_batch_without_arrivals_does_not_end_the_stream(spark, tmp_path, broken):
    landed, root = tmp_path / "landed", str(tmp_path / "out")
    land(landed, [3])
    if broken:
        for path in sorted(landed.rglob("part.json")):
            path.write_text('{"trip_id": "000002_X", "start')
            os.utime(path, (1704067290, 1704067290))
    for more in ([], [4, 5, 6]):
        land(landed, more)
        poller.start(snapshots.read_stream(spark, str(landed)), root, str(tmp_path / "ck")).awaitTermination()
    assert outputs(spark, root)["events"]


def land_days(folder, polls, per_day=3):
    """Polls of three trains that move by one stop a poll, several days of them."""
    for poll in polls:
        path, day = folder / f"poll_seq={poll}" / "feed=feed1", 1 + poll // per_day
        path.mkdir(parents=True)
        (path / "part.json").write_text("\n".join(
            json.dumps({
                "poll_ts": f"2024-01-{day:02d}T{poll % per_day:02d}:30:00Z", "ordinal": i, "trip_id": trip,
                "start_date": f"202401{day:02d}", "route_id": "R1", "stop_id": f"S{(poll + i) % 4}", "status_code": 1,
                "feed_epoch": 1704067200 + 86400 * (day - 1) + 3600 * (poll % per_day),
            })
            for i, trip in enumerate((A, B, C))
        ))
        os.utime(path / "part.json", (1704067200 + 30 * poll, 1704067200 + 30 * poll))


def test_upkeep_in_a_running_stream(spark, tmp_path):
    landed, root, checkpoint = tmp_path / "landed", str(tmp_path / "out"), str(tmp_path / "cp")
    run = lambda: poller.start(
        snapshots.read_stream(spark, str(landed), 1), root, checkpoint, keep_days=2, fold_at=2
    ).awaitTermination(300)
    land_days(landed, range(5))
    run()
    reader = poller.read(spark, root, "positions")
    before = sorted(r["poll_seq"] for r in reader.select("poll_seq").collect())
    # A plan made now is read again after the parts it names were folded.
    land_days(landed, range(5, 7))
    run()
    assert sorted(r["poll_seq"] for r in reader.select("poll_seq").collect()) == before
    land_days(landed, range(7, 12))
    run()
    held = manifest.latest(spark, root)[1]
    # Days 1 to 4 have come; two days before the newest poll are kept.
    assert sorted(held["parts"]["positions"]) == ["2024-01-02", "2024-01-03", "2024-01-04"]
    closed, parts = ["2024-01-02"], held["parts"]["positions"]
    assert all(len(parts[day]) == 1 and parts[day][0].startswith("f") for day in closed)
    assert all(len(p) <= 4 for days in held["parts"].values() for p in days.values())
    days = {str(r["observed_date"]): r["count"] for r in poller.read(spark, root, "positions").groupBy("observed_date").count().collect()}
    assert days == {"2024-01-02": 9, "2024-01-03": 9, "2024-01-04": 9}
    # Every poll is counted once, whatever was folded; events outlive the positions.
    assert [r["vehicles"] for r in poller.metrics(spark, root).orderBy("poll_seq").collect()] == [3] * 12
    events = poller.read(spark, root, "stop_events")
    assert events.count() == events.select(*KEYS["stop_events"]).distinct().count() == 36
    # Folders that the manifest no longer names are gone, but for those replaced lately.
    named = {p for p in upkeep.addresses(held, "positions")} | {path for path, _ in held["trash"]}
    there = {f"positions/{day}/{part}" for day in manifest.listed(spark, f"{root}/positions") if "=" in day for part in manifest.listed(spark, f"{root}/positions/{day}")}
    assert {path for path in there if "/part=" in path} <= named
    # The live view prunes days and reads no others.
    fresh = tracking.fresh(poller.read(spark, root, "positions"), datetime(2024, 1, 4, 2, 5), 60)
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(observed_date" in plan and fresh.inputFiles() is not None
    assert fresh.count() == 3
    # The two latest halts of a run, kept up by the stream, are those of the whole history.
    log = poller.read(spark, root, "positions")
    latest = tracking.latest_positions(log, datetime(2024, 1, 4, 3), 24 * 60)
    text = lambda df: sorted(map(str, df.select("trip_id", "prev_stop_id", "prev_at").collect()))
    assert text(tracking.previous_of(latest, poller.read(spark, root, "halts"))) == text(tracking.previous_stop(latest, log))


def test_first_arrivals_look_only_where_the_filter_says(spark, tmp_path):
    landed, root = tmp_path / "landed", str(tmp_path / "out")
    land_days(landed, range(6))
    records = snapshots.read(spark, str(landed))
    for poll in range(5):
        assert poller.process(records.where(f"poll_seq = {poll}"), poll, root) == []
    # Poll 3 and 4 are of day 2. Other days' events cannot even be read from here on.
    for path in (tmp_path / "out" / "stop_events" / "trip_start_date=2024-01-01").rglob("*.parquet"):
        path.write_text("not parquet")
        path.with_name(f".{path.name}.crc").unlink(missing_ok=True)
    # The trains of poll 4 stand where they stood: their arrivals are known, one new one is not.
    again = records.where("poll_seq = 4").withColumn("poll_seq", F.lit(9).cast("long"))
    more = again.where(F.col("trip_id") == A).withColumn("stop_id", F.lit("S9"))
    looked = poller.process(again.unionByName(more), 5, root)
    held = manifest.latest(spark, root)[1]
    assert looked == upkeep.addresses(held, "stop_events", ["2024-01-02"], "b000000000005") and len(looked) == 2
    day = upkeep.addresses(held, "stop_events", ["2024-01-02"])
    events = upkeep.read(spark, root, held, "stop_events", day).select("trip_id", "stop_id")
    assert events.count() == events.distinct().count() == 7
    # The same batch once more, as after a failure.
    poller.process(again.unionByName(more), 5, root)
    held = manifest.latest(spark, root)[1]
    assert upkeep.read(spark, root, held, "stop_events", upkeep.addresses(held, "stop_events", ["2024-01-02"])).count() == 7


def test_halts_kept_up_equal_the_history(spark):
    rng = random.Random(9)
    rows = [
        (f"t{rng.randrange(6)}", date(2024, 1, 1 + rng.randrange(2)), rng.choice(["S1", "S2", "S3", None]), rng.choice(["STOPPED_AT", "IN_TRANSIT_TO"]),
         datetime(2024, 1, 2, 0, 0, rng.randrange(50)), poll, i)
        for i in range(300) for poll in [i // 30]
    ]
    log = spark.createDataFrame(rows, "trip_id string, trip_start_date date, stop_id string, current_status string, observed_at timestamp, poll_seq long, ordinal long")
    log = log.withColumn("route_id", F.lit("R")).checkpoint()
    halts = None
    for poll in range(0, 10, 3):
        halts = tracking.last_halts(log.where(f"poll_seq between {poll} and {poll + 2}"), halts).checkpoint()
    text = lambda df: sorted(map(str, df.collect()))
    assert text(halts) == text(tracking.last_halts(log))
    latest = tracking.latest_positions(log, datetime(2024, 1, 2, 0, 0, 50), 60)
    columns = ["trip_id", "trip_start_date", "stop_id", "prev_stop_id", "prev_at"]
    assert text(tracking.previous_of(latest, halts).select(*columns)) == text(tracking.previous_stop(latest, log).select(*columns))
