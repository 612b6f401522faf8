"""The realtime job: landed snapshots in, positions, stop events and figures out.

Every micro-batch runs the batch operators of ``changes`` on whole polls, so a train
with very many records is spread the same way as in batch. What has to be remembered
between micro-batches, the last state of each run seen in the two newest polls and the two
latest halts of each live run, is a small table each. A batch writes its own parts and makes
them visible by one manifest, together with the upkeep it did; a batch repeated after a
failure writes the same parts again.

Output under ``root``: ``positions`` (by day), ``stop_events`` (by service day), ``metrics``,
``failures``, ``halts`` and ``state``, read by ``read``.
"""

from __future__ import annotations

import copy
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tramline.operators.ordered import first_per_key
from tramline.operators.tables import KEEP_DAYS
from tramline.operators.tracking import HALTS, RUN, last_halts
from tramline.sources import manifest, snapshots
from tramline.sources.store import scratch
from tramline.streaming import arrived as arrivals_known
from tramline.streaming import changes, upkeep

KEPT_STATES = 3
LIVE_DAYS = 2  # days after its service date that a run's halts are remembered


def _remembered(spark: SparkSession, root: str, held: dict, table: str, batch_id: int) -> DataFrame | None:
    """The newest table of its kind that an earlier batch left."""
    before = [int(b) for b in held[table] if int(b) < batch_id]
    return spark.read.parquet(f"{root}/{table}/part={held[table][str(max(before))]}") if before else None


def _remember(spark: SparkSession, root: str, held: dict, table: str, df: DataFrame, batch_id: int, part: str) -> None:
    df.write.mode("overwrite").parquet(f"{root}/{table}/part={part}")
    held[table][str(batch_id)] = part
    for old in sorted(held[table], key=int)[:-KEPT_STATES]:
        held["trash"].append([f"{table}/part={held[table].pop(old)}", batch_id])


def process(
    records: DataFrame, batch_id: int, root: str, keep_days: int = KEEP_DAYS, fold_at: int = upkeep.FOLD_AT,
    target_bytes: int = upkeep.TARGET_BYTES,
) -> list[str]:
    """One micro-batch of landed records; returns the event folders it looked into."""
    spark, part = records.sparkSession, f"b{batch_id:012d}"
    number, found = manifest.latest(spark, root)
    held = {"parts": {}, "schemas": {}, "state": {}, "halts": {}, "bloom": {}, "trash": [], "today": None, **copy.deepcopy(found)}
    held["batch"] = batch_id
    with scratch():
        records = records.persist()
        failed = snapshots.failures(records)
        obs = changes.normalize(snapshots.readable(records))
        state = _remembered(spark, root, held, "state", batch_id)
        rows = obs.select("*", F.lit(False).alias("remembered"))
        if state is not None:
            rows = rows.unionByName(state.select(*changes.OBSERVATION, F.lit(True).alias("remembered")))
        changed = changes.changes(rows).where("not remembered").drop("remembered").persist()

        positions = changes.positions(changed)
        arrived = changes.arrivals(changed)
        held["schemas"] |= {"positions": upkeep.schema_of(positions, "positions"), "stop_events": upkeep.schema_of(arrived, "stop_events")}
        fresh, looked = arrivals_known.unseen(spark, root, held, arrived, changes.ORDER, part)
        fresh = fresh.persist()
        figures = changes.poll_metrics(changed, failed)
        held["schemas"] |= {"metrics": upkeep.schema_of(figures, "metrics"), "failures": upkeep.schema_of(failed, "failures")}
        for table, df in (("positions", positions), ("stop_events", fresh), ("metrics", figures), ("failures", failed)):
            for day in upkeep.write(df, root, table, part):
                parts = held["parts"].setdefault(table, {}).setdefault(day, [])
                if part not in parts:
                    parts.append(part)
                if table == "stop_events":
                    arrivals_known.remember(spark, root, held, fresh.where(F.col("trip_start_date") == F.lit(day).cast("date")), [day], part)

        # Unreadable and empty polls count too: their trains are forgotten.
        newest = records.agg(F.max("poll_seq"), F.max(F.to_date("poll_ts"))).first()
        if newest[1] is not None:
            held["today"] = max(held["today"] or "", newest[1].isoformat())
        if newest[0] is not None:
            every = rows.drop("remembered").where(F.col("poll_seq") >= newest[0] - 1)
            last = first_per_key(every, RUN, [F.desc("poll_seq"), F.desc("ordinal")])
            _remember(spark, root, held, "state", last, batch_id, part)
        halts = last_halts(positions, _remembered(spark, root, held, "halts", batch_id))
        if held["today"]:
            live = date.fromisoformat(held["today"]) - timedelta(days=LIVE_DAYS)
            halts = halts.where(F.col("trip_start_date").isNull() | (F.col("trip_start_date") >= F.lit(live)))
        _remember(spark, root, held, "halts", halts, batch_id, part)
        if held["today"]:
            today = date.fromisoformat(held["today"])
            upkeep.maintain(spark, root, held, today, part, keep_days, fold_at, target_bytes)
        manifest.commit(spark, root, number, held)
        for df in (fresh, changed, records):
            df.unpersist()
    return looked


def start(
    source: DataFrame, root: str, checkpoint: str, once: bool = True, every: str = "30 seconds", keep_days: int = KEEP_DAYS,
    fold_at: int = upkeep.FOLD_AT, target_bytes: int = upkeep.TARGET_BYTES,
) -> StreamingQuery:
    """Run ``process`` on a stream of landed records (``snapshots.read_stream``).

    ``once`` works off what has landed and stops; otherwise a batch starts ``every`` so often.
    Positions older than ``keep_days`` before the newest poll are dropped.
    """
    writer = (
        source.writeStream.foreachBatch(lambda batch, batch_id: process(batch, batch_id, root, keep_days, fold_at, target_bytes))
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """``positions``, ``stop_events``, ``metrics``, ``failures`` or ``halts`` as of the newest batch.

    Folders that upkeep replaces stay for as many batches as it takes to fold a day; a
    reader that runs longer should read again.
    """
    held = manifest.latest(spark, root)[1]
    if table == "halts":
        newest = max((int(b) for b in held.get("halts", {})), default=None)
        return spark.createDataFrame([], HALTS) if newest is None else spark.read.parquet(f"{root}/halts/part={held['halts'][str(newest)]}")
    return upkeep.read(spark, root, held, table, upkeep.addresses(held, table))


def dry_run(records: DataFrame) -> DataFrame:
    """Figures per poll of landed records; nothing is written."""
    failed = snapshots.failures(records)
    return changes.poll_metrics(changes.changes(changes.normalize(snapshots.readable(records))), failed)


def metrics(spark: SparkSession, root: str) -> DataFrame:
    """Figures per poll of everything processed; a poll split between batches counts once."""
    counts = ["vehicles", "changed", "unchanged", "appeared", "arrivals", "failures"]
    per_poll = read(spark, root, "metrics").groupBy("poll_seq").agg(*(F.sum(c).alias(c) for c in counts))
    share = 100 * F.col("unchanged") / F.nullif(F.col("vehicles"), F.lit(0))
    return per_poll.withColumn("deduped_pct", F.coalesce(share, F.lit(0.0)))
