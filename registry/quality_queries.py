"""Cleaning, table maintenance and scalar expressions."""

from __future__ import annotations

import uuid
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixtures import ORDER, raw, snapshots, tables, view
from registry.base import query
from registry.ctes import integer, seconds, sql
from tramline.functions import scalars
from tramline.operators import ordered, quality
from tramline.operators import tables as maintenance
from tramline.plans import audit, load
from tramline.schemas import DEFAULT_ROUTE_COLOR, DEFAULT_TEXT_COLOR, KEYS
from tramline.sources import snapshots as landed
from tramline.sources.manifest import delete
from tramline.sources.store import shared_folder
from tramline.streaming import changes

KEEP = ("tb1", "tb2", "tb3")


def _known(spark, d):
    """Judged trips and stop times of the raw feed."""
    t = tables(spark, d)
    feed = raw(spark, d)
    trips = quality.judge_trips(feed["trips"], t["routes"], t["shapes"])
    times = quality.judge_stop_times(feed["stop_times"], t["trips"], t["stops"], KEEP)
    return trips, times


def _reason(judged: quality.Judged):
    """Reason of a row's skip as a column."""
    chain = F.when(F.lit(False), F.lit(""))
    for number, rule in enumerate(judged.skips):
        text = F.lit(rule.reason) if isinstance(rule.reason, str) else rule.reason
        chain = chain.when(F.col("_rule") == number, text)
    return chain.alias("reason")


@query("clean_blank", sql("SELECT * FROM n_stops"))
def _(spark, d):
    return quality.normalise(raw(spark, d)["stops"], "stops").drop("ord")


@query("rt_normalize", sql("SELECT * FROM o_obs"))
def _(spark, d):
    obs = changes.normalize(snapshots(spark, d))
    return obs.withColumn("trip_start_date", F.col("trip_start_date").cast("string")).withColumn(
        "observed", F.unix_seconds("observed_at")
    ).drop("observed_at")


@query("rt_start_date", sql("""SELECT ordinal, start_date, CASE WHEN regexp_full_match(start_date, '[0-9]{8}') THEN strftime(strptime(start_date, '%Y%m%d'), '%Y-%m-%d')
    ELSE strftime(to_timestamp(poll_epoch) AT TIME ZONE 'UTC', '%Y-%m-%d') END AS service_date FROM o_snapshots"""))
def _(spark, d):
    return snapshots(spark, d).select(
        "ordinal", "start_date",
        scalars.service_date(F.col("start_date"), F.col("poll_ts")).cast("string").alias("service_date"),
    )


@query("rt_feed_union", sql("""SELECT feed, poll_seq, count(*) FILTER (NOT bad) * CAST(max(bad::INT) = 0 AS INTEGER) AS records, count(*) FILTER (bad) AS unreadable
    FROM (SELECT feed, poll_seq, ordinal, start_date = 'bad' AND status_code = 7 AS bad FROM o_snapshots) v GROUP BY feed, poll_seq"""))
def _(spark, d):
    # Records with a bad date and an unknown status stand for text that was cut off in landing.
    text = F.to_json(F.struct("poll_ts", "ordinal", "trip_id", "start_date", "route_id", "stop_id", "status_code", "feed_epoch"))
    cut = (F.col("start_date") == "bad") & (F.col("status_code") == 7)
    lines = snapshots(spark, d).select(
        "feed", "poll_seq", F.when(cut, F.left(text, F.lit(20))).otherwise(text).alias("value")
    )
    records = landed.parse(lines)
    good = landed.readable(records).groupBy("feed", "poll_seq").agg(F.count("*").alias("records"))
    bad = landed.failures(records).select("feed", "poll_seq", F.col("n").alias("unreadable"))
    return good.join(bad, ["feed", "poll_seq"], "full_outer").na.fill(0)


def _days(spark, d):
    return tables(spark, d)["vehicle_positions"].select(F.col("observed_date").alias("day")).distinct()


_DAYS = "(SELECT DISTINCT CAST(to_timestamp(observed) AT TIME ZONE 'UTC' AS DATE) AS day FROM o_log)"


@query("partition_plan", sql(f"""SELECT strftime(day, '%Y-%m-%d') AS day FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-29', DATE '2024-02-01', INTERVAL 1 DAY)) AS DATE) AS day) w
    WHERE day NOT IN (SELECT day FROM {_DAYS} e)"""))
def _(spark, d):
    return maintenance.partition_plan(_days(spark, d), date(2024, 1, 30)).select(F.col("day").cast("string").alias("day"))


@query("retention_expired", sql(f"SELECT strftime(day, '%Y-%m-%d') AS day FROM {_DAYS} e WHERE day < DATE '2024-01-30' - 7"))
def _(spark, d):
    return maintenance.retention_expired(_days(spark, d), date(2024, 1, 30)).select(F.col("day").cast("string").alias("day"))


@query("partition_names", sql(f"""SELECT 'vehicle_positions_' || strftime(day, '%Y%m%d') AS partition_name, strftime(day, '%Y-%m-%d') AS day, CAST(NULL AS VARCHAR) AS other_day FROM {_DAYS} e"""))
def _(spark, d):
    name = scalars.partition_name("vehicle_positions", F.col("day"))
    return _days(spark, d).select(
        name.alias("partition_name"),
        scalars.partition_day("vehicle_positions", name).cast("string").alias("day"),
        scalars.partition_day("stop_events", name).cast("string").alias("other_day"),
    )


@query("upsert_merge", sql("""SELECT stop_id, stop_name FROM c_stops WHERE stop_id NOT IN (SELECT stop_id FROM n_stops WHERE location_type = '1')
    UNION ALL SELECT stop_id, 'station ' || coalesce(stop_name, '') FROM n_stops WHERE location_type = '1'"""))
def _(spark, d):
    staged = quality.normalise(raw(spark, d)["stops"], "stops").where("location_type = '1'").select(
        "stop_id", F.concat(F.lit("station "), F.coalesce("stop_name", F.lit(""))).alias("stop_name")
    )
    target = tables(spark, d)["stops"].select("stop_id", "stop_name")
    return maintenance.upsert(target, staged, ["stop_id"], ["stop_name"])


@query("prune_absent", sql("SELECT trip_id, route_id FROM c_trips WHERE trip_id IN (SELECT trip_id FROM c_stop_times)"))
def _(spark, d):
    t = tables(spark, d)
    return maintenance.prune(t["trips"], t["stop_times"], KEYS["trips"]).select("trip_id", "route_id")


@query("prune_removed", sql("SELECT count(*) AS pruned FROM c_trips WHERE trip_id NOT IN (SELECT trip_id FROM c_stop_times)"))
def _(spark, d):
    t = tables(spark, d)
    return maintenance.pruned(t["trips"], t["stop_times"], KEYS["trips"]).agg(F.count("*").alias("pruned"))


@query("prune_orphans", sql("""SELECT shape_id, stop_id, round(fraction, 6) AS fraction FROM o_positions
    WHERE shape_id IN (SELECT shape_id FROM c_trips WHERE direction_id = 0) AND stop_id IN (SELECT stop_id FROM c_stops WHERE location_type = 1)"""))
def _(spark, d):
    t = tables(spark, d)
    left = maintenance.prune_orphans(
        t["shape_stop_positions"], t["trips"].where("direction_id = 0"), t["stops"].where("location_type = 1")
    )
    return left.select("shape_id", "stop_id", F.round("fraction", 6).alias("fraction"))


@query("replace_load", sql("SELECT * FROM c_stop_times"))
def _(spark, d):
    t = tables(spark, d)
    good, _log = quality.clean_stop_times(raw(spark, d)["stop_times"], t["trips"], t["stops"], KEEP)
    return quality.dedupe(good, KEYS["stop_times"], ORDER["stop_times"]).select(*load.COLUMNS["stop_times"])


@query("load_report", sql("""SELECT 'routes' AS "table", (SELECT count(*) FROM c_routes) AS loaded, 0 AS duplicates, (SELECT count(*) FROM j_routes WHERE reason IS NOT NULL) AS skipped, 0 AS pruned
    UNION ALL SELECT 'stops', (SELECT count(*) FROM c_stops), 0, (SELECT count(*) FROM j_stops WHERE reason IS NOT NULL), 0
    UNION ALL SELECT 'shapes', (SELECT count(DISTINCT shape_id) FROM c_shapes), 0, (SELECT count(*) FROM j_points WHERE reason IS NOT NULL)
      + (SELECT count(*) FROM (SELECT shape_id FROM d_points GROUP BY shape_id HAVING count(*) < 2) v), 0
    UNION ALL SELECT 'trips', (SELECT count(*) FROM c_trips), 0, (SELECT count(*) FROM j_trips WHERE reason IS NOT NULL), 0
    UNION ALL SELECT 'stop_times', (SELECT count(*) FROM c_stop_times), (SELECT count(*) FROM g_stop_times) - (SELECT count(*) FROM c_stop_times),
      (SELECT count(*) FROM j_stop_times WHERE reason IS NOT NULL), 0"""))
def _(spark, d):
    return load.report(*tables(spark, d).judged())


# The second feed lacks two routes, and every first stop time is in it twice, in file order.
GONE = ("R5", "R11")
_GONE = ", ".join(f"'{route}'" for route in GONE)


def second_feed(feed: dict) -> dict:
    times = feed["stop_times"]
    doubled = times.withColumn("_copy", F.explode(F.when(F.col("stop_sequence") == "1", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    # A file in order of trips whose copies stand at the end.
    place = F.xxhash64("trip_id").bitwiseAND((1 << 40) - 1) * 16 + F.coalesce(F.try_to_number("stop_sequence", F.lit("99")), F.lit(0)).cast("long")
    return {
        **feed,
        "routes": feed["routes"].where(~F.col("route_id").isin(*GONE)),
        "stop_times": doubled.withColumn("ord", place + F.col("_copy") * (1 << 60)).drop("_copy"),
    }


@query("refresh_second_load", sql(f"""SELECT "table", loaded, duplicates, skipped, pruned FROM (
    SELECT 'routes' AS "table", count(*) FILTER (NOT gone) AS loaded, 0 AS duplicates, (SELECT count(*) FROM j_routes WHERE reason IS NOT NULL AND coalesce(route_id NOT IN ({_GONE}), TRUE)) AS skipped,
      count(*) FILTER (gone) AS pruned FROM (SELECT route_id IN ({_GONE}) AS gone FROM c_routes) r
    UNION ALL SELECT 'stops', (SELECT count(*) FROM c_stops), 0, (SELECT count(*) FROM j_stops WHERE reason IS NOT NULL), 0
    UNION ALL SELECT 'shapes', (SELECT count(DISTINCT shape_id) FROM c_shapes), 0, (SELECT count(*) FROM j_points WHERE reason IS NOT NULL)
      + (SELECT count(*) FROM (SELECT shape_id FROM d_points GROUP BY shape_id HAVING count(*) < 2) v), 0
    UNION ALL SELECT 'trips', count(*) FILTER (NOT gone), 0,
      (SELECT count(*) FROM j_trips WHERE reason IS NOT NULL OR route_id IN ({_GONE})), count(*) FILTER (gone) FROM (SELECT route_id IN ({_GONE}) AS gone FROM c_trips) t
    UNION ALL SELECT 'stop_times', (SELECT count(*) FROM c_stop_times JOIN c_trips USING (trip_id) WHERE route_id NOT IN ({_GONE})),
      (SELECT count(*) + count(*) FILTER (stop_sequence = 1) FROM g_stop_times JOIN c_trips USING (trip_id) WHERE route_id NOT IN ({_GONE}))
        - (SELECT count(*) FROM c_stop_times JOIN c_trips USING (trip_id) WHERE route_id NOT IN ({_GONE})),
      (SELECT count(*) + count(*) FILTER (j.stop_sequence = '1') FROM j_stop_times j LEFT JOIN c_trips t ON t.trip_id = j.trip_id WHERE j.reason IS NOT NULL OR t.route_id IN ({_GONE})),
      (SELECT count(*) FROM c_stop_times JOIN c_trips USING (trip_id) WHERE route_id IN ({_GONE}))) v"""))
def _(spark, d):
    root = f"{shared_folder(spark)}/tramline/{spark.sparkContext.applicationId}/refresh-{uuid.uuid4().hex}"
    first = raw(spark, d)
    load.refresh(spark, first, root, order=ORDER)
    found = load.refresh(spark, second_feed(first), root, order=ORDER)["report"]
    delete(spark, root)
    return found


@query("stop_events_first", sql("SELECT * FROM o_events"))
def _(spark, d):
    t = tables(spark, d)
    first = maintenance.insert_if_absent(None, changes.arrivals(t["changes"]), KEYS["stop_events"], changes.ORDER)
    return first.select(
        "trip_id", F.col("trip_start_date").cast("string").alias("trip_start_date"), "route_id", "stop_id",
        F.unix_seconds("arrived_at").alias("observed"),
    )


_REQUIRED = " UNION ALL ".join(
    f"SELECT '{table}' AS \"table\", reason, count(*) AS n FROM j_{cte} WHERE reason IN ('required:route_id', 'required:stop_id', 'required:stop_name', 'required:shape_id', 'required:trip_id', 'required:service_id') GROUP BY reason"
    for table, cte in (("routes", "routes"), ("stops", "stops"), ("shapes", "points"), ("trips", "trips"))
)


@query("validate_required", sql(_REQUIRED))
def _(spark, d):
    feed = raw(spark, d)
    judged = [quality.judge_routes(feed["routes"]), quality.judge_stops(feed["stops"]), quality.judge_points(feed["shapes"]), _known(spark, d)[0]]
    log = reduce(DataFrame.unionByName, (j.log for j in judged))
    required = [f"required:{f}" for f in ("route_id", "stop_id", "stop_name", "shape_id", "trip_id", "service_id")]
    return log.where(F.col("reason").isin(required)).groupBy("table", "reason").agg(F.count("*").alias("n"))


@query("filter_route_type", sql("SELECT route_id, reason FROM j_routes"))
def _(spark, d):
    judged = quality.judge_routes(raw(spark, d)["routes"])
    return judged.df.select("route_id", _reason(judged))


@query("repair_short_name", sql("SELECT route_id, coalesce(route_short_name, route_id) AS route_short_name, route_short_name IS NULL AS repaired FROM j_routes WHERE reason IS NULL"))
def _(spark, d):
    good = quality.judge_routes(raw(spark, d)["routes"]).good
    return good.select(
        "route_id", F.coalesce("route_short_name", "route_id").alias("route_short_name"),
        (F.size("_fixes") > 0).alias("repaired"),
    )


@query("lenient_int", sql(f"SELECT stop_sequence, {integer('stop_sequence')} AS parsed, {integer('price')} AS price_parsed, count(*) AS n FROM (SELECT stop_sequence, CAST(tb2 AS VARCHAR) AS price FROM fx_stop_times) v GROUP BY ALL"))
def _(spark, d):
    times = view(spark, d, "fx_stop_times").withColumn("price", F.col("tb2").cast("string"))
    return times.groupBy(
        "stop_sequence", scalars.lenient_int(F.col("stop_sequence")).alias("parsed"),
        scalars.lenient_int(F.col("price")).alias("price_parsed"),
    ).agg(F.count("*").alias("n"))


@query("location_type_default", sql(f"SELECT stop_id, location_type AS raw_type, CAST(coalesce({integer('location_type')}, 0) AS SMALLINT) AS location_type FROM n_stops"))
def _(spark, d):
    return quality.normalise(raw(spark, d)["stops"], "stops").select(
        "stop_id", F.col("location_type").alias("raw_type"), scalars.location_type(F.col("location_type")).alias("location_type")
    )


@query("gtfs_time_seconds", sql(f"SELECT trip_id, arrival_time, {seconds('arrival_time')} AS arrival_sec, departure_time, {seconds('departure_time')} AS departure_sec FROM n_stop_times"))
def _(spark, d):
    return quality.normalise(raw(spark, d)["stop_times"], "stop_times").select(
        "trip_id", "arrival_time", scalars.clock_seconds(F.col("arrival_time")).alias("arrival_sec"),
        "departure_time", scalars.clock_seconds(F.col("departure_time")).alias("departure_sec"),
    )


@query("validate_coordinate", sql("SELECT stop_id, reason FROM j_stops WHERE reason IS NOT NULL"))
def _(spark, d):
    judged = quality.judge_stops(raw(spark, d)["stops"])
    return judged.df.where("_rule is not null").select("stop_id", _reason(judged))


def _parents(spark, d):
    return quality.judge_parents(quality.judge_stops(raw(spark, d)["stops"]).good)


@query("repair_parent", sql("""SELECT s.stop_id, s.parent_station AS raw_parent, c.parent_station, s.parent_station IS NOT NULL AND s.parent_station NOT IN (SELECT stop_id FROM s_stops) AS dangling
    FROM s_stops s JOIN c_stops c USING (stop_id)"""))
def _(spark, d):
    return _parents(spark, d).df.select(
        "stop_id", F.col("parent_station").alias("raw_parent"), F.col("parent_kept").alias("parent_station"),
        F.array_contains("_fixes", 0).alias("dangling"),
    )


@query("repair_self_parent", sql("SELECT stop_id, parent_station AS raw_parent FROM s_stops WHERE parent_station = stop_id"))
def _(spark, d):
    return _parents(spark, d).df.where(F.array_contains("_fixes", 1)).select("stop_id", F.col("parent_station").alias("raw_parent"))


@query("trips_refcheck", sql("SELECT trip_id, reason, shape_kept, reason IS NULL AND shape_id IS NOT NULL AND shape_kept IS NULL AS shape_lost FROM j_trips"))
def _(spark, d):
    judged = _known(spark, d)[0]
    return judged.df.select(
        "trip_id", _reason(judged), "shape_kept", (F.col("_rule").isNull() & (F.size("_fixes") > 0)).alias("shape_lost")
    )


@query("stop_times_refcheck", sql("SELECT trip_id, stop_sequence, stop_id, reason FROM j_stop_times"))
def _(spark, d):
    judged = _known(spark, d)[1]
    return judged.df.select("trip_id", "stop_sequence", "stop_id", _reason(judged))


@query("repair_times", sql("""SELECT trip_id, seq AS stop_sequence, arrival_time, arrival_sec, departure_time, departure_sec,
    arrival_time IS NOT NULL AND arrival_sec IS NULL AS arrival_repaired, departure_time IS NOT NULL AND departure_sec IS NULL AS departure_repaired
    FROM j_stop_times WHERE reason IS NULL"""))
def _(spark, d):
    judged = _known(spark, d)[1]
    return judged.good.select(
        "trip_id", F.col("seq").alias("stop_sequence"), "arrival_time", "arrival_sec", "departure_time", "departure_sec",
        F.array_contains("_fixes", 3).alias("arrival_repaired"), F.array_contains("_fixes", 4).alias("departure_repaired"),
    )


@query("dedupe_keys", sql("""SELECT trip_id, stop_id, stop_sequence, arrival_sec FROM (SELECT *, row_number() OVER (PARTITION BY trip_id, stop_id ORDER BY tb1, stop_sequence, tb2, tb3) AS rn
    FROM g_stop_times) v WHERE rn = 1"""))
def _(spark, d):
    good, _log = quality.clean_stop_times(raw(spark, d)["stop_times"], tables(spark, d)["trips"], tables(spark, d)["stops"], KEEP)
    return quality.dedupe(good, ["trip_id", "stop_id"], ["tb1", "stop_sequence", "tb2", "tb3"]).select(
        "trip_id", "stop_id", "stop_sequence", "arrival_sec"
    )


@query("noncontiguous_trips", sql("""SELECT trip_id, count(*) AS reentries FROM (SELECT trip_id, ord, lag(ord) OVER (PARTITION BY trip_id ORDER BY ord) AS before FROM (
    SELECT trip_id, row_number() OVER (ORDER BY departure_sec NULLS FIRST, stop_id, trip_id) AS ord FROM c_stop_times) a) b WHERE ord - before > 1 GROUP BY trip_id"""))
def _(spark, d):
    # The rows in departure order; the checkpoint fixes the partitions that are numbered.
    rows = tables(spark, d)["stop_times"].orderBy("departure_sec", "stop_id", "trip_id").select("trip_id").checkpoint()
    return quality.noncontiguous(ordered.dense_ordinal(rows, "ord"), "trip_id", "ord")


_LEDGER_REASONS = """
r AS (
  SELECT 'routes' AS "table", 'skipped' AS kind, reason, route_id AS example FROM j_routes WHERE reason IS NOT NULL
  UNION ALL SELECT 'routes', 'repaired', 'name_from_id', route_id FROM j_routes WHERE reason IS NULL AND route_short_name IS NULL
  UNION ALL SELECT 'stops', 'skipped', reason, stop_id FROM j_stops WHERE reason IS NOT NULL
  UNION ALL SELECT 'stops', 'repaired', 'unknown_parent', stop_id || '->' || parent_station FROM s_stops WHERE parent_station NOT IN (SELECT stop_id FROM s_stops)
  UNION ALL SELECT 'stops', 'repaired', 'parent_of_itself', stop_id FROM s_stops WHERE parent_station = stop_id
  UNION ALL SELECT 'shapes', 'skipped', reason, shape_id FROM j_points WHERE reason IS NOT NULL
  UNION ALL SELECT 'shapes', 'skipped', 'line_of_one_place', shape_id FROM d_points GROUP BY shape_id HAVING count(*) < 2
  UNION ALL SELECT 'trips', 'skipped', reason, CASE reason WHEN 'unknown_route' THEN trip_id || ' (' || coalesce(route_id, 'none') || ')' ELSE trip_id END FROM j_trips WHERE reason IS NOT NULL
  UNION ALL SELECT 'trips', 'repaired', 'unknown_shape', trip_id || ' (' || shape_id || ')' FROM j_trips WHERE reason IS NULL AND shape_id IS NOT NULL AND shape_kept IS NULL
  UNION ALL SELECT 'stop_times', 'skipped', reason, CASE reason WHEN 'unknown_stop' THEN coalesce(stop_id, 'none') ELSE coalesce(trip_id, 'none') END FROM j_stop_times WHERE reason IS NOT NULL
  UNION ALL SELECT 'stop_times', 'repaired', 'bad_clock:arrival_time', trip_id || ' ' || arrival_time FROM j_stop_times WHERE reason IS NULL AND arrival_time IS NOT NULL AND arrival_sec IS NULL
  UNION ALL SELECT 'stop_times', 'repaired', 'bad_clock:departure_time', trip_id || ' ' || departure_time FROM j_stop_times WHERE reason IS NULL AND departure_time IS NOT NULL AND departure_sec IS NULL
  UNION ALL SELECT 'stop_times', 'skipped', 'repeated_key:trip_id,stop_sequence', trip_id || ' #' || stop_sequence FROM (SELECT *, row_number() OVER (PARTITION BY trip_id, stop_sequence ORDER BY tb1) AS rn FROM g_stop_times) g WHERE rn > 1)"""
_LEDGER = sql(
    """SELECT "table", kind, reason, count(*) AS n, coalesce(list_aggregate(list_slice(list_sort(list(example) FILTER (example IS NOT NULL AND rn <= 3)), 1, 3), 'string_agg', ' | '), '') AS examples
    FROM (SELECT *, row_number() OVER (PARTITION BY "table", kind, reason ORDER BY example) AS rn FROM r) v GROUP BY "table", kind, reason""",
    _LEDGER_REASONS,
).replace("WITH RECURSIVE", "WITH")


@query("quality_log", _LEDGER)
def _(spark, d):
    # The views have no file order, so there is none in which a trip could be scattered.
    found = load.ledger(*tables(spark, d).judged(), reentries=False)
    return found.withColumn("examples", F.array_join("examples", " | "))


@query("duplicate_count", sql("""SELECT count(*) AS staged, count(DISTINCT (trip_id, stop_sequence)) AS kept, count(*) - count(DISTINCT (trip_id, stop_sequence)) AS duplicates FROM g_stop_times"""))
def _(spark, d):
    t = tables(spark, d)
    good, _log = quality.clean_stop_times(raw(spark, d)["stop_times"], t["trips"], t["stops"], KEEP)
    return quality.surplus_count(good, KEYS["stop_times"])


def _audit_sql() -> str:
    source = {
        "routes": "c_routes", "stops": "c_stops", "shapes": "(SELECT *, 0 AS ord FROM c_shapes)", "trips": "c_trips", "stop_times": "c_stop_times",
        "shape_stop_positions": "o_positions", "scheduled_headway": "o_headway",
        "vehicle_positions": "(SELECT *, observed AS observed_at FROM o_log)", "stop_events": "(SELECT *, observed AS arrived_at FROM o_events)",
    }
    parts = []
    for table, keys in KEYS.items():
        k = ", ".join(keys)
        parts.append(f"SELECT '{table} unique ({k})' AS constraint_name, count(*) AS violations FROM (SELECT 1 FROM {source[table]} s GROUP BY {k} HAVING count(*) > 1) v")
    for table, extra in audit.NOT_NULL.items():
        for c in dict.fromkeys([*KEYS.get(table, []), *extra]):
            parts.append(f"SELECT '{table}.{c} not null', count(*) FROM {source[table]} s WHERE {c} IS NULL")
    parts.append("SELECT 'scheduled_headway.hour_bucket range', count(*) FROM o_headway WHERE hour_bucket NOT BETWEEN 0 AND 47")
    for table, c, parent, key in audit.REFERENCES:
        parts.append(f"SELECT '{table}.{c} -> {parent}', count(*) FROM {source[table]} s WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {key} FROM {source[parent]} p)")
    return sql(" UNION ALL ".join(parts))


@query("constraint_audit", _audit_sql())
def _(spark, d):
    return audit.constraint_audit(tables(spark, d))


@query("hour_bucket", sql("SELECT trip_id, stop_sequence, departure_sec, CAST(departure_sec // 3600 AS SMALLINT) AS hour_bucket FROM c_stop_times WHERE departure_sec IS NOT NULL"))
def _(spark, d):
    times = tables(spark, d)["stop_times"].where("departure_sec is not null")
    return times.select("trip_id", "stop_sequence", "departure_sec", scalars.hour_bucket(F.col("departure_sec")).alias("hour_bucket"))


@query("rt_trip_id", sql("SELECT trip_id, substring(trip_id, position('_' IN trip_id) + 1) AS rt_trip_id, substring(route_id, position('_' IN route_id) + 1) AS plain_id FROM n_trips"))
def _(spark, d):
    return quality.normalise(raw(spark, d)["trips"], "trips").select(
        "trip_id", scalars.rt_trip_id(F.col("trip_id")).alias("rt_trip_id"), scalars.rt_trip_id(F.col("route_id")).alias("plain_id")
    )


@query("route_colors", sql("SELECT route_id, '#' || coalesce(route_color, '6B7280') AS route_color, '#' || coalesce(route_text_color, 'FFFFFF') AS route_text_color FROM c_routes"))
def _(spark, d):
    return tables(spark, d)["routes"].select(
        "route_id", scalars.hex_color(F.col("route_color"), DEFAULT_ROUTE_COLOR).alias("route_color"),
        scalars.hex_color(F.col("route_text_color"), DEFAULT_TEXT_COLOR).alias("route_text_color"),
    )


@query("progress_clamp", """SELECT l_orderkey, l_linenumber, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (l_quantity - 10) / nullif(l_discount * 300, 0))), 6) AS progress FROM lineitem""")
def _(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    progress = scalars.clamped_progress(F.col("l_quantity") - 10, F.col("l_discount") * 300)
    return lines.select("l_orderkey", "l_linenumber", F.round(progress, 6).alias("progress"))


@query("null_safe_neq", sql("SELECT stop_id, parent_station, parent_station IS DISTINCT FROM stop_id AS differs, parent_station IS DISTINCT FROM NULL AS present FROM c_stops"))
def _(spark, d):
    parent = F.col("parent_station")
    return tables(spark, d)["stops"].select(
        "stop_id", "parent_station", (~parent.eqNullSafe(F.col("stop_id"))).alias("differs"),
        (~parent.eqNullSafe(F.lit(None))).alias("present"),
    )


@query("iso_utc", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def _(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", scalars.iso_utc(F.col("ts").cast("timestamp")).alias("at"))


@query("int_rounding", "SELECT l_orderkey, l_linenumber, CAST(round(l_quantity / 2, 6) AS INTEGER) AS halves, CAST(round(l_extendedprice, 6) AS INTEGER) AS price FROM lineitem")
def _(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", scalars.half_even_int(F.col("l_quantity") / 2).alias("halves"),
        scalars.half_even_int(F.col("l_extendedprice")).alias("price"),
    )


@query("clock_text", sql("SELECT trip_id, stop_sequence, printf('%02d:%02d:%02d', arrival_sec // 3600, arrival_sec % 3600 // 60, arrival_sec % 60) AS arrival FROM c_stop_times WHERE arrival_sec IS NOT NULL"))
def _(spark, d):
    times = tables(spark, d)["stop_times"].where("arrival_sec is not null")
    return times.select("trip_id", "stop_sequence", scalars.clock_text(F.col("arrival_sec")).alias("arrival"))


@query("station_by_name", sql("SELECT stop_id, stop_name FROM c_stops WHERE location_type = 1 AND (stop_name ILIKE 'supplier#0000000%' OR stop_name ILIKE '%5')"))
def _(spark, d):
    return tables(spark, d)["stops"].where("location_type = 1 and stop_name ilike any ('supplier#0000000%', '%5')").select("stop_id", "stop_name")
