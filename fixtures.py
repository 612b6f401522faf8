"""Feed-shaped views over the test tables.

The SQL runs unchanged in Spark and DuckDB. ``Tables`` cleans, loads and derives the
tables the way a user would, writing each one once per session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.operators.lines import extents, segments
from tramline.operators.tables import insert_if_absent
from tramline.operators.tracking import last_halts
from tramline.plans import load
from tramline.plans.headway import scheduled
from tramline.plans.positions import shape_stop_positions
from tramline.plans.views import route_shapes, stop_routes
from tramline.schemas import KEYS
from tramline.sources.store import materialise, shared_folder
from tramline.streaming import changes

VIEWS = {
    "fx_routes": """
SELECT 'R' || n_nationkey AS route_id,
       CASE WHEN n_nationkey = 12 THEN '2' ELSE '1' END AS route_type,
       CASE WHEN n_nationkey % 7 = 3 THEN '' ELSE 'L' || (n_nationkey % 9) END AS route_short_name,
       n_name AS route_long_name,
       CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE '00' || lpad(CAST((n_nationkey * 4177) % 9999 AS STRING), 4, '0') END AS route_color,
       CASE WHEN n_nationkey % 4 = 0 THEN ' ' ELSE 'FFFFFF' END AS route_text_color
FROM nation""",
    "fx_stops": """
SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'ST' || s_suppkey ELSE 'ST' || (s_suppkey - s_suppkey % 5) || 'P' || (s_suppkey % 5) END AS stop_id,
       CASE WHEN s_suppkey % 29 = 28 THEN '' ELSE s_name END AS stop_name,
       CASE WHEN s_suppkey % 5 = 0 THEN ''
            WHEN s_suppkey % 23 = 4 THEN 'ST999999'
            WHEN s_suppkey % 31 = 6 THEN 'ST' || (s_suppkey - s_suppkey % 5) || 'P' || (s_suppkey % 5)
            ELSE 'ST' || (s_suppkey - s_suppkey % 5) END AS parent_station,
       CASE WHEN s_suppkey % 5 = 0 THEN '1' ELSE '' END AS location_type,
       CASE WHEN s_suppkey % 37 = 36 THEN '0' WHEN s_suppkey % 41 = 40 THEN 'x'
            ELSE '-73.' || CAST(800000 + (s_suppkey * 7919) % 190000 AS STRING) END AS stop_lon,
       CASE WHEN s_suppkey % 43 = 42 THEN '' ELSE '40.' || CAST(600000 + (s_suppkey * 104729) % 300000 AS STRING) END AS stop_lat
FROM supplier""",
    "fx_shape_points": """
SELECT 'SH' || rt || 'D' || dir || 'V' || var AS shape_id,
       CAST(seq AS STRING) AS shape_pt_sequence,
       '-73.' || CAST(970000 - rt * 7000 - ((vs * 31) % 7) * 300 AS STRING) AS shape_pt_lon,
       '40.' || CAST(550000 + vs * 1700 + ((vs * 31) % 7) * 100 AS STRING) AS shape_pt_lat
FROM (SELECT rt, dir, var, seq, CASE WHEN seq % 11 = 10 THEN seq - 1 ELSE seq END AS vs
      FROM (SELECT (p_partkey % 96) % 24 AS rt,
                   CAST(((p_partkey % 48) - (p_partkey % 24)) / 24 AS BIGINT) AS dir,
                   CAST(((p_partkey % 96) - (p_partkey % 48)) / 48 AS BIGINT) AS var,
                   CAST((p_partkey - p_partkey % 96) / 96 AS BIGINT) AS seq
            FROM part) a) b""",
    "fx_trips": """
SELECT 'T' || o_orderkey || '-' || substring(o_orderpriority, 1, 1) || '_' || lpad(CAST(o_orderkey - o_orderkey % 3 AS STRING), 6, '0') || '_X' AS trip_id,
       'R' || (o_custkey % 26) AS route_id,
       CASE WHEN o_orderkey % 97 = 96 THEN '' ELSE o_orderpriority END AS service_id,
       CASE WHEN o_orderkey % 19 = 18 THEN '' ELSE 'SH' || (o_custkey % 26) || 'D' || (o_orderkey % 2) || 'V' || (o_custkey % 2) END AS shape_id,
       CASE WHEN o_orderkey % 61 = 60 THEN '' ELSE CAST(o_orderkey % 2 AS STRING) END AS direction_id
FROM orders""",
    "fx_stop_times": """
SELECT 'T' || o_orderkey || '-' || substring(o_orderpriority, 1, 1) || '_' || lpad(CAST(o_orderkey - o_orderkey % 3 AS STRING), 6, '0') || '_X' AS trip_id,
       CASE WHEN l_partkey % 211 = 210 THEN 'x' ELSE CAST(l_linenumber AS STRING) END AS stop_sequence,
       CASE WHEN l_suppkey % 5 = 0 THEN 'ST' || l_suppkey ELSE 'ST' || (l_suppkey - l_suppkey % 5) || 'P' || (l_suppkey % 5) END AS stop_id,
       CASE WHEN l_partkey % 101 = 100 THEN '7:1:2' ELSE
         lpad(CAST(CAST((s - s % 3600) / 3600 AS BIGINT) AS STRING), 2, '0') || ':' ||
         lpad(CAST(CAST((s % 3600 - s % 60) / 60 AS BIGINT) AS STRING), 2, '0') || ':' || lpad(CAST(s % 60 AS STRING), 2, '0') END AS arrival_time,
       CASE WHEN l_partkey % 103 = 102 THEN '' ELSE
         lpad(CAST(CAST((s - s % 3600) / 3600 AS BIGINT) AS STRING), 2, '0') || ':' ||
         lpad(CAST(CAST((s % 3600 - s % 60) / 60 AS BIGINT) AS STRING), 2, '0') || ':' || lpad(CAST(s % 60 AS STRING), 2, '0') END AS departure_time,
       l_partkey AS tb1, l_extendedprice AS tb2, l_shipdate AS tb3
FROM (SELECT l.*, o.*, (l_partkey * 523 + l_linenumber * 211 + l_suppkey * 13) % 104400 AS s
      FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey) j""",
    "fx_observations": """
SELECT (extract(DAY FROM ts) - 1) * 2 + CASE WHEN extract(HOUR FROM ts) >= 12 THEN 1 ELSE 0 END AS poll_seq,
       event_id AS ordinal,
       'feed' || (user_id % 8) AS feed,
       CASE WHEN event_id % 71 = 70 THEN '' ELSE lpad(CAST(user_id * 3 AS STRING), 6, '0') || '_X' END AS trip_id,
       CASE WHEN event_id % 53 = 52 THEN 'bad' ELSE '20240101' END AS start_date,
       CASE WHEN event_id % 67 = 66 THEN '' ELSE 'R' || (user_id % 26) END AS route_id,
       CASE WHEN event_id % 59 = 58 THEN ''
            WHEN (user_id + event_id % 3) % 10 % 5 = 0 THEN 'ST' || ((user_id + event_id % 3) % 10)
            ELSE 'ST' || ((user_id + event_id % 3) % 10 - (user_id + event_id % 3) % 5) || 'P' || ((user_id + event_id % 3) % 5) END AS stop_id,
       CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 1 WHEN 'error' THEN 0 WHEN 'view' THEN 2 ELSE 7 END AS status_code,
       ts AS feed_ts
FROM events""",
}

# Which of several stop times with one key comes first; the views have no file order.
ORDER = {"stop_times": ["tb1", "stop_id", "tb2", "tb3"]}


# The base tables of each view.
BASE = {
    "fx_routes": ["nation"],
    "fx_stops": ["supplier"],
    "fx_shape_points": ["part"],
    "fx_trips": ["orders"],
    "fx_stop_times": ["lineitem", "orders"],
    "fx_observations": ["events"],
}
_VIEWS: dict[tuple[str, str, str], DataFrame] = {}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views as a DataFrame; its plan is kept for the Spark application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _VIEWS:
        for table in BASE[name]:
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
        _VIEWS[key] = spark.sql(VIEWS[name])
    return _VIEWS[key]


def raw(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The five feed tables, all text."""
    names = {"routes": "fx_routes", "stops": "fx_stops", "shapes": "fx_shape_points", "trips": "fx_trips", "stop_times": "fx_stop_times"}
    return {table: view(spark, sf_dir, name) for table, name in names.items()}


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed realtime records: a poll ends every 12 hours, some records carry no feed time."""
    stamp = F.col("feed_ts").cast("timestamp")
    seq = F.col("poll_seq").cast("long")
    return view(spark, sf_dir, "fx_observations").select(
        "feed", seq.alias("poll_seq"),
        F.timestamp_seconds(F.lit(1704067200) + (seq + 1) * 43200).alias("poll_ts"),
        "ordinal", "trip_id", "start_date", "route_id", "stop_id", F.col("status_code").cast("int").alias("status_code"),
        F.when(F.col("ordinal") % 73 == 72, 0).otherwise(F.unix_seconds(stamp)).cast("long").alias("feed_epoch"),
    )


class Tables(dict):
    """The loaded tables, each built and written when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir
        self._feed = load.Cleaned(raw(spark, sf_dir), ORDER, stage=materialise)

    def judged(self) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
        """Valid rows and log of every feed table; the judged rows are written when first asked for."""
        staged = {table: self._feed[table] for table in load.TABLES}
        return staged, {table: self._feed.logs[table] for table in load.TABLES}

    def feed(self) -> dict[str, DataFrame]:
        """The cleaned feed tables."""
        return load.collapse(self.judged()[0], ORDER)

    def _build(self, name: str) -> DataFrame:
        if name in load.TABLES:
            return load.collapse_table(self._feed, name, ORDER)
        if name == "segments":
            return segments(self["shapes"])
        if name == "shape_stop_positions":
            return shape_stop_positions(self["stop_times"], self["trips"], self["stops"], self["segments"])
        if name == "scheduled_headway":
            return scheduled(self["stop_times"], self["trips"])
        if name == "changes":
            return changes.changes(changes.normalize(snapshots(self.spark, self.sf_dir)))
        if name == "vehicle_positions":
            return changes.positions(self["changes"])
        if name == "extents":
            return extents(self["segments"])
        if name == "stop_routes":
            return stop_routes(self["stop_times"], self["trips"])
        if name == "route_shapes":
            return route_shapes(self["trips"])
        if name == "halts":
            return last_halts(self["vehicle_positions"])
        if name == "stop_events":
            return insert_if_absent(None, changes.arrivals(self["changes"]), KEYS["stop_events"], changes.ORDER)
        raise KeyError(name)

    def __missing__(self, name: str) -> DataFrame:
        # Judged stop times are written already, with a mark on those that stay.
        df = self._build(name)
        self[name] = df if name == "stop_times" else materialise(df, name)
        return self[name]

    def __contains__(self, name) -> bool:
        return name in [
            *load.TABLES, "segments", "shape_stop_positions", "scheduled_headway", "vehicle_positions", "stop_events", "halts",
            "extents", "stop_routes", "route_shapes",
        ]


_TABLES: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The loaded tables of a data folder, shared by the queries of one Spark application."""
    shared_folder(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TABLES:
        _TABLES[key] = Tables(spark, sf_dir)
    return _TABLES[key]
