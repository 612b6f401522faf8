"""The static load: clean a feed, refresh the tables, report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions.scalars import rt_trip_id
from tramline.operators import quality
from tramline.operators.lines import extents, segments
from tramline.operators.tables import pruned, prune_orphans, upsert
from tramline.plans.headway import scheduled
from tramline.plans.positions import shape_stop_positions
from tramline.plans.views import route_shapes, stop_routes
from tramline.schemas import BBOX, KEYS, ROUTE_TYPES
from tramline.sources.store import commit_versions, materialise, read_versions, scratch, stage_version

TABLES = ["routes", "stops", "shapes", "trips", "stop_times"]


def clean(
    raw: dict, order: dict[str, list[str]] | None = None, route_types=ROUTE_TYPES, bbox=BBOX,
    stage: quality.Stage | None = None,
) -> tuple[dict, dict]:
    """``(staged, logs)`` of the five feed tables: valid rows before duplicate keys collapse.

    ``order`` names columns that decide, per table, which of several rows with one key
    is the first; default: file order. ``stage`` writes the judged rows of a table and
    reads them back; without it they are worked out again for every use. Staged stop times
    are marked: ``_first`` holds for the row of a key that stays by ``order``.
    """
    feed = Cleaned(raw, order, route_types, bbox, stage)
    for table in TABLES:
        feed[table]
    return dict(feed), {table: feed.logs[table] for table in TABLES}


class Cleaned(dict):
    """The valid rows of each feed table, worked out (and staged) when first asked for, with those
    tables it refers to; ``logs`` holds the logs of the tables asked for so far."""

    def __init__(self, raw: dict, order=None, route_types=ROUTE_TYPES, bbox=BBOX, stage: quality.Stage | None = None):
        super().__init__()
        self.raw, self.order, self.route_types, self.bbox, self.stage = raw, order or {}, route_types, bbox, stage
        self.keep = {table: tuple(c for c in (order or {}).get(table, []) if c not in _OWN[table]) for table in TABLES}
        self.logs: dict[str, DataFrame] = {}
        self._ids: dict[str, DataFrame] = {}

    def ids(self, table: str, key: str) -> DataFrame:
        """The distinct ids of a table, staged: its size is known when a reference to it is planned."""
        if table not in self._ids:
            ids = self[table].select(key).distinct()
            self._ids[table] = ids if self.stage is None else self.stage(ids, f"ids_{table}")
        return self._ids[table]

    def __missing__(self, table: str) -> DataFrame:
        self[table], self.logs[table] = self._clean(table)
        return self[table]

    def _clean(self, table: str) -> tuple[DataFrame, DataFrame]:
        raw, keep, stage = self.raw[table], self.keep[table], self.stage
        if table == "routes":
            return quality.clean_routes(raw, self.route_types, keep, stage)
        if table == "stops":
            return quality.clean_stops(raw, self.bbox, keep, stage)
        if table == "shapes":
            vertices, log = quality.clean_shapes(raw, self.bbox, stage=stage)
            return (vertices if stage is None else stage(vertices, "shapes")), log
        if table == "trips":
            # A line is loaded if any of its vertices is.
            return quality.clean_trips(raw, self.ids("routes", "route_id"), self.ids("shapes", "shape_id"), keep, stage)
        if table == "stop_times":
            first = None if stage is None else self.order.get(table, ["ord"])
            return quality.clean_stop_times(raw, self.ids("trips", "trip_id"), self.ids("stops", "stop_id"), keep, stage, first)
        raise KeyError(table)


_OWN = {
    "routes": {"route_id", "ord"},
    "stops": {"stop_id", "ord"},
    "shapes": {"shape_id", "seq", "ord"},
    "trips": {"trip_id", "ord"},
    "stop_times": {"trip_id", "stop_sequence", "stop_id", "ord"},
}
COLUMNS = {
    "routes": ["route_id", "route_short_name", "route_long_name", "route_color", "route_text_color"],
    "stops": ["stop_id", "stop_name", "parent_station", "location_type", "lon", "lat"],
    "shapes": ["shape_id", "seq", "ord", "lon", "lat"],
    "trips": ["trip_id", "route_id", "service_id", "shape_id", "direction_id", "rt_trip_id"],
    "stop_times": ["trip_id", "stop_sequence", "stop_id", "arrival_sec", "departure_sec"],
}


def collapse(staged: dict, order: dict[str, list[str]] | None = None) -> dict:
    """The tables with one row per key. Vertices are unique by construction."""
    return {table: collapse_table(staged, table, order) for table in TABLES}


def collapse_table(staged: dict, table: str, order: dict[str, list[str]] | None = None) -> DataFrame:
    """One of the tables of ``collapse``; needs no other. Rows that carry ``_first`` are judged already."""
    df = staged[table]
    if table == "trips":
        df = df.withColumn("rt_trip_id", rt_trip_id(F.col("trip_id")))
    if "_first" in df.columns:
        df = df.where("_first")
    elif table != "shapes":
        df = quality.dedupe(df, KEYS[table], (order or {}).get(table, ["ord"]))
    return df.select(*COLUMNS[table])


def derive(tables: dict) -> dict:
    """The tables computed from the feed tables."""
    segs = segments(tables["shapes"])
    return {
        "segments": segs,
        "shape_stop_positions": shape_stop_positions(tables["stop_times"], tables["trips"], tables["stops"], segs),
        "scheduled_headway": scheduled(tables["stop_times"], tables["trips"]),
    }


def report(staged: dict, logs: dict, removed: dict[str, DataFrame] | None = None) -> DataFrame:
    """``table, loaded, duplicates, skipped, pruned`` per table of ``removed`` or of the feed.

    Every figure is a row of (table, what, n); they are added up per table at the end.
    """

    def figure(df: DataFrame, table: str, what: str) -> DataFrame:
        return df.select(F.lit(table).alias("table"), F.lit(what).alias("what"), F.col(df.columns[0]).alias("n"))

    rows = []
    for table in TABLES:
        if table == "shapes":
            rows.append(figure(staged[table].agg(F.count_distinct("shape_id").alias("n")), table, "loaded"))
        else:
            counts = quality.surplus_count(staged[table], KEYS[table])
            rows.append(counts.select(F.lit(table).alias("table"), F.inline(F.array(
                F.struct(F.lit("loaded").alias("what"), F.col("kept").alias("n")),
                F.struct(F.lit("duplicates").alias("what"), F.col("duplicates").alias("n")),
            ))))
        rows.append(figure(logs[table].where("kind = 'skipped'").agg(F.count("*").alias("n")), table, "skipped"))
    for table, gone in (removed or {}).items():
        rows.append(figure(gone.agg(F.count("*").alias("n")), table, "pruned"))
    amount = lambda what: F.coalesce(F.sum(F.when(F.col("what") == what, F.col("n"))), F.lit(0)).alias(what)
    return reduce(DataFrame.unionByName, rows).groupBy("table").agg(
        *(amount(what) for what in ("loaded", "duplicates", "skipped", "pruned"))
    )


def ledger(staged: dict, logs: dict, reentries: bool = True) -> DataFrame:
    """The accounts of a load: skips, repairs, repeated stop times and, with ``reentries``, trips
    whose stop times start again after another trip's. The log rows are gathered and written
    first, in one pass over the judged tables."""
    parts = [*logs.values(), quality.duplicate_log(staged["stop_times"], "stop_times", KEYS["stop_times"])]
    if reentries:
        parts.append(quality.reentry_log(staged["stop_times"], "stop_times", "trip_id"))
    return quality.ledger(materialise(quality.log_rows(*parts), "log"))


def refresh(
    spark: SparkSession, raw: dict, root: str, mode: str = "upsert", keep_absent: bool = False,
    order: dict[str, list[str]] | None = None,
) -> dict[str, DataFrame]:
    """Load a feed into versioned tables under ``root`` and return ``report`` and ``ledger``
    (repeated and scattered stop times included, most common reasons first).

    ``upsert`` merges into the current tables and, unless ``keep_absent``, drops rows the
    feed no longer has. ``replace`` does the same for the small tables and overwrites
    stop_times, also with ``keep_absent``. All tables, stop positions that lost their line or
    stop included, become current by one commit once they are fully written: a failure before
    leaves the old set, and of two refreshes at once the later commit raises
    ``manifest.Conflict``. ``store.remove_versions`` removes what no recent commit names.
    """
    if mode not in ("upsert", "replace"):
        raise ValueError(f"unknown refresh mode {mode!r}")
    order = order or {}
    with scratch():
        base, current = read_versions(spark, root)
        staged, logs = clean(raw, order, stage=materialise)
        removed, versions, loaded = {}, {}, {}
        collapsed = collapse(staged, order)
        for table, df in collapsed.items():
            old, merged = current.get(table), keep_absent and not (mode == "replace" and table == "stop_times")
            if old is not None and merged:
                # Written before it is merged, so that the feed is worked out once.
                loaded[table] = materialise(df, f"feed_{table}")
                versions[table] = stage_version(_merged(table, old, loaded[table]), root, table)
                continue
            # Upserting and then dropping what the feed lacks leaves the feed.
            versions[table] = stage_version(df, root, table)
            loaded[table] = spark.read.schema(df.schema).parquet(f"{root}/{table}/version={versions[table]}")
            if old is not None and not keep_absent:
                key = ["shape_id"] if table == "shapes" else KEYS[table]
                removed[table] = pruned(old.select(*key).distinct() if table == "shapes" else old, loaded[table], key)
        # The pairs that the served queries read: of the tables as they will be.
        after = {t: spark.read.schema(collapsed[t].schema).parquet(f"{root}/{t}/version={versions[t]}") for t in ("trips", "stop_times")}
        versions["stop_routes"] = stage_version(stop_routes(after["stop_times"], after["trips"]), root, "stop_routes")
        versions["route_shapes"] = stage_version(route_shapes(after["trips"]), root, "route_shapes")
        positions = current.get("shape_stop_positions")
        if positions is not None and not keep_absent:
            shapes = loaded["shapes"].select("shape_id").distinct()
            left = prune_orphans(positions, shapes, loaded["stops"])
            versions["shape_stop_positions"] = stage_version(left, root, "shape_stop_positions")
            left = spark.read.schema(left.schema).parquet(f"{root}/shape_stop_positions/version={versions['shape_stop_positions']}")
            removed["shape_stop_positions"] = pruned(positions, left, KEYS["shape_stop_positions"])
        result = {
            "report": report(staged, logs, removed),
            "ledger": ledger(staged, logs).orderBy(F.desc("n"), "table", "kind", "reason"),
        }
        # Worked out while the old versions are still the current ones.
        result = {name: df.checkpoint() for name, df in result.items()}
        commit_versions(spark, root, versions, base)
    return result


def _merged(table: str, old: DataFrame, feed: DataFrame) -> DataFrame:
    """``old`` with the feed's rows inserted or replacing; a line is replaced as a whole, since
    its vertices have no life of their own."""
    if table != "shapes":
        return upsert(old, feed, KEYS[table], KEYS[table])
    return old.join(feed.select("shape_id").distinct(), "shape_id", "left_anti").unionByName(feed)


def build_derived(spark: SparkSession, root: str) -> None:
    """Rebuild the computed tables from the current feed tables and commit them together."""
    with scratch():
        base, tables = read_versions(spark, root)
        versions = {"segments": stage_version(segments(tables["shapes"]), root, "segments")}
        segs = spark.read.parquet(f"{root}/segments/version={versions['segments']}")
        versions["extents"] = stage_version(extents(segs), root, "extents")
        spots = shape_stop_positions(tables["stop_times"], tables["trips"], tables["stops"], segs)
        versions["shape_stop_positions"] = stage_version(spots, root, "shape_stop_positions")
        headway = scheduled(tables["stop_times"], tables["trips"])
        versions["scheduled_headway"] = stage_version(headway, root, "scheduled_headway")
        commit_versions(spark, root, versions, base)


def read_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All current tables under ``root``, as one commit left them."""
    return read_versions(spark, root)[1]
