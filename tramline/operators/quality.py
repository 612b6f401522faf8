"""Row validation and repair with an account of every skipped or repaired row.

Each ``clean_*`` returns ``(good, log)``. A row is skipped by the first rule it
breaks; repairs keep the row, and several can hit one row. ``log`` has one row
per skip or repair: ``table, kind, reason, example, ord``; reasons are codes, some with a
field or value behind a colon. ``keep`` names extra
input columns to carry through, such as those giving the file order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions import geo
from tramline.functions.scalars import (
    blank_to_null, clock_seconds, lenient_double, lenient_int, lenient_smallint, location_type,
)
from tramline.operators.ordered import first_per_key, numbered, plain, ranged, with_previous
from tramline.schemas import BBOX, FEED_FILES, ROUTE_TYPES

EXAMPLES = 3
Stage = Callable[[DataFrame, str], DataFrame]


def normalise(raw: DataFrame, table: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The table's fields trimmed, blanks as NULL, absent columns as NULL; ``ord`` defaults to 0."""
    fields = [
        (blank_to_null(F.col(name)) if name in raw.columns else F.lit(None).cast("string")).alias(name)
        for name in FEED_FILES[table].names
    ]
    order = F.col("ord").cast("long") if "ord" in raw.columns else F.lit(0).cast("long")
    return raw.select(*fields, order.alias("ord"), *keep)


@dataclass(frozen=True)
class Rule:
    """A condition that skips or repairs a row, with the texts for the log."""

    broken: Column
    reason: Column | str
    example: Column


@dataclass(frozen=True)
class Judged:
    """Rows with ``_rule``, the number of the first broken skip rule, and ``_fixes``, those
    of all repairs made. Only these numbers are worked out per row; reasons and examples
    are put together for the rows that reach the log."""

    df: DataFrame
    table: str
    skips: tuple[Rule, ...]
    repairs: tuple[Rule, ...] = ()

    def staged(self, stage: Stage | None) -> Judged:
        """The same with its rows written out, so that tables and logs share one evaluation."""
        return self if stage is None else replace(self, df=stage(self.df, f"judged_{self.table}"))

    @property
    def good(self) -> DataFrame:
        return self.df.where("_rule is null")

    @property
    def log(self) -> DataFrame:
        """One row per skip or repair; a skipped row is not repaired."""
        codes = F.when(F.col("_rule").isNotNull(), F.array("_rule"))
        codes = codes.otherwise(F.col("_fixes")) if self.repairs else codes
        rules = (*self.skips, *self.repairs)
        text = lambda c: F.lit(c) if isinstance(c, str) else c

        def pick(values: list[Column]) -> Column:
            chain = F.when(F.col("_code") == 0, values[0])
            for number, value in enumerate(values[1:], start=1):
                chain = chain.when(F.col("_code") == number, value)
            return chain

        return self.df.withColumn("_code", F.explode(codes)).select(
            F.lit(self.table).alias("table"),
            F.when(F.col("_code") < len(self.skips), "skipped").otherwise("repaired").alias("kind"),
            pick([text(rule.reason) for rule in rules]).alias("reason"),
            pick([rule.example.cast("string") for rule in rules]).alias("example"),
            "ord",
        )


def judge(df: DataFrame, table: str, skips: list[Rule], repairs: list[Rule] = ()) -> Judged:
    chain = F.when(skips[0].broken, F.lit(0)) if skips else F.lit(None).cast("int")
    for number, rule in enumerate(skips[1:], start=1):
        chain = chain.when(rule.broken, F.lit(number))
    df = df.withColumn("_rule", chain)
    if repairs:
        flags = [F.when(rule.broken, F.lit(len(skips) + at)) for at, rule in enumerate(repairs)]
        df = df.withColumn("_fixes", F.array_compact(F.array(*flags)))
    # Parsed columns and rule numbers pass through a generator, because Spark would otherwise
    # copy all the parsing into every filter on them and run it again there.
    return Judged(df.select(F.inline(F.array(F.struct("*")))), table, tuple(skips), tuple(repairs))


def _missing(field: str, example: Column | None = None) -> Rule:
    example = F.lit(None).cast("string") if example is None else example
    return Rule(F.col(field).isNull(), f"required:{field}", example)


def _coordinate_rules(lon_raw: str, lat_raw: str, box, example: Column) -> list[Rule]:
    """Absent, text, outside the box: the first that holds."""
    lon, lat = F.col("lon"), F.col("lat")
    told = lambda code, a, b: F.concat(F.lit(f"{code}:"), a.cast("string"), F.lit(","), b.cast("string"))
    return [
        Rule(F.col(lon_raw).isNull() | F.col(lat_raw).isNull(), "no_position", example),
        Rule(lon.isNull() | lat.isNull(), told("position_text", F.col(lat_raw), F.col(lon_raw)), example),
        Rule(~geo.in_box(lon, lat, box), told("position_outside", lat, lon), example),
    ]


def judge_routes(raw: DataFrame, route_types=ROUTE_TYPES, keep=()) -> Judged:
    df = normalise(raw, "routes", keep).withColumn("kind", lenient_int(F.col("route_type")))
    wanted = F.coalesce(F.col("kind").isin(list(route_types)), F.lit(False))
    type_text = F.coalesce(F.col("kind").cast("string"), F.lit("none"))
    return judge(
        df, "routes",
        [
            _missing("route_id"),
            Rule(~wanted, F.concat(F.lit("unwanted_route_type:"), type_text), F.col("route_id")),
        ],
        [Rule(F.col("route_short_name").isNull(), "name_from_id", F.col("route_id"))],
    )


def clean_routes(raw: DataFrame, route_types=ROUTE_TYPES, keep=(), stage: Stage | None = None) -> tuple[DataFrame, DataFrame]:
    judged = judge_routes(raw, route_types, keep).staged(stage)
    good = judged.good.select(
        "route_id", F.coalesce("route_short_name", "route_id").alias("route_short_name"),
        "route_long_name", "route_color", "route_text_color", "ord", *keep,
    )
    return good, judged.log


def judge_stops(raw: DataFrame, bbox=BBOX, keep=()) -> Judged:
    """Skips only; parents are judged against the survivors in ``judge_parents``."""
    stop = F.col("stop_id")
    df = (
        normalise(raw, "stops", keep)
        .withColumn("lon", lenient_double(F.col("stop_lon")))
        .withColumn("lat", lenient_double(F.col("stop_lat")))
        .withColumn("location_type", location_type(F.col("location_type")))
    )
    return judge(df, "stops", [
        _missing("stop_id"),
        _missing("stop_name", stop),
        *_coordinate_rules("stop_lon", "stop_lat", bbox, stop),
    ])


def judge_parents(survivors: DataFrame) -> Judged:
    """Parents that did not survive, or are the stop itself; ``parent_kept`` is what stays."""
    parent, stop = F.col("parent_station"), F.col("stop_id")
    known = survivors.select(F.col("stop_id").alias("parent_station")).distinct().withColumn("_known", F.lit(True))
    dangling = parent.isNotNull() & F.col("_known").isNull()
    own = F.coalesce(parent == stop, F.lit(False)) & ~dangling
    df = survivors.drop("_rule").join(known, "parent_station", "left").withColumn(
        "parent_kept", F.when(~dangling & ~own, parent)
    )
    return judge(df, "stops", [], [
        Rule(dangling, "unknown_parent", F.concat(stop, F.lit("->"), parent)),
        Rule(own, "parent_of_itself", stop),
    ])


def clean_stops(raw: DataFrame, bbox=BBOX, keep=(), stage: Stage | None = None) -> tuple[DataFrame, DataFrame]:
    judged = judge_stops(raw, bbox, keep).staged(stage)
    repaired = judge_parents(judged.good)
    good = repaired.df.select(
        "stop_id", "stop_name", F.col("parent_kept").alias("parent_station"), "location_type", "lon", "lat", "ord", *keep
    )
    return good, judged.log.unionByName(repaired.log)


def judge_points(raw: DataFrame, bbox=BBOX) -> Judged:
    shape = F.col("shape_id")
    df = (
        normalise(raw, "shapes")
        .withColumn("seq", lenient_int(F.col("shape_pt_sequence")))
        .withColumn("lon", lenient_double(F.col("shape_pt_lon")))
        .withColumn("lat", lenient_double(F.col("shape_pt_lat")))
    )
    return judge(df, "shapes", [
        _missing("shape_id"),
        Rule(F.col("seq").isNull(), "no_order:shape_pt_sequence", shape),
        *_coordinate_rules("shape_pt_lon", "shape_pt_lat", bbox, shape),
    ])


def drawable_shapes(points: DataFrame) -> DataFrame:
    """``shape_id, drawable``: a line needs two different points. No ordering involved,
    so this is one aggregation with map-side combine."""
    spread = (F.min("lon") < F.max("lon")) | (F.min("lat") < F.max("lat"))
    return points.groupBy("shape_id").agg(spread.alias("drawable"), F.min("ord").alias("ord"))


def dedupe_vertices(points: DataFrame) -> DataFrame:
    """Drop vertices equal to the one before them in (seq, ord) order."""
    rows = with_previous(ranged(points, ["shape_id"], ["seq", "ord"]), ["shape_id"], ["lon", "lat"])
    before = F.col("previous")
    fresh = before.isNull() | (before["lon"] != F.col("lon")) | (before["lat"] != F.col("lat"))
    return plain(rows.where(fresh).drop("previous"))


def clean_shapes(raw: DataFrame, bbox=BBOX, stage: Stage | None = None) -> tuple[DataFrame, DataFrame]:
    """Shapes as one row per vertex (``shape_id, seq, ord, lon, lat``), so that no line
    has to fit one row."""
    judged = judge_points(raw, bbox).staged(stage)
    points = judged.good.select("shape_id", "seq", "ord", "lon", "lat")
    lines = drawable_shapes(points)
    short = judge(lines, "shapes", [Rule(~F.col("drawable"), "line_of_one_place", F.col("shape_id"))])
    vertices = dedupe_vertices(points.join(lines.where("drawable").select("shape_id"), "shape_id", "left_semi"))
    return vertices, judged.log.unionByName(short.log)


def _marked(ids: DataFrame, key: str, mark: str) -> DataFrame:
    """Distinct ids with a marker column, the right side of a membership test."""
    return ids.select(key).distinct().withColumn(mark, F.lit(True))


def judge_trips(raw: DataFrame, routes: DataFrame, shapes: DataFrame, keep=()) -> Judged:
    """``shape_kept`` is the shape if it is loaded."""
    trip, route, shape = F.col("trip_id"), F.col("route_id"), F.col("shape_id")
    with_id = lambda c: F.concat(trip, F.lit(" ("), F.coalesce(c, F.lit("none")), F.lit(")"))
    lost = shape.isNotNull() & F.col("_shape").isNull()
    df = (
        normalise(raw, "trips", keep)
        .join(_marked(routes, "route_id", "_route"), "route_id", "left")
        .join(_marked(shapes, "shape_id", "_shape"), "shape_id", "left")
        .withColumn("shape_kept", F.when(~lost, shape))
        .withColumn("direction_id", lenient_smallint(F.col("direction_id")))
    )
    return judge(
        df, "trips",
        [
            _missing("trip_id"),
            Rule(F.col("_route").isNull(), "unknown_route", with_id(route)),
            _missing("service_id", trip),
        ],
        [Rule(lost, "unknown_shape", with_id(shape))],
    )


def clean_trips(
    raw: DataFrame, routes: DataFrame, shapes: DataFrame, keep=(), stage: Stage | None = None
) -> tuple[DataFrame, DataFrame]:
    judged = judge_trips(raw, routes, shapes, keep).staged(stage)
    good = judged.good.select(
        "trip_id", "route_id", "service_id", F.col("shape_kept").alias("shape_id"), "direction_id", "ord", *keep
    )
    return good, judged.log


def judge_stop_times(
    raw: DataFrame, trips: DataFrame, stops: DataFrame, keep=(), texts: bool = True, first: list[str] | None = None
) -> Judged:
    """Fields are parsed before the joins, so that texts which nobody asks for are not shuffled.
    Without ``texts`` only those of malformed times are kept: what the table and the log need.
    With ``first``, the columns that decide which of several rows with one key stays, valid rows
    have ``_first`` instead of ``keep``: whether it is this one. Rows that met their trip by a shuffle
    are still together there, so that the order within a key costs no further one."""
    trip, stop = F.col("trip_id"), F.col("stop_id")
    shown = lambda c: F.coalesce(c, F.lit("none"))
    parsed = normalise(raw, "stop_times", keep).withColumns({
        "seq": lenient_int(F.col("stop_sequence")),
        "arrival_sec": clock_seconds(F.col("arrival_time")),
        "departure_sec": clock_seconds(F.col("departure_time")),
    })
    if not texts:
        parsed = parsed.drop("stop_sequence").withColumns({
            "arrival_time": F.when(F.col("arrival_sec").isNull(), F.col("arrival_time")),
            "departure_time": F.when(F.col("departure_sec").isNull(), F.col("departure_time")),
        })
    df = parsed.join(_marked(stops, "stop_id", "_stop"), "stop_id", "left").join(
        _marked(trips, "trip_id", "_trip"), "trip_id", "left"
    )
    if first is not None:
        order = [F.col("seq" if c == "stop_sequence" else c).asc_nulls_last() for c in first]
        # The valid rows of a key are those with both marks: they have a group of their own.
        place = F.row_number().over(Window.partitionBy("trip_id", "seq", "_stop", "_trip").orderBy(*order))
        df = df.withColumn("_first", place == 1).drop(*keep)

    def malformed(field: str, parsed: str) -> Rule:
        broken = F.col(field).isNotNull() & F.col(parsed).isNull()
        return Rule(broken, f"bad_clock:{field}", F.concat(shown(trip), F.lit(" "), F.col(field)))

    return judge(
        df, "stop_times",
        [
            Rule(F.col("_trip").isNull(), "unknown_trip", shown(trip)),
            Rule(F.col("_stop").isNull(), "unknown_stop", shown(stop)),
            Rule(F.col("seq").isNull(), "no_order:stop_sequence", trip),
        ],
        [malformed("arrival_time", "arrival_sec"), malformed("departure_time", "departure_sec")],
    )


def clean_stop_times(
    raw: DataFrame, trips: DataFrame, stops: DataFrame, keep=(), stage: Stage | None = None, first: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """With ``first`` as in ``judge_stop_times``, its ``_first`` stands in place of ``keep``."""
    judged = judge_stop_times(raw, trips, stops, keep, texts=False, first=first).staged(stage)
    good = judged.good.select(
        "trip_id", F.col("seq").alias("stop_sequence"), "stop_id", "arrival_sec", "departure_sec", "ord",
        *(keep if first is None else ["_first"]),
    )
    return good, judged.log


def dedupe(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by ``order``."""
    return first_per_key(df, keys, [F.col(c).asc_nulls_last() for c in order])


def surplus_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that repeat a key: ``staged, kept, duplicates``."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"))
    staged, kept = F.coalesce(F.sum("n"), F.lit(0)), F.count("*")
    return per_key.agg(staged.alias("staged"), kept.alias("kept"), (staged - kept).alias("duplicates"))


def duplicate_log(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """Log rows for the copies that ``dedupe`` drops; ``rows`` carries how many a key lost.

    A key yields no more log rows than the ledger shows examples.
    """
    first, second = keys
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"), F.min("ord").alias("ord")).where("n > 1")
    shown = F.sequence(F.lit(1).cast("long"), F.least(F.col("n") - 1, F.lit(EXAMPLES)))
    return per_key.withColumn("_at", F.explode(shown)).select(
        F.lit(table).alias("table"),
        F.lit("skipped").alias("kind"),
        F.lit(f"repeated_key:{','.join(keys)}").alias("reason"),
        F.concat(F.col(first).cast("string"), F.lit(" #"), F.col(second).cast("string")).alias("example"),
        "ord",
        F.when(F.col("_at") == 1, F.col("n") - 1).otherwise(0).alias("rows"),
    )


def reentry_log(df: DataFrame, table: str, key: str) -> DataFrame:
    """Log rows for keys whose rows start again after another key's, by file order (``ord``).

    Nothing is repaired: later steps sort. Rows are numbered densely in their order of ``ord``,
    those of one ``ord`` by key, skipped rows left out; without a file order (all ``ord`` equal)
    there is none to judge, and rows without one would all meet in one task.
    """
    span = df.agg(F.min("ord").alias("low"), F.max("ord").alias("high")).first()
    rows = df.select(key, "ord").where(F.lit(span["low"] is not None and span["low"] < span["high"]))
    numbers = numbered(rows, [F.col("ord"), F.col(key)], "_at")
    apart = noncontiguous(numbers, key, "_at").join(numbers.groupBy(key).agg(F.min("ord").alias("ord"), F.max("ord").alias("_last")), key)
    ordered_file = F.col("ord") < F.col("_last")
    return apart.where(ordered_file).select(
        F.lit(table).alias("table"), F.lit("repaired").alias("kind"), F.lit(f"scattered:{key}").alias("reason"),
        F.col(key).cast("string").alias("example"), "ord", F.col("reentries").alias("rows"),
    )


def noncontiguous(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """``key, reentries``: how often a key's rows start again after another key's rows.

    ``ordinal`` numbers the rows without gaps. A row starts a block when the row just
    before it does not carry the same key; that is an anti join on (key, ordinal), which
    spreads a long key over all tasks.
    """
    rows = df.select(key, ordinal)
    starts = rows.join(rows.select(key, (F.col(ordinal) + 1).alias(ordinal)), [key, ordinal], "left_anti")
    return (
        starts.groupBy(key).agg((F.count("*") - 1).alias("reentries")).where("reentries > 0")
    )


def log_rows(*logs: DataFrame) -> DataFrame:
    """Logs below each other, with ``rows``: how many rows a log row stands for."""
    return reduce(
        DataFrame.unionByName,
        (part if "rows" in part.columns else part.withColumn("rows", F.lit(1).cast("long")) for part in logs),
    )


def ledger(*logs: DataFrame) -> DataFrame:
    """``table, kind, reason, n, examples``: counts per reason and the first three examples.

    Both halves combine on the map side: counts by aggregation, examples by a rank
    filter that Spark pushes below the shuffle.
    """
    keys = ["table", "kind", "reason"]
    log = log_rows(*logs)
    counts = log.groupBy(*keys).agg(F.sum("rows").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("ord", "example"))
    examples = (
        log.where("example is not null")
        .withColumn("_rank", rank)
        .where(F.col("_rank") <= EXAMPLES)
        .groupBy(*keys)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "example"))), lambda e: e["example"]).alias("examples"))
    )
    return counts.join(examples, keys, "left").withColumn(
        "examples", F.coalesce("examples", F.array().cast("array<string>"))
    )
