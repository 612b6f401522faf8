"""Line geometry on vertex rows: segments, length, linear referencing, simplification.

A line is a set of rows ``shape_id, seq, ord, lon, lat``; it never has to fit one
row or one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.functions import geo
from tramline.operators.ordered import PART, PLACE, plain, ranged, with_previous, with_running
from tramline.sources.store import materialise

ORDER = ["seq", "ord"]
BLOCK = 16  # consecutive segments per bounding box
LONG_LINE = 65_536  # segments from which a line is cut into pieces of as many sequence numbers
TILE_STOPS = 200_000  # about as many stops one task compares with a piece of a line
BIN_CHUNK = 65_536  # bins one row lists at a time
LOCAL_ROWS = 100_000  # vertices one task simplifies on its own


def segments(vertices: DataFrame) -> DataFrame:
    """One row per segment, at its end vertex.

    ``x1, y1, x2, y2``, planar ``len``, ``run`` (length before it), geodesic length ``nm``
    in whole nanometres, and per line the planar ``total`` and segment count ``n``.
    """
    key = ["shape_id"]
    rows = with_previous(ranged(vertices, key, ORDER), key, ["lon", "lat"]).where("previous is not null").select(
        *key, *ORDER, PART, PLACE,
        F.col("previous.lon").alias("x1"), F.col("previous.lat").alias("y1"),
        F.col("lon").alias("x2"), F.col("lat").alias("y2"),
    )
    ends = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    rows = geo.with_spheroid_m(rows.withColumn("len", geo.planar_length(*ends)), "_m", "x1", "y1", "x2", "y2")
    rows = rows.withColumn("nm", F.round(F.col("_m") * 1e9).cast("long")).drop("_m")
    return plain(with_running(rows, key, F.col("len"), "run", "total", "n"))


def length_m(segs: DataFrame) -> DataFrame:
    """``shape_id, meters, n``: geodesic length and segment count.

    Summed in whole nanometres: lines with the same segments get the same length in
    whatever order Spark adds them, so equal lengths stay equal.
    """
    return segs.groupBy("shape_id").agg((F.sum("nm") / 1e9).alias("meters"), F.count("*").alias("n"))


def summary(vertices: DataFrame) -> DataFrame:
    """``shape_id, vertices, valid``; a line is valid with two different vertices."""
    spread = (F.min("lon") < F.max("lon")) | (F.min("lat") < F.max("lat"))
    return vertices.groupBy("shape_id").agg(F.count("*").alias("vertices"), spread.alias("valid"))


def points_array(vertices: DataFrame) -> DataFrame:
    """``shape_id, points``: the line as one array, for output as one feature."""
    item = F.struct("seq", "ord", "lon", "lat")
    return vertices.groupBy("shape_id").agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda v: geo.point(v["lon"], v["lat"])).alias("points")
    )


def _near_pieces(pairs: DataFrame, pieces: DataFrame) -> DataFrame:
    """``pairs`` with the pieces of their line that can hold the nearest segment.

    A box farther away than some vertex of the line cannot. The slack covers rounding;
    it can only keep a box too many.
    """
    key = ["shape_id", "stop_id"]
    px, py, zero = F.col("lon"), F.col("lat"), F.lit(0.0)
    boxes = pieces.groupBy("shape_id", "_piece").agg(
        F.min(F.least("x1", "x2")).alias("_x0"), F.max(F.greatest("x1", "x2")).alias("_x1"),
        F.min(F.least("y1", "y2")).alias("_y0"), F.max(F.greatest("y1", "y2")).alias("_y1"),
        F.first("x1").alias("_ax"), F.first("y1").alias("_ay"),
    )
    near_x = F.greatest(F.col("_x0") - px, zero, px - F.col("_x1"))
    near_y = F.greatest(F.col("_y0") - py, zero, py - F.col("_y1"))
    far_x, far_y = px - F.col("_ax"), py - F.col("_ay")
    columns = [*key, "lon", "lat", "_piece"]
    candidates = pairs.join(boxes, "shape_id").select(
        *columns,
        (near_x * near_x + near_y * near_y).alias("_near"),
        (far_x * far_x + far_y * far_y).alias("_far"),
    )
    limit = candidates.groupBy(*key).agg(F.min("_far").alias("_limit"))
    return candidates.join(limit, key).where(F.col("_near") <= F.col("_limit") * (1 + 1e-9)).select(*columns)


_PLACE = "shape_id string, stop_id string, d double, seq int, ord long, along double"


def _nearest(px: np.ndarray, py: np.ndarray, ends: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each point the first of the nearest segments, its share and squared distance. Blocks of
    segments whose box is farther than the best segment of the nearest box are left out."""
    x1, y1, x2, y2 = ends
    blocks = -(-len(x1) // BLOCK)
    # The last block is filled with its last segment; the first of equal ones counts.
    member = np.minimum(np.arange(blocks * BLOCK).reshape(blocks, BLOCK), len(x1) - 1)
    low_x, high_x = np.minimum(x1, x2)[member].min(axis=1), np.maximum(x1, x2)[member].max(axis=1)
    low_y, high_y = np.minimum(y1, y2)[member].min(axis=1), np.maximum(y1, y2)[member].max(axis=1)

    def gaps(point: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First nearest segment of a block for each (point, block)."""
        at = member[block]
        ax, ay, dx, dy = x1[at], y1[at], x2[at] - x1[at], y2[at] - y1[at]
        x, y = px[point][:, None], py[point][:, None]
        size = dx * dx + dy * dy
        inner = (x - ax) * dx + (y - ay) * dy
        share = np.divide(inner, size, out=np.zeros_like(size), where=size != 0)
        share = np.minimum(1.0, np.maximum(0.0, share))
        gap_x, gap_y = x - (ax + share * dx), y - (ay + share * dy)
        d = gap_x * gap_x + gap_y * gap_y
        best, row = d.argmin(axis=1), np.arange(len(at))
        return d[row, best], at[row, best], share[row, best]

    found = []
    step = max(1, 1_000_000 // blocks)
    for start in range(0, len(px), step):
        rows = np.arange(start, min(start + step, len(px)))
        x, y = px[rows][:, None], py[rows][:, None]
        near_x = np.maximum(0.0, np.maximum(low_x - x, x - high_x))
        near_y = np.maximum(0.0, np.maximum(low_y - y, y - high_y))
        near = near_x * near_x + near_y * near_y
        limit = np.sqrt(gaps(rows, near.argmin(axis=1))[0]) * (1 + 1e-9) + 1e-12
        point, block = np.nonzero(near <= (limit * limit)[:, None])
        for a, b in _cuts(point):
            d, at, share = gaps(rows[point[a:b]], block[a:b])
            first = np.lexsort((at, d, point[a:b]))
            first = first[np.unique(point[a:b][first], return_index=True)[1]]
            found.append((at[first], share[first], d[first]))
    return tuple(np.concatenate(part) for part in zip(*found))


def _cuts(point: np.ndarray, rows: int = 100_000) -> Iterator[tuple[int, int]]:
    """Stretches of about ``rows`` that keep the rows of one point together."""
    start = 0
    while start < len(point):
        end = min(start + rows, len(point))
        if end < len(point):
            end = int(np.searchsorted(point, point[end - 1], side="right"))
        yield start, end
        start = end


def _locate_tile(stops: pa.Table, piece: pa.Table) -> pa.Table:
    """The nearest place on a piece of a line for stops of that line."""
    schema = pa.schema([("shape_id", pa.string()), ("stop_id", pa.string()), ("d", pa.float64()), ("seq", pa.int32()), ("ord", pa.int64()), ("along", pa.float64())])
    if not stops.num_rows or not piece.num_rows:
        return schema.empty_table()
    piece = piece.sort_by([("seq", "ascending"), ("ord", "ascending")])
    x1, y1, x2, y2, run, length, total = (piece[c].to_numpy() for c in ("x1", "y1", "x2", "y2", "run", "len", "total"))
    at, share, d = _nearest(stops["lon"].to_numpy(), stops["lat"].to_numpy(), [x1, y1, x2, y2])
    whole = total[at]
    along = np.divide(run[at] + share * length[at], whole, out=np.zeros(len(at)), where=whole != 0)
    return pa.table(
        [stops["shape_id"], stops["stop_id"], pa.array(d), piece["seq"].take(pa.array(at)), piece["ord"].take(pa.array(at)),
         pa.array(along, mask=whole == 0)],
        schema=schema,
    )


def locate(pairs: DataFrame, segs: DataFrame) -> DataFrame:
    """``shape_id, stop_id, fraction``: nearest place on the line, as a share of its planar length.

    ``pairs`` holds ``shape_id, stop_id, lon, lat``, a NULL in which leaves the pair out; they are
    written first. Ties go to the first segment. Stops and segments meet in tiles of bounded size:
    stops of a line are dealt into chunks, lines beyond ``LONG_LINE`` segments are cut into pieces
    of which a stop goes only to those that can be nearest, and a piece is copied for every chunk.
    Only pairs, segments and one candidate per tile are shuffled. Within a tile, blocks of segments
    are ruled out by their bounding boxes. A look at the segment counts, which Parquet statistics
    answer, tells whether there are long lines.
    """
    key, tile = ["shape_id", "stop_id"], ["shape_id", "_piece", "_chunk"]
    zero = F.lit(0.0)
    pairs = materialise(pairs.select(*key, "lon", "lat").dropna(), "pairs")
    piece = F.when(F.col("n") > LONG_LINE, F.floor(F.col("seq") / LONG_LINE)).otherwise(F.lit(0).cast("long"))
    pieces = segs.where("shape_id is not null").select(
        "shape_id", piece.alias("_piece"), *ORDER, "x1", "y1", "x2", "y2", "run", "len", "total", "n"
    ).where("_piece is not null")
    long = pieces.where(F.col("n") > LONG_LINE)
    kept = pairs.withColumn("_piece", F.lit(0).cast("long"))
    if not long.isEmpty():
        kept = kept.join(long.select("shape_id").distinct(), "shape_id", "left_anti").unionByName(_near_pieces(pairs, long))
    chunks = pairs.groupBy("shape_id").agg(F.ceil(F.count("*") / TILE_STOPS).alias("_chunks"))
    stops = kept.join(chunks, "shape_id").withColumn("_chunk", F.pmod(F.xxhash64("stop_id"), F.col("_chunks")))
    copies = pieces.join(chunks, "shape_id").withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1)))
    places = stops.drop("_chunks").groupBy(*tile).cogroup(copies.drop("_chunks", "n").groupBy(*tile)).applyInArrow(_locate_tile, _PLACE)
    return (
        places.groupBy(*key).agg(F.min_by("along", F.struct("d", "seq", "ord")).alias("fraction"))
        .withColumn("fraction", F.least(F.lit(1.0), F.greatest(zero, F.coalesce("fraction", zero))))
    )


def measures(segs: DataFrame) -> DataFrame:
    """``shape_id, total, n`` per line."""
    return segs.groupBy("shape_id").agg(F.max("total").alias("total"), F.max("n").alias("n"))


def extents(segs: DataFrame) -> DataFrame:
    """``shape_id, meters, total, n`` per line: geodesic and planar length, segment count."""
    return segs.groupBy("shape_id").agg(
        (F.sum("nm") / 1e9).alias("meters"), F.max("total").alias("total"), F.max("n").alias("n")
    )


def _bin_of(at: Column) -> Column:
    n = F.col("n")
    return F.greatest(F.lit(0).cast("long"), F.least(F.floor(at * n), n - 1))


def _binned(segs: DataFrame) -> DataFrame:
    """Segments by ``_bin``: a line of n segments is cut into n equal bins, of which its segments
    cover at most twice as many. A long segment covers many bins: chunks first, so that no row
    lists them all."""
    total = F.col("total")
    slack = total * 1e-12
    share_of = lambda at: _bin_of(at / F.nullif(total, F.lit(0.0)))
    start, end = share_of(F.col("run") - slack), share_of(F.col("run") + F.col("len") + slack)
    return (
        segs.withColumn("_last", end)
        .withColumn("_from", F.explode(F.sequence(start, F.col("_last"), F.lit(BIN_CHUNK).cast("long"))))
        .withColumn("_bin", F.explode(F.sequence("_from", F.least(F.col("_from") + (BIN_CHUNK - 1), F.col("_last")))))
        .select("shape_id", "_bin", *ORDER, "x1", "y1", "x2", "y2", "run", "len", slack.alias("_slack"))
    )


def place_on_line(rows: DataFrame, segs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, line_lon, line_lat``: every row with its point at ``fraction`` of the line
    ``shape_id``, NULL where either is NULL. ``rows`` hold ``keys, shape_id, fraction`` and the
    line's ``total`` and ``n``; no two may be equal in ``keys``. The join is on (line, bin)."""
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("fraction")))
    wanted = rows.select(*keys, "shape_id", (at * F.col("total")).alias("_at"), F.when(F.col("fraction").isNotNull(), _bin_of(at)).alias("_bin"))
    start, end = F.col("run") - F.col("_slack"), F.col("run") + F.col("len") + F.col("_slack")
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("_at") - F.col("run")) / F.nullif(F.col("len"), F.lit(0.0))))
    place = F.struct(
        (F.col("x1") + F.coalesce(share, F.lit(0.0)) * (F.col("x2") - F.col("x1"))).alias("lon"),
        (F.col("y1") + F.coalesce(share, F.lit(0.0)) * (F.col("y2") - F.col("y1"))).alias("lat"),
    )
    here = (F.col("_at") >= start) & (F.col("_at") <= end)
    best = F.min_by(F.when(here, place), F.when(here, F.struct("seq", "ord")))
    return (
        wanted.join(_binned(segs), ["shape_id", "_bin"], "left")
        .groupBy(*keys).agg(best.alias("_place"))
        .select(*keys, F.col("_place.lon").alias("line_lon"), F.col("_place.lat").alias("line_lat"))
    )


def interpolate(targets: DataFrame, segs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, lon, lat``: the point at ``fraction`` of the line ``shape_id``; targets without a
    line or fraction drop out. ``targets`` holds ``keys, shape_id, fraction``."""
    rows = targets.join(measures(segs), "shape_id")
    found = place_on_line(rows, segs, keys)
    return found.where("line_lon is not null").select(*keys, F.col("line_lon").alias("lon"), F.col("line_lat").alias("lat"))


# --- simplification (Douglas and Peucker, 1973) -----------------------------------------


def _kept(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Which vertices of one line stay; both ends always do."""
    keep = np.zeros(len(x), dtype=bool)
    keep[[0, -1]] = True
    ranges = [(0, len(x) - 1)]
    while ranges:
        a, b = ranges.pop()
        if b - a < 2:
            continue
        px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        dx, dy = x[b] - x[a], y[b] - y[a]
        size = dx * dx + dy * dy
        share = np.clip((px * dx + py * dy) / size, 0.0, 1.0) if size > 0 else 0.0
        gap = (px - share * dx) ** 2 + (py - share * dy) ** 2
        far = int(np.argmax(gap))
        if gap[far] > tolerance * tolerance:
            split = a + 1 + far
            keep[split] = True
            ranges += [(a, split), (split, b)]
    return keep


_VERTEX = "shape_id string, seq int, ord long, lon double, lat double"


def _simplify_whole(vertices: DataFrame, tolerance: float) -> DataFrame:
    """Lines of at most LOCAL_ROWS vertices: many to an Arrow batch, in order, one at a time."""

    def kept(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        keep = _kept(x, y, tolerance)
        if keep.sum() == 2 and x[0] == x[-1] and y[0] == y[-1]:
            keep[:] = False  # collapsed
        return keep

    def thin(table: pa.Table) -> list[pa.RecordBatch]:
        """Whole lines, one after the other."""
        x, y = table["lon"].to_numpy(), table["lat"].to_numpy()
        edges = _starts(table)
        keep = np.concatenate([kept(x[a:b], y[a:b]) for a, b in zip(edges, [*edges[1:], len(x)])])
        return table.filter(pa.array(keep)).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_line: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*open_line, batch])
            last = _starts(table)[-1]
            # The last line may go on in the next batch.
            open_line = table.slice(last).to_batches()
            if last:
                yield from thin(table.slice(0, last))
        if open_line:
            yield from thin(pa.Table.from_batches(open_line))

    rows = vertices.select("shape_id", *ORDER, "lon", "lat")
    return rows.repartition("shape_id").sortWithinPartitions("shape_id", *ORDER).mapInArrow(run, _VERTEX)


def _starts(table: pa.Table) -> list[int]:
    """Row numbers at which another line begins; the first is 0."""
    ids = table["shape_id"].combine_chunks()
    other = pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(other) + 1).tolist()]


def _gap2(x: Column, y: Column, a: str, b: str) -> Column:
    """Squared distance of a vertex to the segment between two others."""
    ends = (F.col(f"{a}.lon"), F.col(f"{a}.lat"), F.col(f"{b}.lon"), F.col(f"{b}.lat"))
    share = geo.segment_share(x, y, *ends)
    gx = (x - ends[0]) - share * (ends[2] - ends[0])
    gy = (y - ends[1]) - share * (ends[3] - ends[1])
    return gx * gx + gy * gy


def _simplify_long(vertices: DataFrame, tolerance: float, local_rows: int) -> DataFrame:
    """Lines too long for one task: split at the farthest vertex, all ranges at once,
    until every range is short enough to be finished on its own."""
    place = F.struct("seq", "ord", "lon", "lat")
    order = F.struct("seq", "ord")
    ends = vertices.groupBy("shape_id").agg(
        F.min_by(place, order).alias("a"), F.max_by(place, order).alias("b"), F.count("*").alias("size")
    )
    rows = vertices.select("shape_id", *ORDER, "lon", "lat").join(ends, "shape_id").checkpoint()
    here = F.struct("seq", "ord")
    inside = (here > F.struct("a.seq", "a.ord")) & (here < F.struct("b.seq", "b.ord"))
    kept = [rows.where(~inside).select("shape_id", *ORDER, "lon", "lat")]
    rows = rows.where(inside)
    short = []
    while True:
        short.append(rows.where(F.col("size") <= local_rows))
        rows = rows.where(F.col("size") > local_rows)
        gap = _gap2(F.col("lon"), F.col("lat"), "a", "b")
        far = (
            rows.withColumn("_gap", gap)
            .groupBy("shape_id", F.col("a.seq").alias("_aseq"), F.col("a.ord").alias("_aord"))
            .agg(
                F.max("_gap").alias("_far"),
                F.min_by(place, F.struct((-F.col("_gap")).alias("g"), "seq", "ord")).alias("c"),
            )
            .where(F.col("_far") > tolerance * tolerance)
            .drop("_far")
            .checkpoint()
        )
        if far.isEmpty():
            break
        kept.append(far.select("shape_id", "c.*"))
        split = rows.select(
            "*", F.col("a.seq").alias("_aseq"), F.col("a.ord").alias("_aord")
        ).join(far, ["shape_id", "_aseq", "_aord"])
        middle = F.struct("c.seq", "c.ord")
        left = here < middle
        halves = split.where(here != middle).select(
            "shape_id", *ORDER, "lon", "lat",
            F.when(left, F.col("a")).otherwise(F.col("c")).alias("a"),
            F.when(left, F.col("c")).otherwise(F.col("b")).alias("b"),
        )
        sizes = halves.groupBy("shape_id", "a").agg(F.count("*").alias("size"))
        rows = halves.join(sizes, ["shape_id", "a"]).checkpoint()

    def finish(table: pa.Table) -> pa.Table:
        table = table.sort_by([("seq", "ascending"), ("ord", "ascending")])
        edge = {c: table[c][0].as_py() for c in ("ax", "ay", "bx", "by")}
        x = np.concatenate([[edge["ax"]], table["lon"].to_numpy(), [edge["bx"]]])
        y = np.concatenate([[edge["ay"]], table["lat"].to_numpy(), [edge["by"]]])
        inner = table.select(["shape_id", "seq", "ord", "lon", "lat"])
        return inner.filter(pa.array(_kept(x, y, tolerance)[1:-1]))

    rest = reduce(DataFrame.unionByName, short).select(
        "shape_id", *ORDER, "lon", "lat",
        F.col("a.seq").alias("aseq"), F.col("a.ord").alias("aord"),
        F.col("a.lon").alias("ax"), F.col("a.lat").alias("ay"), F.col("b.lon").alias("bx"), F.col("b.lat").alias("by"),
    )
    kept.append(rest.groupBy("shape_id", "aseq", "aord").applyInArrow(finish, _VERTEX))
    return reduce(DataFrame.unionByName, kept)


def simplify(
    vertices: DataFrame, tolerance: float, local_rows: int = LOCAL_ROWS, longest: int | None = None
) -> DataFrame:
    """Vertices left after simplifying each line; ``tolerance`` in degrees, 0 keeps all.

    A line reduced to two equal vertices has collapsed and yields no vertices. ``longest``
    is the vertex count of the longest line where it is known; otherwise one count job
    finds out whether some line is too long for a single task.
    """
    if tolerance <= 0:
        return vertices.select("shape_id", *ORDER, "lon", "lat")
    if longest is not None and longest <= local_rows:
        return _simplify_whole(vertices, tolerance)
    long = vertices.groupBy("shape_id").agg(F.count("*").alias("_n")).where(F.col("_n") > local_rows)
    if long.isEmpty():
        return _simplify_whole(vertices, tolerance)
    ids = long.select("shape_id")
    cut = _simplify_long(vertices.join(ids, "shape_id", "left_semi"), tolerance, local_rows)
    alive = cut.groupBy("shape_id").agg(
        ((F.count("*") > 2) | (F.min("lon") < F.max("lon")) | (F.min("lat") < F.max("lat"))).alias("_alive")
    )
    return _simplify_whole(vertices.join(ids, "shape_id", "left_anti"), tolerance).unionByName(
        cut.join(alive.where("_alive").select("shape_id"), "shape_id", "left_semi")
    )
