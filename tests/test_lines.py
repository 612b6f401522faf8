"""Line geometry against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tramline.functions import geo
from tramline.operators import lines, spatial
from tramline.plans.positions import midpoints, sanity

VERTEX = "shape_id string, seq int, ord long, lon double, lat double"


@pytest.fixture(scope="module")
def walks(spark):
    rng = random.Random(11)
    rows = []
    for shape, size in (("a", 200), ("b", 90), ("c", 2), ("d", 40)):
        x, y = -73.9, 40.7
        for i in range(size):
            rows.append((shape, i, 0, x, y))
            x += rng.uniform(-1, 2) * 1e-3
            y += rng.uniform(-1, 1) * 1e-3
    return spark.createDataFrame(rows, VERTEX).cache()


def as_lines(df):
    found = {}
    for r in df.orderBy("shape_id", "seq", "ord").collect():
        found.setdefault(r["shape_id"], []).append((r["lon"], r["lat"]))
    return found


def to_segment(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    size = dx * dx + dy * dy
    t = 0 if size == 0 else min(1, max(0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / size))
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy), t


def recursive(points, tolerance):
    if len(points) < 3:
        return points
    far, at = max((to_segment(p, points[0], points[-1])[0], -i) for i, p in enumerate(points[1:-1], 1))
    if far <= tolerance:
        return [points[0], points[-1]]
    return recursive(points[: 1 - at], tolerance)[:-1] + recursive(points[-at:], tolerance)


@pytest.mark.parametrize("local_rows", [100_000, 60, 15])
@pytest.mark.parametrize("tolerance", [1e-4, 2e-3])
def test_simplify(walks, local_rows, tolerance):
    got = as_lines(lines.simplify(walks, tolerance, local_rows))
    assert got == {k: recursive(v, tolerance) for k, v in as_lines(walks).items()}


def test_simplify_edges(spark, walks):
    assert as_lines(lines.simplify(walks, 0)) == as_lines(walks)
    loop = spark.createDataFrame([("l", i, 0, x, 40.0) for i, x in enumerate([0.0, 1e-6, 0.0])], VERTEX)
    assert lines.simplify(loop, 1e-3).isEmpty()
    assert lines.simplify(loop, 1e-3, local_rows=1).isEmpty()


@pytest.mark.parametrize("long_line,chunk", [(4096, 65_536), (50, 2)])
def test_locate_and_interpolate(spark, walks, monkeypatch, long_line, chunk):
    monkeypatch.setattr(lines, "LONG_LINE", long_line)
    monkeypatch.setattr(lines, "BIN_CHUNK", chunk)
    rng = random.Random(5)
    segs = lines.segments(walks).cache()
    stops = [(s, f"p{i}", -73.9 + rng.uniform(-0.1, 0.2), 40.7 + rng.uniform(-0.05, 0.05)) for s in "abcd" for i in range(25)]
    pairs = spark.createDataFrame(stops, "shape_id string, stop_id string, lon double, lat double")
    got = {(r["shape_id"], r["stop_id"]): r["fraction"] for r in lines.locate(pairs, segs).collect()}
    shapes = as_lines(walks)
    for shape, stop, x, y in stops:
        v = shapes[shape]
        runs = [0.0]
        for a, b in zip(v, v[1:]):
            runs.append(runs[-1] + math.dist(a, b))
        best = min(range(len(v) - 1), key=lambda i: (to_segment((x, y), v[i], v[i + 1])[0], i))
        t = to_segment((x, y), v[best], v[best + 1])[1]
        expected = (runs[best] + t * (runs[best + 1] - runs[best])) / runs[-1]
        assert got[shape, stop] == pytest.approx(expected, abs=1e-9)
    # A place on the line is found again at its own fraction.
    targets = spark.createDataFrame([(s, i, i / 20) for s in "abcd" for i in range(21)], "shape_id string, i int, fraction double")
    places = lines.interpolate(targets, segs, ["shape_id", "i"])
    assert places.count() == targets.count()
    found = {(r["shape_id"], r["i"]): (r["lon"], r["lat"]) for r in places.collect()}
    for shape, v in shapes.items():
        assert found[shape, 0] == pytest.approx(v[0]) and found[shape, 20] == pytest.approx(v[-1])
        for i in range(21):
            assert min(to_segment(found[shape, i], a, b)[0] for a, b in zip(v, v[1:])) < 1e-9


@pytest.mark.parametrize("long_line,tile", [(65_536, 6), (40, 6), (40, 200_000)])
def test_locate_in_tiles(spark, walks, monkeypatch, long_line, tile):
    """Small tiles give the places of one tile, and each pair leaves a tile as one row."""
    rng = random.Random(8)
    segs = lines.segments(walks).cache()
    stops = [(s, f"p{i}", -73.9 + rng.uniform(-0.1, 0.2), 40.7 + rng.uniform(-0.05, 0.05)) for s in "abcd" for i in range(25)]
    stops += [("a", None, -73.9, 40.7), (None, "p1", -73.9, 40.7), ("a", "nowhere", None, 40.7), ("z", "p1", -73.9, 40.7)]
    pairs = spark.createDataFrame(stops, "shape_id string, stop_id string, lon double, lat double")
    found = lambda: sorted(tuple(r) for r in lines.locate(pairs, segs).collect())
    whole = found()
    assert len(whole) == 100
    monkeypatch.setattr(lines, "LONG_LINE", long_line)
    monkeypatch.setattr(lines, "TILE_STOPS", tile)
    assert found() == whole


def test_locate_ties_and_ends(spark):
    bend = spark.createDataFrame([("u", i, 0, x, y) for i, (x, y) in enumerate([(0.0, 1.0), (0.0, 0.0), (2.0, 0.0), (2.0, 1.0)])], VERTEX)
    pairs = spark.createDataFrame(
        [("u", "middle", 1.0, 1.0), ("u", "before", -0.5, 3.0), ("u", "after", 2.5, 3.0)],
        "shape_id string, stop_id string, lon double, lat double",
    )
    segs = lines.segments(bend)
    got = {r["stop_id"]: r["fraction"] for r in lines.locate(pairs, segs).collect()}
    # 'middle' is equally far from three segments: the first wins, at its start.
    assert got == {"middle": 0.0, "before": 0.0, "after": 1.0}
    spots = spark.createDataFrame([("u", "x", 0.0), ("u", "y", 0.5)], "shape_id string, stop_id string, fraction double")
    mid = midpoints(spots, segs).first()
    assert (mid["lon"], mid["lat"]) == pytest.approx((0.0, 0.0))
    row = sanity(spots).first()
    assert (row["rows"], row["out_of_range"], row["endpoint_pinned"]) == (2, 0, 1)


def vincenty(lon1, lat1, lon2, lat2):
    a, f = 6378137.0, 1 / 298.257223563
    b = (1 - f) * a
    u1, u2 = (math.atan((1 - f) * math.tan(math.radians(x))) for x in (lat1, lat2))
    length = lam = math.radians(lon2 - lon1)
    for _ in range(200):
        sin_s = math.hypot(math.cos(u2) * math.sin(lam), math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * math.cos(lam))
        if sin_s == 0:
            return 0.0
        cos_s = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * math.cos(lam)
        s = math.atan2(sin_s, cos_s)
        sin_a = math.cos(u1) * math.cos(u2) * math.sin(lam) / sin_s
        cos2a = 1 - sin_a**2
        cos2m = cos_s - 2 * math.sin(u1) * math.sin(u2) / cos2a if cos2a else 0
        c = f / 16 * cos2a * (4 + f * (4 - 3 * cos2a))
        new = length + (1 - c) * f * sin_a * (s + c * sin_s * (cos2m + c * cos_s * (2 * cos2m**2 - 1)))
        if abs(new - lam) < 1e-13:
            break
        lam = new
    u = cos2a * (a * a - b * b) / (b * b)
    ca = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
    cb = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
    ds = cb * sin_s * (cos2m + cb / 4 * (cos_s * (2 * cos2m**2 - 1) - cb / 6 * cos2m * (4 * sin_s**2 - 3) * (4 * cos2m**2 - 3)))
    return b * ca * (s - ds)


def test_spheroid_distance(spark):
    rng = random.Random(2)
    pairs = [tuple(rng.uniform(*r) for r in ((-74.4, -73.6), (40.4, 41.0), (-74.4, -73.6), (40.4, 41.0))) for _ in range(200)]
    pairs += [(-73.98, 40.75, -73.98, 40.75), (-73.98, 40.75, -73.98, 40.76), (-73.98, 40.75, -73.97, 40.75)]
    df = spark.createDataFrame(pairs, "a double, b double, c double, d double")
    got = df.select("*", geo.spheroid_m(*(F.col(c) for c in "abcd")).alias("m")).collect()
    for a, b, c, d, m in got:
        assert m == pytest.approx(vincenty(a, b, c, d), abs=0.1)
    # Two stations 978.3 m apart on the sphere: within 1 km, not within 200 m.
    near = spark.createDataFrame([(-73.987495, 40.75529, -73.976848, 40.751776)], "a double, b double, c double, d double")
    row = near.select(*(geo.within_m(*(F.col(c) for c in "abcd"), r) for r in (200, 1000)), geo.spheroid_m(*(F.col(c) for c in "abcd"))).first()
    assert not row[0] and row[1] and row[2] == pytest.approx(978, abs=5)


def test_within_distance(spark):
    rng = random.Random(9)
    rows = [(f"s{i:03d}", -73.9 + rng.uniform(0, 0.03), 40.7 + rng.uniform(0, 0.03)) for i in range(150)]
    # A third of the points sits in one place.
    rows += [(f"h{i:03d}", -73.89, 40.71) for i in range(75)]
    stops = spark.createDataFrame(rows, "stop_id string, lon double, lat double").cache()
    found = spatial.nearby(stops, 400)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {(r["a_stop_id"], r["b_stop_id"]) for r in found.collect()}
    b = stops.select(F.col("stop_id").alias("t"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    every = stops.join(b, F.col("stop_id") < F.col("t")).where(geo.within_m(F.col("lon"), F.col("lat"), F.col("x"), F.col("y"), 400))
    assert got == {(r["stop_id"], r["t"]) for r in every.collect()}
    assert found.count() == len(got)


@pytest.mark.parametrize("lat,lon", [(52.5, 13.4), (65.0, 179.99), (89.99, 0.0), (-0.001, -180.0)])
def test_within_distance_anywhere(spark, lat, lon):
    rng = random.Random(11)
    width = min(180.0, 0.02 / math.cos(math.radians(lat)))
    wrap = lambda x: (x + 180) % 360 - 180
    rows = [(f"s{i:03d}", wrap(lon + rng.uniform(-width, width)), min(90.0, lat + rng.uniform(-0.01, 0.01))) for i in range(150)]
    stops = spark.createDataFrame([*rows, ("none", None, lat)], "stop_id string, lon double, lat double")
    got = {(r["a_stop_id"], r["b_stop_id"]) for r in spatial.nearby(stops, 200).collect()}
    b = stops.select(F.col("stop_id").alias("t"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    every = stops.join(b, F.col("stop_id") < F.col("t")).where(geo.within_m(F.col("lon"), F.col("lat"), F.col("x"), F.col("y"), 200))
    assert got and got == {(r["stop_id"], r["t"]) for r in every.collect()}


def test_geojson(spark):
    df = spark.createDataFrame([(1.23456789, 2.0)], "x double, y double")
    text = df.select(geo.as_geojson_point(F.col("x"), F.col("y")).alias("g"))
    assert text.first()[0] == '{"type":"Point","coordinates":[1.234568,2.0]}'
    bad = spark.createDataFrame([("{}",), ("POINT(1 2)",), ('{"type":"Point","coordinates":[1]}',), (None,)], "g string")
    assert [r[0] for r in bad.select(geo.parse_geojson_point(F.col("g"))).collect()] == [None] * 4
    line = df.select(F.array(geo.point(F.col("x"), F.col("y")), geo.point(F.col("y"), F.col("x"))).alias("p"))
    again = line.select("p", geo.parse_geojson_line(geo.as_geojson_line(F.col("p"))).alias("q"), geo.line_valid(F.col("p")), geo.ewkt_line(F.col("p"))).first()
    assert [tuple(v) for v in again["q"]] == [(1.234568, 2.0), (2.0, 1.234568)]
    assert again[2] and again[3] == "SRID=4326;LINESTRING(1.23456789 2.0, 2.0 1.23456789)"


def test_distance_of_unknown_points_is_null(spark):
    from tramline.functions import geo

    point = [F.lit(v).cast("double") for v in (-73.9, 40.7, -73.8, 40.7)]
    for i in range(4):
        some = [F.lit(None).cast("double") if j == i else c for j, c in enumerate(point)]
        row = spark.range(1).select(geo.spheroid_m(*some).alias("m"), geo.within_m(*some, 100.0).alias("near")).first()
        assert (row.m, row.near) == (None, None)
    assert 8000 < spark.range(1).select(geo.spheroid_m(*point)).first()[0] < 9000


def test_a_cluster_needs_a_shared_folder():
    from tramline.sources.store import one_process

    assert one_process("local[8]") and one_process("local")
    assert not any(map(one_process, ("local-cluster[2,1,1024]", "yarn", "spark://host:7077")))


def test_pairs_of_one_file_are_joined_by_many_tasks(spark):
    """Stops come from one small file; the join of their pairs must not stay in its one partition."""
    stops = spark.range(600).coalesce(1).selectExpr("concat('s', id) stop_id", "13.4 + id / 1e5 lon", "52.5 + id / 1e5 lat")
    shares = spatial.within_distance(stops, stops, 2000).groupBy(F.spark_partition_id()).count()
    assert shares.count() > 1


def test_distance_in_columns_is_the_same_number(spark):
    rows = spark.sql("SELECT id, rand(1) * 360 - 180 a, rand(2) * 180 - 90 b, rand(3) * 360 - 180 c, rand(4) * 180 - 90 d FROM range(200)"
                     " UNION ALL SELECT -1, 1, 2, 1, 2 UNION ALL SELECT -2, null, 2, 1, 2 UNION ALL SELECT -3, 180, 0, 0, 0").cache()
    parts = {r["id"]: r["m"] for r in geo.with_spheroid_m(rows, "m", "a", "b", "c", "d").select("id", "m").collect()}
    whole = {r["id"]: r["m"] for r in rows.select("id", geo.spheroid_m(*(F.col(c) for c in "abcd")).alias("m")).collect()}
    assert parts == whole


def test_rounding_to_mm_is_round(spark):
    values = "SELECT rand(5) * 4000 m FROM range(3000) UNION ALL SELECT id / 2000 - 1 FROM range(4000) UNION ALL SELECT id / 8 FROM range(100)"
    odd = " UNION ALL SELECT explode(array(1.0005D, 2.0004999999999997D, 1e6, 1e12 + 0.0005D, 1e300, -0.0004D, -0.0D, double('nan'), null))"
    rows = spark.sql(values + odd).select("m", geo.rounded_to_mm(F.col("m")).alias("quick"), F.round("m", 3).alias("plain"))
    assert rows.count() == 7109
    assert [r for r in rows.where("NOT quick <=> plain").collect()] == []


def test_pairs_of_a_crowded_cell_are_dealt_over_tasks(spark, monkeypatch):
    """All stops in one cell and no broadcast: partitions small in bytes hold many pairs and must not be merged into one."""
    monkeypatch.setattr(spatial, "BLOCK_ROWS", 20, raising=False)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stops = spark.range(300).coalesce(1).selectExpr("concat('s', lpad(id, 3, '0')) stop_id", "13.4 + id / 1e6 lon", "52.5 + id / 1e6 lat")
        unknown = spark.sql("SELECT concat('u', id) stop_id, if(id % 2 = 0, null, 13.4) lon, if(id % 2 = 0, 52.5, null) lat FROM range(50)")
        found = spatial.nearby(stops.unionByName(unknown), 2000).select("a_stop_id", "b_stop_id", F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    names = [f"s{i:03d}" for i in range(300)]
    assert sorted((r["a_stop_id"], r["b_stop_id"]) for r in found) == [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    shares = [sum(r["p"] == p for r in found) for p in {r["p"] for r in found}]
    assert max(shares) < len(found) / 2
