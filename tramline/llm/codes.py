"""Vector codes by product quantisation, with codebooks refined over cover trees.

Components become integers and vectors are cut into equal parts. For each part position the
vectors of a chunk (a bounded piece of an input partition) form a cover tree, built once and
written: a node covers its points by a ball, children of a node are more than half its radius
apart, and points lie in tree order, so cumulative sums give any subtree's sum and count by
one subtraction. A Lloyd round walks the tree from the root: where the triangle inequality
leaves one codebook entry for the whole ball, the subtree is assigned at once; only leaves
that stay ambiguous compare their points, in whole numbers. Tasks send sums per codebook
entry, never points.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import keep, parts, release, ship, with_totals

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
CHUNK, LEAF = 8_192, 64
# Larger components are not coded: squares of differences stay within 64 bits.
LARGEST = 1 << 18


# --- cover trees ----------------------------------------------------------------------------


class CoverTree:
    """A cover tree over whole-number points, as flat arrays.

    ``points`` are distinct, in tree order; ``place[i]`` is the point of input row i. Node j
    holds points ``start[j]:end[j]``, all within ``radius[j]`` of ``points[start[j]]``; its
    children are nodes ``child[j]:child[j + 1]`` of the next level, none for a leaf.
    """

    def __init__(self, points, counts, place, start, end, radius, child):
        self.points, self.counts, self.place = points, counts, place
        self.start, self.end, self.radius, self.child = start, end, radius, child
        zero = np.zeros((1, points.shape[1]), np.int64)
        self.sums = np.concatenate([zero, np.cumsum(points * counts[:, None], axis=0)])
        self.total = np.concatenate([[0], np.cumsum(counts)])

    @classmethod
    def build(cls, rows: np.ndarray, leaf: int = LEAF) -> CoverTree:
        points, inverse, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        order, exact = np.arange(len(points)), points.astype(np.float64)
        start, end, kids = [0], [len(points)], []
        radius = [_reach(((exact - exact[:1]) ** 2).sum(axis=1))]
        at = 0
        while at < len(start):
            low, high, first = start[at], end[at], len(start)
            if high - low > leaf:
                own = order[low:high].copy()
                for group, reach in _split(exact[own], radius[at] / 2):
                    start.append(low)
                    low += len(group)
                    end.append(low)
                    order[start[-1] : low] = own[group]
                    radius.append(reach)
            kids.append((first, len(start)))
            at += 1
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return cls(
            points[order], counts[order], rank[inverse.reshape(-1)], np.array(start), np.array(end),
            np.array(radius), np.array(kids),
        )

    def dumped(self) -> bytes:
        out = io.BytesIO()
        np.savez(
            out, points=self.points.astype(np.int32), counts=self.counts.astype(np.int32), place=self.place.astype(np.int32),
            start=self.start.astype(np.int32), end=self.end.astype(np.int32), radius=self.radius, child=self.child.astype(np.int32),
        )
        return out.getvalue()

    @classmethod
    def loaded(cls, data: bytes) -> CoverTree:
        held = np.load(io.BytesIO(data), allow_pickle=False)
        names = ("points", "counts", "place", "start", "end")
        return cls(*(held[n].astype(np.int64) for n in names), held["radius"], held["child"].astype(np.int64))

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes by point, sums, counts by entry): each point's nearest entry, ties to the lower index."""
        codes = np.empty(len(self.points), np.int64)
        sums, counts = np.zeros_like(entries), np.zeros(len(entries), np.int64)
        ahead = np.zeros(min(1, len(self.points)), np.int64)
        while len(ahead):
            far = np.sqrt(squared(self.points[self.start[ahead]], entries))
            nearest = far.argmin(axis=1)
            best = far[np.arange(len(ahead)), nearest]
            far[np.arange(len(ahead)), nearest] = np.inf
            # Every point of the ball is nearer to this entry than to any other; the margin is
            # far above what rounding can do to a root.
            sure = best + 2 * self.radius[ahead] + 1e-6 * (1 + best) < far.min(axis=1)
            whole, entry = ahead[sure], nearest[sure]
            low, high = self.start[whole], self.end[whole]
            np.add.at(sums, entry, self.sums[high] - self.sums[low])
            np.add.at(counts, entry, self.total[high] - self.total[low])
            codes[_ranges(low, high)] = np.repeat(entry, high - low)
            left = ahead[~sure]
            kids = self.child[left]
            leaves = left[kids[:, 0] == kids[:, 1]]
            exact = _ranges(self.start[leaves], self.end[leaves])
            for block in np.array_split(exact, max(1, len(exact) // 4096)):
                found = squared(self.points[block], entries).argmin(axis=1)
                codes[block] = found
                np.add.at(sums, found, self.points[block] * self.counts[block, None])
                np.add.at(counts, found, self.counts[block])
            ahead = _ranges(kids[:, 0], kids[:, 1])
        return codes, sums, counts


def _split(points: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, float]]:
    """Groups of numbers of ``points`` (doubles), each within ``radius`` of its first, and how far they
    reach; the firsts are more than ``radius`` apart, the first group is around the first point."""
    left, most = np.arange(len(points)), radius * radius
    while len(left):
        away = points - points[0]
        square = np.einsum("ij,ij->i", away, away)
        near = square <= most
        near[0] = True
        yield left[near], _reach(square[near])
        left, points = left[~near], points[~near]


def _reach(square: np.ndarray) -> float:
    """Largest distance of squared ones, a little more for rounding."""
    return float(np.sqrt(square.max(initial=0.0))) * (1 + 1e-9)


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers of the ranges low:high, one after the other."""
    sizes = high - low
    if not sizes.sum():
        return np.zeros(0, np.int64)
    begin = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(low - begin, sizes)


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances, points by entries; exact whole numbers, as doubles where these hold them."""
    most = max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0))
    if 4 * points.shape[1] * int(most) ** 2 < 1 << 53:
        x, e = points.astype(np.float64), entries.astype(np.float64)
        return np.einsum("ij,ij->i", x, x)[:, None] + (np.einsum("ij,ij->i", e, e) - 2 * (x @ e.T))
    out = np.zeros((len(points), len(entries)), np.int64)
    for x, e in zip(points.T, entries.T):
        away = x[:, None] - e[None, :]
        out += away * away
    return out


# --- rows -----------------------------------------------------------------------------------


def components(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, parts: array<long> of floor(256 * x)) of vectors without NULL or non-finite components;
    ``parts`` is NULL where a component is too large."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    small = F.forall("x", lambda c: F.abs(c) < float(LARGEST))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), x.alias("x"))
    whole = F.transform("x", lambda c: F.floor(c * SCALE))
    return rows.where(F.col("x").isNotNull()).where(finite).select("vec_id", "label", F.when(small, whole).alias("parts"))


def _cut(rows: list[list[int]], dims: int) -> np.ndarray:
    """Rows as [row, part, component]; a length that cannot be cut evenly is filled with zeros."""
    width = max(1, -(-dims // PARTS))
    out = np.zeros((len(rows), PARTS * width), np.int64)
    if rows and dims:
        out[:, :dims] = np.array(rows, np.int64)
    return out.reshape(len(rows), PARTS, width)


def build_trees(rows: DataFrame, dims: int, chunk: int = CHUNK) -> DataFrame:
    """(places: array<long>, trees: array<binary>): a row per chunk of rows (place, parts) of ``dims`` components."""
    ship(rows.sparkSession)

    def out(places: list[int], vectors: list[list[int]]) -> pa.RecordBatch:
        cut = _cut(vectors, dims)
        trees = [CoverTree.build(cut[:, part]).dumped() for part in range(PARTS)]
        return pa.RecordBatch.from_arrays(
            [pa.array([places], pa.list_(pa.int64())), pa.array([trees], pa.list_(pa.binary()))], ["places", "trees"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        places, vectors = [], []
        for part in (part for batch in batches for part in parts(batch)):
            places += part.column(0).to_pylist()
            vectors += part.column(1).to_pylist()
            while len(places) >= chunk:
                yield out(places[:chunk], vectors[:chunk])
                places, vectors = places[chunk:], vectors[chunk:]
        if places:
            yield out(places, vectors)

    return keep(rows.select("place", "parts").mapInArrow(run, "places array<long>, trees array<binary>"), "trees")


def lloyd(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every entry replaced by the floored mean of the parts assigned to it, unused ones kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        sums, counts = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                for part, tree in enumerate(batch.column(0)[row].as_py()):
                    _, s, n = CoverTree.loaded(tree).assign(books[part])
                    sums[part] += s
                    counts[part] += n
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(entry), pa.array(counts[part, entry]), pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))],
            ["part", "entry", "n", "sums"],
        )

    found = trees.select("trees").mapInArrow(run, "part long, entry long, n long, sums array<long>")
    width = books.shape[2]
    # A row per entry, whatever the table's size: PARTS * ENTRIES at most.
    means = found.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(width))).alias("sums")
    )
    books = books.copy()
    for row in means.collect():
        books[row["part"], row["entry"]] = [total // row["n"] for total in row["sums"]]
    return books


def coded(trees: DataFrame, books: np.ndarray) -> DataFrame:
    """(place, code, error) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for row in range(batch.num_rows):
                places = batch.column(0)[row].as_py()
                codes, error = np.empty((len(places), PARTS), np.uint8), np.zeros(len(places), np.int64)
                for part, data in enumerate(batch.column(1)[row].as_py()):
                    tree = CoverTree.loaded(data)
                    found = tree.assign(books[part])[0]
                    away = tree.points - books[part][found]
                    codes[:, part] = found[tree.place]
                    error += (away * away).sum(axis=1)[tree.place]
                text = codes.tobytes().hex()
                code = [text[2 * PARTS * i : 2 * PARTS * (i + 1)] for i in range(len(places))]
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(code), pa.array(error)], ["place", "code", "error"])

    return trees.select("places", "trees").mapInArrow(run, "place long, code string, error long")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, chunk: int = CHUNK) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable row of ``vectors`` (vec_id, embedding, label).

    Rows whose vector is NULL or holds NULL or non-finite components are dropped. Codebooks
    start from the ``entries`` smallest vec_ids (then by components; repeated rows count each;
    rows without vec_id are coded, but start no entry). The first of these rows sets the number
    of components; where it does not divide by 16, vectors are filled up with zeros. Rows of
    another length, or with a component of 2^18 or more in magnitude, stay with NULL code and
    error. Equal labels share label_error, NULLs together; without a ``label`` column all are
    NULL. Without any vec_id all rows stay uncoded; an empty table gives an empty result.
    """
    rows = keep(components(vectors).withColumn("place", F.monotonically_increasing_id()), "components")
    able = rows.where("parts IS NOT NULL AND vec_id IS NOT NULL")
    first = able.orderBy("vec_id", "parts").limit(1).collect()
    dims = len(first[0]["parts"]) if first else -1
    ours = rows.where(F.size("parts") == dims) if first else rows.limit(0)
    start = ours.where("vec_id IS NOT NULL").orderBy("vec_id", "parts").limit(entries).select("parts").collect()
    books = np.ascontiguousarray(_cut([r["parts"] for r in start], max(dims, 0)).transpose(1, 0, 2))
    trees = build_trees(ours, max(dims, 0), chunk)
    for _ in range(rounds):
        books = lloyd(trees, books)
    found = keep(coded(trees, books), "codes")
    out = keep(rows.drop("parts").join(found, "place", "left"), "coded")
    totals = keep(out.groupBy("label").agg(F.count("*").alias("n"), F.sum("error").alias("label_error")), "label-errors")
    return with_totals(out, totals, "label", "n").select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )


def _rounds() -> str:
    """Assignment to entries (the least of distance and index as one number) and new means, round by round."""
    steps = []
    for turn in range(ROUNDS + 1):
        steps.append(f"""
near{turn} AS MATERIALIZED (
    SELECT place, p.part, min({ENTRIES} * ((p.a - e.a) ** 2 + (p.b - e.b) ** 2 + (p.c - e.c) ** 2 + (p.d - e.d) ** 2)::BIGINT + entry) AS best
    FROM piece p JOIN book{turn} e USING (part) GROUP BY ALL
)""")
        if turn < ROUNDS:
            steps.append(f"""
book{turn + 1} AS MATERIALIZED (
    SELECT part, entry, coalesce(m.a, e.a) AS a, coalesce(m.b, e.b) AS b, coalesce(m.c, e.c) AS c, coalesce(m.d, e.d) AS d
    FROM book{turn} e LEFT JOIN (
        SELECT part, best % {ENTRIES} AS entry, floor(avg(a))::BIGINT AS a, floor(avg(b))::BIGINT AS b,
               floor(avg(c))::BIGINT AS c, floor(avg(d))::BIGINT AS d
        FROM near{turn} JOIN piece USING (place, part) GROUP BY ALL
    ) m USING (part, entry)
)""")
    return ",".join(steps)


# For vectors of 64 components, as the table has them: four to a part.
SQL = f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id) - 1 AS place, vec_id, label,
           list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS whole
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
piece AS MATERIALIZED (
    SELECT place, part, whole[4 * part + 1] AS a, whole[4 * part + 2] AS b, whole[4 * part + 3] AS c, whole[4 * part + 4] AS d
    FROM kept, range({PARTS}) AS parts(part)
),
book0 AS MATERIALIZED (SELECT part, place AS entry, a, b, c, d FROM piece WHERE place < {ENTRIES}),{_rounds()},
coded AS MATERIALIZED (
    SELECT vec_id, label, string_agg(printf('%02x', best % {ENTRIES}), '' ORDER BY part) AS code, sum(best // {ENTRIES})::BIGINT AS error
    FROM near{ROUNDS} JOIN kept USING (place) GROUP BY place, vec_id, label
),
books AS (
    SELECT sha256(string_agg(a || ',' || b || ',' || c || ',' || d, ',' ORDER BY part, entry)) AS sha FROM book{ROUNDS}
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, sha AS codebooks_sha256
FROM coded, books
"""
