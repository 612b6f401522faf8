"""Document fingerprints from closed syncmers.

A k-mer of code points is a *closed syncmer* when the smallest of its inner s-mers (by hash)
lies at its left or right edge. Whether a k-mer is chosen depends on its own text alone, so
an edit touches only the k-mers it overlaps, and equal passages keep their anchors wherever
they stand. A fingerprint has the hashes of all anchors in the order of the text, with their
positions beside it for positional matching, so it grows with the text; likeness is the exact
Jaccard likeness of two texts' anchor hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import arrow_schema, mixed, parts, per_batch, ship, tasks

K, S = 24, 8
BASE = np.uint64(0x5851F42D4C957F2D)
CHUNK = 1 << 20


def _rolling(codes: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of every window of ``width`` code points, by doubling."""
    total, covered, block, size, power = None, 0, codes, 1, BASE
    with np.errstate(over="ignore"):
        while True:
            if width & size:
                if total is None:
                    total, covered = block, size
                else:
                    n = len(codes) - covered - size + 1
                    total, covered = total[:n] * power + block[covered : covered + n], covered + size
            if covered == width:
                return total
            block = block[: len(block) - size] * power + block[size:]
            size, power = size * 2, power * power


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values, size = np.minimum(values[:-size], values[size:]), size * 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(text: str | None, k: int = K, s: int = S, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Positions (code points) and 32-bit hashes of a text's closed syncmers.

    A text shorter than k is one anchor, an empty or NULL one has none. Long texts go in
    chunks that overlap by k-1, which changes nothing because the choice is context-free.
    """
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if len(codes) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    if len(codes) < k:
        whole = mixed(_rolling(codes.astype(np.uint64) + np.uint64(1), len(codes)))
        return np.zeros(1, np.int64), (whole >> np.uint64(32)).astype(np.uint32)
    places, hashes, inner = [], [], k - s + 1
    for start in range(0, len(codes) - k + 1, chunk):
        piece = codes[start : start + chunk + k - 1].astype(np.uint64) + np.uint64(1)
        small = mixed(_rolling(piece, s))
        least = _window_min(small, inner)
        n = len(least)
        at = np.flatnonzero((small[:n] == least) | (small[inner - 1 : inner - 1 + n] == least))
        places.append(at + start)
        hashes.append((mixed(_rolling(piece, k)[at]) >> np.uint64(32)).astype(np.uint32))
    return np.concatenate(places), np.concatenate(hashes)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two texts' anchor hashes; 1 for two texts without anchors."""
    a, b = np.unique(a), np.unique(b)
    if np.array_equal(a, b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def as_text(found: np.ndarray) -> str:
    return found.astype(">u4").tobytes().hex()


def anchor_rows(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """One row per anchor: doc_id, position long, hash long. Join on ``hash`` to match passages."""

    def run(cols: dict) -> dict:
        out: dict = {"doc_id": [], "position": [], "hash": []}
        for doc_id, text in zip(cols["doc_id"], cols["text"]):
            at, hashes = anchors(text, k, s)
            out["doc_id"] += [doc_id] * len(at)
            out["position"] += at.tolist()
            out["hash"] += hashes.tolist()
        return out

    return per_batch(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, position long, hash long")


def fingerprints(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """doc_id, fingerprint and positions of every text; both empty where a text is NULL or empty."""

    def run(cols: dict) -> dict:
        found = [anchors(t, k, s) for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "fingerprint": [as_text(h) for _, h in found], "positions": [at for at, _ in found]}

    return per_batch(
        docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fingerprint string, positions array<long>"
    )


# --- the edited text: every document beside the next one ------------------------------------


def _blocks(ids: DataFrame, n: int) -> tuple[list[int], dict[int, int | None], list[int]]:
    """Cut points of ``n`` blocks of descending ids; each block's first id; the blocks in order.

    One pass over the id column finds the quantiles, one the first ids; both lists have at
    most ``n`` entries.
    """
    shares = [i / n for i in range(1, n)]
    cuts = ids.agg(F.percentile_approx("doc_id", shares, 10000)).first()[0] if n > 1 else []
    cuts = sorted(set(cuts or []), reverse=True)
    found = ids.groupBy(_block(cuts).alias("block")).agg(F.max("doc_id").alias("first")).collect()
    first = {r["block"]: r["first"] for r in found}
    return cuts, first, sorted(first)


def _block(cuts: list[int]):
    """Number of cut points above an id, in two steps of about √n comparisons; NULL ids come last."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    rows = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    table = F.array(*[F.array(*[F.lit(c).cast("long") for c in row]) for row in rows])
    lasts = F.array(*[F.lit(row[-1]).cast("long") for row in rows])
    passed = F.size(F.filter(lasts, lambda c: c > F.col("doc_id")))
    inside = F.size(F.filter(F.get(table, passed), lambda c: c > F.col("doc_id")))
    return F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(
        F.when(passed < len(rows), passed * step + inside).otherwise(len(cuts))
    )


OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, positions array<long>, edited_positions array<long>"
)


def edited_fingerprints(docs: DataFrame, k: int = K, s: int = S, blocks: int | None = None) -> DataFrame:
    """Fingerprint of every text and of its edited text, and how near they and the next text are.

    The next document follows in descending doc_id (NULL ids last, equal ids by text); after
    the last comes the first, so a lone document is its own next. The edited text has its last
    ⌊n/3⌋ code points replaced by the next text's first as many (all, if it has fewer).
    NULL texts count as empty: empty fingerprint, likeness 1 among themselves, else 0.
    ``positions`` has the place of each anchor of the fingerprint, eight digits of it apiece.

    Texts are shuffled once: ids are cut into blocks by quantiles, a block is sorted and read
    as a stream, and its first row also travels to the block before it.
    """
    spark = docs.sparkSession
    ship(spark)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    cuts, first, order = _blocks(ids, blocks or 2 * tasks(spark))
    if not order:
        return spark.createDataFrame([], OUT)
    before = {b: order[i - 1] for i, b in enumerate(order)}  # the first block's first row ends the last block
    top = range(len(cuts) + 1)
    firsts = F.array(*[F.lit(first.get(b)).cast("long") for b in top])
    befores = F.array(*[F.lit(before.get(b)).cast("int") for b in top])
    places = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("own", _block(cuts).cast("int"))
        .withColumn("leads", F.col("doc_id").eqNullSafe(F.get(firsts, F.col("own"))))
        .withColumn(
            "place",
            F.when(
                F.col("leads"),
                F.array(
                    F.struct(F.col("own").alias("block"), F.lit(0).alias("tail")),
                    F.struct(F.get(befores, F.col("own")).alias("block"), F.lit(1).alias("tail")),
                ),
            ).otherwise(F.array(F.struct(F.col("own").alias("block"), F.lit(0).alias("tail")))),
        )
        .select("doc_id", "text", F.inline("place"))
    )
    ordered = places.repartition(tasks(spark), "block").sortWithinPartitions(
        "block", "tail", F.desc_nulls_last("doc_id"), "text"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, names = arrow_schema(OUT), arrow_schema(OUT).names
        last: tuple | None = None
        for batch in (part for batch in batches for part in parts(batch)):
            out: list[tuple] = []
            for doc_id, text, block, tail in zip(*(batch.column(i).to_pylist() for i in range(4))):
                own = anchors(text, k, s)
                if last is not None and last[0] == block and not last[1]:
                    out.append(_finish(last[2], last[3], last[4], text, own, k, s))
                last = (block, tail, doc_id, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds.field(n).type) for n, c in zip(names, zip(*out))], names)

    return ordered.mapInArrow(run, OUT)


def _finish(doc_id, text: str, own: tuple, after: str, theirs: tuple, k: int, s: int) -> tuple:
    part = len(text) // 3
    edited = text[: len(text) - part] + after[:part]
    new = own if edited == text else anchors(edited, k, s)
    return (
        doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_text(own[1]), as_text(new[1]),
        likeness(own[1], new[1]), likeness(own[1], theirs[1]), own[0], new[0],
    )
