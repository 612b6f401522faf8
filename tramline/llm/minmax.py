"""Near-duplicate documents: min-max hashing, banding, exact confirmation, components.

Each of ``HASHES`` permutations of the shingle hashes yields two signature values, its
minimum and its maximum, so a signature of 2 × HASHES values costs HASHES evaluations; the
two collide with the Jaccard similarity each and are negatively correlated, which makes the
estimate unbiased with a lower variance than as many independent minima. ``BANDS`` bands of
``ROWS`` values (half of the bands over minima, half over maxima) choose the candidates: a
pair at similarity 0.75 shares no band with probability (1 - 0.75^5)^40 = 2e-5, one at 0.85
with 2e-10.

Documents with the same set of shingles are one node from the start. First each member of a
bucket is checked against the bucket's smallest, and what that joins becomes one component,
so a group of thousands of copies costs a check for each copy, not for each pair. Members of
a bucket whose components still differ are then compared with each other, in pairs of blocks
of at most ``BLOCK`` members and about ``BLOCK_SHINGLES`` shingles: a task holds two blocks
with their sets and returns only confirmed links. A pair goes to the exact check in one of
its common buckets, and only if its signatures agree in ``AGREE`` of 200 places, 4.1 standard
deviations below what similarity 0.75 gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import cache, keep, mixed, odd_numbers, per_batch, release, ship
from tramline.llm.graph import components

WORDS, PERCENT = 5, 75
HASHES, BANDS, ROWS, AGREE = 100, 40, 5, 125
BLOCK, BLOCK_SHINGLES, STRIP = 512, 1 << 20, 32
SEED = 20240229
_PLACE = odd_numbers(7, WORDS)
_ACROSS = odd_numbers(SEED, HASHES)
_FACTOR = (_ACROSS >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SHIFT = _ACROSS.astype(np.uint32)
_BAND = odd_numbers(SEED + 1, ROWS)


class _WordHashes(dict):
    """64-bit hashes of words, remembered for up to 100,000 of them (about 20 MB)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_words = _WordHashes()
cache("words", _words.clear)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles.

    A-Z are lower-cased, words are split at space and \\x09-\\x0D. Fewer words than a shingle:
    the whole sequence is one shingle; no word, or NULL: none.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        each = np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))
        place = _PLACE if words == WORDS else odd_numbers(7, words)
        if len(each) < words:
            return mixed((each * place[: len(each)]).sum(keepdims=True) + np.uint64(len(each)))
        n = len(each) - words + 1
        total = each[:n] * place[0]
        for i in range(1, words):
            total = total + each[i : i + n] * place[i]
        return np.unique(mixed(total))


def signature(found: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the shingles under each permutation: uint32[2, HASHES]."""
    small = (found >> np.uint64(32)).astype(np.uint32)
    out = np.empty((2, HASHES), np.uint32)
    out[0], out[1] = np.uint32(0xFFFFFFFF), np.uint32(0)
    for start in range(0, len(small), 4096):
        values = small[None, start : start + 4096] * _FACTOR[:, None] + _SHIFT[:, None]
        np.minimum(out[0], values.min(axis=1), out=out[0])
        np.maximum(out[1], values.max(axis=1), out=out[1])
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """int64[documents, BANDS] of uint32[documents, 2, HASHES]."""
    with np.errstate(over="ignore"):
        parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
        number = np.arange(BANDS, dtype=np.uint64) << np.uint64(40)
        return mixed((parts * _BAND).sum(axis=2) + number).view(np.int64)


def _digest(found: np.ndarray) -> str | None:
    return xxhash.xxh3_128_hexdigest(found.tobytes()) if len(found) else None


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest of the set, band keys, low 16 bits of the signature;
    the last three are NULL for an empty set."""

    def run(cols: dict) -> dict:
        sets = [shingles(t) for t in cols["text"]]
        full = [i for i, s in enumerate(sets) if len(s)]
        keys: list = [None] * len(sets)
        lows: list = [None] * len(sets)
        if full:
            values = np.stack([signature(sets[i]) for i in full])
            for i, row, low in zip(full, band_keys(values), (values & 0xFFFF).reshape(len(full), -1).astype(np.int32)):
                keys[i], lows[i] = row, low
        return {
            "doc_id": cols["doc_id"], "text_hash": cols["text_hash"], "n_shingles": [len(s) for s in sets],
            "digest": [_digest(s) for s in sets], "bands": keys, "low": lows,
        }

    return per_batch(
        docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text"), run,
        "doc_id long, text_hash long, n_shingles long, digest string, bands array<long>, low array<int>", "words",
    )


def _alike(n, m):
    """Sizes that can reach the similarity at all: the intersection is at most the smaller."""
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def _linked(x: bytes, y: bytes) -> bool:
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets reach the similarity."""
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("_a"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("_b"))

    def run(cols: dict) -> dict:
        linked = [i for i, (x, y) in enumerate(zip(cols["_a"], cols["_b"])) if _linked(x, y)]
        return {"a": [cols["a"][i] for i in linked], "b": [cols["b"][i] for i in linked]}

    return per_batch(pairs.join(one, "a").join(two, "b").select("a", "b", "_a", "_b"), run, "a long, b long")


def _blocks(placed: DataFrame) -> DataFrame:
    """Members of split buckets (key, id, n, hub, component), each once per pair of blocks it is in."""
    ceil = lambda x, most: F.ceil(x / F.lit(most)).cast("int")
    split = (
        placed.groupBy("key")
        .agg(
            F.min("component").alias("lo"), F.max("component").alias("hi"),
            F.greatest(ceil(F.count("*"), BLOCK), ceil(F.sum("n"), BLOCK_SHINGLES)).alias("blocks"),
        )
        .where("lo < hi").select("key", "blocks")
    )
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    return placed.join(split, "key").withColumn("block", block)


def _block_links(rows: DataFrame) -> DataFrame:
    """Confirmed links (a, b) between members of one bucket whose components differ.

    ``rows``: key, x, y (the pair of blocks), block, id, n, hub, component, bands, low,
    shingles. Groups of (key, x, y) arrive sorted, one after the other.
    """
    names = ["key", "x", "y"]

    def links_of(pieces: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        part = pa.Table.from_batches(pieces).combine_chunks()
        col = {c: part[c].to_numpy() for c in ("key", "x", "y", "block", "id", "n", "hub", "component")}
        key, x, y = (col[c][0] for c in names)
        if x == y:
            left = right = np.arange(part.num_rows)
        else:
            left, right = np.flatnonzero(col["block"] == x), np.flatnonzero(col["block"] == y)
        flat = lambda c, width: part[c].combine_chunks().flatten().to_numpy().reshape(-1, width)
        bands, low = flat("bands", BANDS), flat("low", 2 * HASHES).astype(np.uint16)
        sets = part["shingles"]
        ids, n, component = col["id"], col["n"], col["component"]
        root: dict[int, int] = {}

        def top(c: int) -> int:
            while (above := root.get(c, c)) != c:
                root[c] = root.get(above, above)
                c = above
            return c

        out = []
        for start in range(0, len(left), STRIP):
            i, j = left[start : start + STRIP, None], right[None, :]
            wanted = (component[i] != component[j]) & (ids[i] != col["hub"][i]) & (ids[j] != col["hub"][j])
            wanted &= 100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])
            if x == y:
                wanted &= i < j
            a, b = np.nonzero(wanted)
            a, b = left[start + a], right[b]
            alike = (low[a] == low[b]).sum(axis=1) >= AGREE
            a, b = a[alike], b[alike]
            # Once, not in every common bucket: in that of the first common band.
            first = (bands[a] == bands[b]).argmax(axis=1)
            here = bands[a, first] == key
            for p, q in zip(a[here].tolist(), b[here].tolist()):
                one, two = top(int(component[p])), top(int(component[q]))
                if one != two and _linked(sets[p].as_py(), sets[q].as_py()):
                    root[max(one, two)] = min(one, two)
                    out.append((int(ids[p]), int(ids[q])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()

        def found() -> Iterator[list[tuple[int, int]]]:
            current, pieces = None, []
            for batch in batches:
                if not batch.num_rows:
                    continue
                at = np.stack([batch.column(c).to_numpy() for c in names])
                cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
                for start, end in zip(cuts, cuts[1:]):
                    if current is not None and (at[:, start] != current).any():
                        yield links_of(pieces)
                        pieces = []
                    current = at[:, start]
                    pieces.append(batch.slice(start, end - start))
            if pieces:
                yield links_of(pieces)

        for some in found():
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*some)], ["a", "b"])

    ship(rows.sparkSession)
    dealt = rows.repartition(*names).sortWithinPartitions(*names)
    return dealt.mapInArrow(run, "a long, b long")


def links(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (digest, node, id, text_hash) and confirmed links (a, b) between nodes.

    A node is a set of shingles: ``id`` is the smallest doc_id that has it, ``text_hash`` that of
    one of its texts there. ``node`` is the id itself for the first digest of an id, and a 64-bit
    hash of the digest for others, so different texts of one id are different nodes.
    The links span every component; they are not all links within it.
    """
    nodes = keep(
        found.where("digest IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("digest")
        .agg(
            F.min(F.struct("doc_id", "text_hash")).alias("least"), F.first("n_shingles").alias("n"),
            F.first("bands").alias("bands"), F.first("low").alias("low"),
        )
        .select("digest", F.col("least.doc_id").alias("id"), F.col("least.text_hash").alias("text_hash"), "n", "bands", "low"),
        "nodes",
    )
    repeated = keep(
        nodes.groupBy("id").agg(F.min("digest").alias("_first"), F.count("*").alias("_digests")).where("_digests > 1").select("id", "_first"),
        "repeated",
    )
    node = F.when(F.col("digest") != F.col("_first"), F.xxhash64("digest")).otherwise(F.col("id"))
    nodes = nodes.join(repeated, "id", "left").withColumn("node", node).drop("_first")
    rows = nodes.select(F.col("node").alias("id"), F.col("id").alias("least"), "n", F.explode("bands").alias("key"))
    buckets = (
        rows.groupBy("key")
        .agg(F.min(F.struct("least", "id", "n")).alias("hub"), F.count("*").alias("members"))
        .where("members > 1")
        .select("key", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n"))
    )
    members = keep(rows.drop("least").join(buckets, "key"), "members")
    wanted = members.select(F.col("id").alias("node")).distinct().join(nodes.select("node", "id", "text_hash", "digest"), "node")
    sets = keep(_sets(docs, wanted), "sets")
    first = members.where("id <> hub").where(_alike(F.col("n"), F.col("hub_n")))
    hubs = keep(_confirmed(first.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), sets), "hubs")
    so_far = components(hubs, "stars")
    placed = members.join(so_far, "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = keep(_blocks(placed.select("key", "id", "n", "hub", "component")), "placed")
    pair = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = (
        placed.join(nodes.select(F.col("node").alias("id"), "bands", "low"), "id").join(sets, "id")
        .withColumn("other", pair)
        .select(
            "key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
            "block", "id", "n", "hub", "component", "bands", "low", "shingles",
        )
    )
    return nodes.select("digest", "node", "id", "text_hash"), hubs.unionByName(keep(_block_links(rows), "more"))


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """id (the node) and whole shingle set of ``nodes`` (node, id, text_hash, digest)."""

    def run(cols: dict) -> dict:
        out: dict = {"id": [], "shingles": []}
        for node, digest, text in zip(cols["node"], cols["digest"], cols["text"]):
            found = shingles(text)
            if _digest(found) == digest:
                out["id"].append(node)
                out["shingles"].append(found.tobytes())
        return out

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_hash"), "text")
    texts = texts.join(nodes, ["id", "text_hash"]).select("node", "digest", "text")
    return per_batch(texts, run, "id long, shingles binary", "words").dropDuplicates(["id"])


def _by_id(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``links`` (a, b) with the smallest doc_id of each node."""
    others = keep(nodes.where("node <> id").select("node", "id"), "others")
    for end in ("a", "b"):
        named = others.select(F.col("node").alias(end), F.col("id").alias("_id"))
        links = links.join(named, end, "left").withColumn(end, F.coalesce("_id", end)).drop("_id")
    return links.select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id reachable by links of similarity 0.75 or more
    between sets of five-word shingles. Empty sets (NULL, empty or blank texts) link with
    nothing and are kept. Rows that share a doc_id are one document. A row with a NULL doc_id
    takes part in no link: component NULL, kept.
    """
    found = keep(signatures(docs), "signatures")
    nodes, joined = links(docs, found)
    # Links are confirmed between texts; from here on, rows of one doc_id are the same document.
    same = (
        found.where("digest IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "digest").join(nodes.select("digest", "id"), "digest")
        .where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    )
    final = components(_by_id(joined, nodes).unionByName(same), "components")
    return (
        found.select("doc_id", "n_shingles")
        .join(final.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("component", "doc_id").alias("component_id"),
            F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
        )
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one text of each group of near copies, that with the smallest doc_id.

    Different texts under one doc_id are not copies of each other. Of rows with one doc_id and
    one text, the one that comes first as JSON stays. Rows with a NULL doc_id or an
    empty set stay.
    """
    found = keep(signatures(docs), "signatures")
    nodes, joined = links(docs, found)
    linked = keep(nodes.join(components(joined, "components").withColumnRenamed("id", "node"), "node"), "linked")
    # A node hashed from its digest may name a component: the text that stays is the one with the smallest id.
    least = linked.groupBy("component").agg(F.min(F.struct("id", "node")).alias("least"))
    others = linked.join(least, "component").where(F.col("node") != F.col("least.node")).select("node")
    left = nodes.join(others, "node", "left_anti").select(F.col("id").alias("doc_id"), "text_hash")
    counts = keep(
        found.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
        .join(left.withColumn("stays", F.lit(True)), ["doc_id", "text_hash"], "left"),
        "counts",
    )

    def of(rows: DataFrame, some: DataFrame, how: str) -> DataFrame:
        some = some.select(F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash"))
        same = (rows["doc_id"].cast("long") == some["_doc_id"]) & (F.xxhash64(rows["text"]) == some["_text_hash"])
        return rows.join(some, same, how)

    single = of(docs, counts.where("stays IS NULL OR n > 1"), "left_anti")
    repeated = counts.where("stays AND n > 1")
    if not repeated.limit(1).count():
        return single
    least = of(docs, repeated, "left_semi").groupBy(F.col("doc_id").cast("long"), F.xxhash64("text"))
    # By the row as JSON: a map among the columns has no order of its own.
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return single.unionByName(least.agg(F.min_by(row, F.to_json(row)).alias("_row")).select("_row.*"))
