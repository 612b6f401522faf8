"""Importance resampling towards a target distribution, by hashed word features.

A batch's texts are joined with separators into one buffer and one regular-expression pass
finds all words of it. ``searchsorted`` over the texts' offsets tells each word's document;
n-grams whose first and last word lie in different documents are masked, and ``bincount``
adds up the buckets of the rest. Bucket counts of the corpus and of the target give each
bucket a gain; a document's weight is the mean gain of its features. Documents are drawn
without replacement by weight plus seeded Gumbel noise.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import keep, parts, per_batch, release, ship
from tramline.operators.ordered import numbered

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
# On lower-cased UTF-8 bytes: ASCII digits and letters, and every byte of a character beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SEPARATOR = b"\x00"


class Buckets(dict):
    """Bucket by feature (bytes); worked out once per feature and batch."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        self[feature] = bucket = zlib.crc32(feature) % self.buckets
        return bucket


def features(texts: list[str | None], longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, bucket) of every feature of a batch, and each document's number of words.

    Features are all runs of 1 to ``longest`` words, joined by one space. A NULL text has none.
    """
    encoded = [(text or "").encode("utf-8", "surrogatepass").lower() for text in texts]
    starts = np.cumsum([0, *(len(text) + 1 for text in encoded)])[:-1]
    found = list(WORD.finditer(SEPARATOR.join(encoded)))
    words = [m.group() for m in found]
    at = np.fromiter((m.start() for m in found), np.int64, len(found))
    owner = np.searchsorted(starts, at, side="right") - 1
    known = Buckets(buckets)
    owners, hashed = [], []
    for n in range(1, longest + 1):
        grams = words if n == 1 else [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
        inside = owner[: len(grams)] == owner[n - 1 :] if n > 1 else slice(None)
        owners.append(owner[: len(grams)][inside])
        hashed.append(np.fromiter(map(known.__getitem__, grams), np.int64, len(grams))[inside])
    return np.concatenate(owners), np.concatenate(hashed), np.bincount(owner, minlength=len(texts))


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> list[int]:
    """How many features of all rows of ``texts`` (text) fall into each bucket. A task sends a
    row per bucket it met; the driver gets ``buckets`` numbers."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total = np.zeros(buckets, np.int64)
        for part in (part for batch in batches for part in parts(batch)):
            total += np.bincount(features(part.column(0).to_pylist(), longest, buckets)[1], minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])

    sums = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = [0] * buckets
    for row in sums.collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains(source: list[int], target: list[int]) -> np.ndarray:
    """A thousand times the log ratio of each bucket's smoothed shares in target and source, floored."""
    n, all_s, all_t = len(source), float(sum(source)), float(sum(target))
    return np.array(
        [math.floor(1000 * math.log((t + 1.0) * (all_s + n) / ((s + 1.0) * (all_t + n)))) for s, t in zip(source, target)],
        np.int64,
    )


def weights(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_features, n_words, weight: the floored mean gain of a document's features, 0 without any."""

    def run(cols: dict) -> dict:
        n = len(cols["text"])
        owner, bucket, words = features(cols["text"], longest, len(gain))
        count = np.bincount(owner, minlength=n)
        # Sums of integers below 2^53 are exact in doubles.
        total = np.bincount(owner, gain[bucket].astype(np.float64), minlength=n).astype(np.int64)
        return {
            "doc_id": cols["doc_id"], "n_features": count.tolist(), "n_words": words.tolist(),
            "weight": np.where(count > 0, total // np.maximum(count, 1), 0).tolist(),
        }

    schema = "doc_id long, n_features long, n_words long, weight long"
    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def resampled(
    docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs`` (doc_id, text, ...).

    Of the N rows with at least ``least_words`` words, the floor(percent * N / 100) highest
    scores are drawn, ties to the smaller doc_id, and ranked from 1; other rows have rank NULL.
    A NULL text has no features; a NULL doc_id is hashed as an empty one and comes last among
    ties. Rows that repeat a doc_id are drawn each by its own text. Other columns are not read;
    an empty table gives an empty result, an empty target smoothed gains.
    """
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    drawn = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0)))
    scored = keep(weights(docs, gain, longest).withColumn("score", F.col("weight") + noise), "scored")
    able = scored.where(F.col("n_words") >= least_words)
    quota = percent * able.count() // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    ranked = numbered(able, order, "rank")
    rank = F.when(F.col("rank") <= quota, F.col("rank")).cast("long")
    out = ["doc_id", "n_features", "weight", "score"]
    rest = scored.where(F.col("n_words") < least_words).select(*out, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*out, rank.alias("rank")).unionByName(rest)


# CRC-32 of each distinct word, bit by bit.
SQL = f"""
WITH text AS (
    SELECT 0 AS kind, doc_id AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents
    UNION ALL
    SELECT 1, item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
),
word AS MATERIALIZED (
    SELECT kind, id, unnest(regexp_extract_all(body, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM text
),
crc AS MATERIALIZED (
    SELECT w, xor(list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(range(strlen(w)), lambda i: ('0x' || hex(w)[2 * i + 1 : 2 * i + 2])::BIGINT)),
        lambda state, byte: list_reduce(
            list_prepend(xor(state, byte), range(8)),
            lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END
        )
    ), 4294967295::BIGINT) % {BUCKETS} AS bucket
    FROM (SELECT DISTINCT w FROM word)
),
feature AS MATERIALIZED (SELECT kind, id, bucket FROM word JOIN crc USING (w)),
share AS (SELECT bucket, count_if(kind = 0) AS s, count_if(kind = 1) AS t FROM feature GROUP BY bucket),
whole AS (SELECT count_if(kind = 0) AS s, count_if(kind = 1) AS t FROM feature),
gain AS (
    SELECT bucket, floor(1000 * ln(((share.t + 1) * (whole.s + {BUCKETS})::DOUBLE) / ((share.s + 1) * (whole.t + {BUCKETS})::DOUBLE)))::BIGINT AS gain
    FROM share, whole
),
weighed AS (
    SELECT id, count(*) AS n, floor(sum(gain) / count(*))::BIGINT AS weight FROM feature JOIN gain USING (bucket) WHERE kind = 0 GROUP BY id
),
scored AS (
    SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM documents LEFT JOIN weighed ON id = doc_id
),
placed AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS able
    FROM scored WHERE n_features >= {LEAST_WORDS}
)
SELECT scored.doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * able // 100 THEN rank END AS rank
FROM scored LEFT JOIN placed USING (doc_id)
"""
