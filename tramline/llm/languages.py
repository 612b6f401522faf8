"""Language identification by rank-order n-gram profiles.

A profile lists the most frequent n-grams (one to three letters, words padded by a blank) of
a language's training texts in order. A document's own list is compared with each profile by
the out-of-place distance: the sum over its n-grams of how far their ranks lie apart, with
the greatest distance for those a profile lacks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.llm.common import crc_of_id, per_batch, tasks

RANKS = 400
SAMPLE = 2_000
UNKNOWN = "und"
BITS, CHUNK = np.uint64(21), 1 << 20
SPACE = 32
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """For every code point whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the n-grams of a text's letters, lower-cased; code points of 21 bits side by side.

    Runs of other characters are one blank; a blank alone is no n-gram. Long texts are
    counted in chunks that share two characters.
    """
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _is_letter()[codes]
    if not letter.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    line = np.concatenate(([SPACE], np.where(letter, codes, SPACE), [SPACE])).astype(np.uint64)
    stays = np.concatenate(([True], (line[1:] != SPACE) | (line[:-1] != SPACE)))
    line = line[stays]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for start in range(0, len(line), CHUNK):
        piece = line[start : start + CHUNK + 2]
        n = min(CHUNK, len(piece))
        one = piece[:n]
        two = (piece[: min(n, len(piece) - 1)] << BITS) | piece[1 : 1 + min(n, len(piece) - 1)]
        three = (two[: max(0, min(n, len(piece) - 2))] << BITS) | piece[2 : 2 + max(0, min(n, len(piece) - 2))]
        grams = np.sort(np.concatenate((one[one != SPACE], two, three)))
        at = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
        found.append((grams[at], np.diff(np.append(at, len(grams)))))
    if len(found) == 1:
        return found[0]
    keys, place = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(place, np.concatenate([c for _, c in found])).astype(np.int64)


def ranked(keys: np.ndarray, counts: np.ndarray, ranks: int = RANKS) -> np.ndarray:
    """The most frequent codes, most frequent first, ties by code."""
    if len(keys) > ranks:
        least = np.partition(counts, len(counts) - ranks)[len(counts) - ranks]
        chosen = counts >= least
        keys, counts = keys[chosen], counts[chosen]
    return keys[np.lexsort((keys, -counts))][:ranks]


def _chosen(rows: DataFrame, sample: int) -> DataFrame:
    """_doc_id and _lang of the ``sample`` rows a language with the smallest hashes of their ids."""
    ids = rows.select(F.col("doc_id").alias("_doc_id"), F.col("lang").alias("_lang")).withColumn("_hash", F.xxhash64("_doc_id"))
    # First within buckets of a language, so that no task ranks all ids of a frequent one.
    ids = ids.withColumn("_bucket", F.pmod(F.xxhash64("_hash", F.spark_partition_id()), F.lit(tasks(rows.sparkSession))))
    for part in (["_lang", "_bucket"], ["_lang"]):
        order = Window.partitionBy(*part).orderBy("_hash", "_doc_id")
        ids = ids.withColumn("_turn", F.row_number().over(order)).where(F.col("_turn") <= sample).drop("_turn")
    return ids.select("_doc_id", "_lang").distinct()


def profiles(docs: DataFrame, sample: int = SAMPLE, ranks: int = RANKS, training=None) -> dict[str, list[int]]:
    """Profile of each language from rows (doc_id, text, lang) with a language.

    Learns from at most ``sample`` documents a language, those with the smallest hashes of
    their ids (and from rows where ``training`` holds). The result has ``ranks`` numbers a
    language.
    """
    rows = docs.select("doc_id", "text", "lang").where("lang IS NOT NULL").where(F.lit(True) if training is None else training)
    chosen = _chosen(rows, sample)
    texts = rows.join(F.broadcast(chosen), (F.col("doc_id") == F.col("_doc_id")) & (F.col("lang") == F.col("_lang")), "left_semi")

    def run(cols: dict) -> dict:
        totals: dict[str, tuple[list, list]] = {}
        for lang, text in zip(cols["lang"], cols["text"]):
            keys, counts = ngrams(text)
            mine = totals.setdefault(lang, ([], []))
            mine[0].append(keys)
            mine[1].append(counts)
        out: dict = {"lang": [], "gram": [], "n": []}
        for lang, (keys, counts) in totals.items():
            every, place = np.unique(np.concatenate(keys), return_inverse=True)
            out["lang"] += [lang] * len(every)
            out["gram"] += every.astype(np.int64).tolist()
            out["n"] += np.bincount(place, np.concatenate(counts)).astype(np.int64).tolist()
        return out

    grams = per_batch(texts.select("lang", "text"), run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = grams.withColumn("place", place).where(F.col("place") <= ranks).collect()
    found: dict[str, list[int]] = {}
    for row in sorted(top, key=lambda r: (r["lang"], r["place"])):
        found.setdefault(row["lang"], []).append(row["gram"])
    return found


def identify(docs: DataFrame, learned: dict[str, list[int]], ranks: int = RANKS) -> DataFrame:
    """doc_id, lang_pred, score of every row of (doc_id, text).

    ``score`` is one less the ratio of the smallest distance to the second smallest (1 with one
    language). Equal distances go to the language that sorts first. NULL texts and texts
    without a letter, and any text if nothing was learned: ``und`` with score 0.
    """
    names = sorted(learned)
    grams = np.array(sorted({g for found in learned.values() for g in found}), np.uint64)
    table = np.full((len(names), len(grams) + 1), -1, np.int64)
    for i, name in enumerate(names):
        table[i, np.searchsorted(grams, np.array(learned[name], np.uint64))] = np.arange(len(learned[name]))

    def one(text: str | None) -> tuple[str, float]:
        own = ranked(*ngrams(text), ranks)
        if not len(own) or not names:
            return UNKNOWN, 0.0
        at = np.searchsorted(grams, own)
        at[(at == len(grams)) | (grams[np.minimum(at, len(grams) - 1)] != own)] = len(grams)
        theirs = table[:, at]
        apart = np.where(theirs < 0, ranks, np.abs(theirs - np.arange(len(own)))).sum(axis=1)
        best = int(apart.argmin())
        if len(names) == 1:
            return names[0], 1.0
        second = np.partition(apart, 1)[1]
        return names[best], float(1 - apart[best] / second) if second else 0.0

    def run(cols: dict) -> dict:
        found = [one(t) for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

    return per_batch(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, lang_pred string, score double")


def held_out():
    """Rows kept from learning: crc32 of the id divisible by five; a NULL id is not held out."""
    return F.coalesce(crc_of_id() % 5 == 0, F.lit(False))


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of all ``docs``, learned from those not held out."""
    found = identify(docs, profiles(docs, training=~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
