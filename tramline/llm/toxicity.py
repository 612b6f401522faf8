"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

A lexicon of words and word beginnings, some as such and some only where they are frequent in
a text, is mined from labelled training documents. Each entry and some patterns of use vote on
every document; a voter that stays silent is evidence too. A generative model with a hidden
label estimates each voter's rates, and the correlations of voters given the label, from the
votes on all documents, without labels. Its posteriors are the labels a logistic regression
learns.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import crc_of_id, keep, per_batch

SAMPLE = 20_000
ALWAYS, PRECISION, DISCOVERY = 0.9, 0.92, 0.05
BEGINNINGS = (4, 5, 6)
# What an entry asks of a text: the word so often at least, and among so many words once at least (0: any).
LEVELS = ((1, 0), (1, 100), (2, 200), (2, 100))
THRESHOLD = 0.7
SEED = 5
_WORD = re.compile(r"[^\W\d_]+")
# Numbers of a document besides its entries: distinct entries, share of its words, log of their count.
EXTRA = 3
# Voters besides the entries.
PATTERNS = 4


def _units(words: list[str]) -> Counter:
    """How often lower-case words, and beginnings of words marked by a star, occur."""
    found: Counter = Counter()
    for word, n in Counter(words).items():
        found[word] += n
        for length in BEGINNINGS:
            if len(word) >= length:
                found[word[:length] + "*"] += n
    return found


def _asks(level: int, n: int, words: int) -> bool:
    least, per = LEVELS[level]
    return n >= least and (n * per >= words or not per)


def _words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def training():
    """Rows whose labels may be learned from: crc32 of the id modulo three is not one."""
    return F.coalesce(crc_of_id() % 3 != 1, F.lit(True))


def lexicon(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[str], list[float]]:
    """Words and beginnings typical of toxic documents, most typical first; a percent sign and
    a number follow those that count only where frequent (``LEVELS``). And the share of clean and of toxic sample
    texts that have any of them.

    Counts in how many toxic and other texts each meets each level, over at most
    ``sample`` labelled training rows (smallest hashes of the id); equal texts of one label
    count once. An entry occurs in toxic texts for the most part (``PRECISION``, with half a
    clean text added), and more often than by chance: the tail of its binomial distribution is
    bounded by Chernoff's inequality, and all entries pass whose bounds keep the expected share
    of false ones below ``DISCOVERY`` among all units tried (Benjamini and Hochberg). One that
    hardly ever (``ALWAYS``) comes without an entry more typical is left out: it says the same,
    or marks the texts around that, such as copies.
    """
    rows = labels.where(training()).where("toxic IS NOT NULL AND doc_id IS NOT NULL")
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("_doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = F.broadcast(rows.orderBy(F.xxhash64(F.lit(SEED), "_doc_id"), "_doc_id").limit(sample))
    texts = docs.select("doc_id", "text").join(chosen, F.col("doc_id").cast("long") == F.col("_doc_id"))
    texts = keep(texts.select("text", (F.col("toxic") == 1).cast("int").alias("toxic")).distinct(), "labelled")

    def run(cols: dict) -> dict:
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(cols["text"], cols["toxic"]):
            words = _words(text)
            for unit, n in _units(words).items():
                found = counts.setdefault(unit, [0] * len(names))
                for level in range(len(LEVELS)):
                    found[2 * level + toxic] += _asks(level, n, len(words))
        return {"unit": list(counts), **{name: [c[i] for c in counts.values()] for i, name in enumerate(names)}}

    names = [f"{kind}{level}" for level in range(len(LEVELS)) for kind in ("clean", "toxic")]
    found = per_batch(texts, run, "unit string, " + ", ".join(f"{n} long" for n in names))
    found = keep(found.groupBy("unit").agg(*(F.sum(n).alias(n) for n in names)), "units")
    totals = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not totals.get(1) or not totals.get(0):
        return [], [0.0, 0.0]
    usual = totals[1] / (totals[0] + totals[1])
    tried = len(LEVELS) * found.count()
    levels = ", ".join(f"unit || '{f'%{i}' if i else ''}', clean{i}, toxic{i}" for i in range(len(LEVELS)))
    every = found.selectExpr(f"stack({len(LEVELS)}, {levels}) AS (unit, clean, toxic)")
    share = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    against = F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - share) / (1 - usual))).otherwise(0.0)
    best = (
        every.where(F.col("toxic") >= PRECISION * (F.col("toxic") + F.col("clean") + 0.5))
        .where(share > usual).withColumn("weight", F.col("toxic") * F.log(share / usual) + against)
        .where(F.col("weight") >= -np.log(DISCOVERY)).orderBy(F.desc("weight"), F.length("unit"), "unit").collect()
    )
    bounds = np.exp([-r["weight"] for r in best])
    passed = np.flatnonzero(bounds <= DISCOVERY * np.arange(1, len(best) + 1) / tried)
    ordered = [r["unit"] for r in best[: passed[-1] + 1]] if len(passed) else []
    # Entries more typical that an entry nearly always meets in toxic texts; only these lists come to the driver.
    pairs = hits(texts.where("toxic = 1").withColumn("doc_id", F.lit(0)), ordered).select("hits", F.explode("hits").alias("a"))
    pairs = pairs.select("a", F.explode("hits").alias("b")).where("b <= a").groupBy("a", "b").agg(F.count("*").alias("n"))
    met = pairs.groupBy("a").agg(F.max("n").alias("own"), F.collect_list(F.struct("n", "b")).alias("met"))
    always = F.filter("met", lambda m: (m["n"] >= ALWAYS * F.col("own")) & (m["b"] < F.col("a")))["b"]
    says_too = {r["a"]: r["b"] for r in met.select("a", always.alias("b")).collect()}
    chosen_at: list[int] = []
    taken: set[int] = set()
    for j in range(len(ordered)):
        if taken.isdisjoint(says_too[j]):
            chosen_at.append(j)
            taken.add(j)
    final = [ordered[j] for j in chosen_at]
    any_hit = F.sum((F.size("hits") > 0).cast("int"))
    shares = hits(texts.withColumnRenamed("toxic", "doc_id"), final).groupBy("doc_id").agg(((any_hit + 1) / (F.count("*") + 2)).alias("share"))
    known = {r["doc_id"]: r["share"] for r in shares.collect()}
    return final, [known[0], known[1]]


def hits(docs: DataFrame, entries: list[str]) -> DataFrame:
    """doc_id, text_hash, hits (numbers of the entries a whole text has), n_hits, n_words, shouting.

    ``n_hits`` counts words that match any of these entries, repeats included; ``shouting`` is
    the number of exclamation marks.
    """
    # Levels and entries by unit.
    numbers: dict[str, list[tuple[int, int]]] = {}
    for i, e in enumerate(entries):
        unit, _, level = e.partition("%")
        numbers.setdefault(unit, []).append((int(level or 0), i))
    whole = {u for u in numbers if not u.endswith("*")}
    begins = {n: {u[:-1] for u in numbers if u.endswith("*") and len(u) == n + 1} for n in BEGINNINGS}

    def run(cols: dict) -> dict:
        out: dict = {"doc_id": cols["doc_id"], "text_hash": cols["text_hash"], "hits": [], "n_hits": [], "n_words": [], "shouting": []}
        for text in cols["text"]:
            words = _words(text)
            distinct = set(words)
            matched = {w: [w] for w in distinct & whole}
            for n, known in begins.items():
                for start in {w[:n] for w in distinct} & known if known else ():
                    for w in distinct:
                        if len(w) >= n and w.startswith(start):
                            matched.setdefault(w, []).append(start + "*")
            times = Counter(w for w in words if w in matched) if matched else {}
            of_unit: Counter = Counter()
            for w, n in times.items():
                for unit in matched[w]:
                    of_unit[unit] += n
            voted = {u: [i for level, i in numbers[u] if _asks(level, n, len(words))] for u, n in of_unit.items()}
            out["hits"].append(sorted(i for found in voted.values() for i in found))
            out["n_hits"].append(sum(n for w, n in times.items() if any(voted[u] for u in matched[w])))
            out["n_words"].append(len(words))
            out["shouting"].append((text or "").count("!"))
        return out

    return per_batch(
        docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text"), run,
        "doc_id long, text_hash long, hits array<int>, n_hits long, n_words long, shouting long",
    )


def _votes(entries: int):
    """Numbers of the voters that speak: entries, then patterns of use."""
    share = F.col("n_hits") / F.greatest(F.col("n_words"), F.lit(1))
    patterns = [F.size("hits") >= 2, F.col("n_hits") >= 3, share >= 0.01, F.col("shouting") >= 3]
    return F.concat("hits", F.array_compact(F.array(*[F.when(p, entries + i) for i, p in enumerate(patterns)])))


class LabelModel:
    """Rates of each voter given the hidden label, their correlations, the share of toxic documents.

    One voter is known: whether any entry occurs, with its rates in labelled clean and toxic
    texts (``known``); it holds the hidden label to what the labels mean.
    Expectation-maximisation over all documents: Spark counts single voters and pairs under
    each label, only numbers by voter or pair of voters come to the driver. Voters correlated
    given the label say the same thing twice, so a voter's evidence counts by one over the sum
    of its squared correlations with all voters (itself included).

    ``votes``: (votes, n), a written table of distinct lists of voters that spoke, with the
    number of documents.
    """

    def __init__(self, votes: DataFrame, entries: int, known: list[float], rounds: int = 15):
        self.entries, self.known = entries, np.clip(known, 1e-4, 1 - 1e-4)
        size = entries + PATTERNS
        seen = F.exists("votes", lambda v: v < entries)
        post = F.when(seen, 0.95).otherwise(0.02)
        for _ in range(rounds):
            # A voter that always speaks, to count documents.
            all_votes = F.concat("votes", F.array(F.lit(size)))
            pairs = votes.select("n", post.alias("post"), F.explode(all_votes).alias("a"), all_votes.alias("with"))
            pairs = pairs.select("n", "post", "a", F.explode("with").alias("b")).where("a <= b").groupBy("a", "b")
            sums = pairs.agg(F.sum(F.col("n") * (1 - F.col("post"))).alias("no"), F.sum(F.col("n") * F.col("post")).alias("yes"))
            counts = np.zeros((2, size + 1, size + 1))
            for r in sums.collect():
                for y, name in enumerate(("no", "yes")):
                    counts[y, r["a"], r["b"]] = counts[y, r["b"], r["a"]] = r[name]
            before = getattr(self, "rates", None)
            self._estimate(counts)
            if before is not None and np.abs(before - self.rates).max() < 1e-4:
                break
            gain, quiet, none = self._evidence()
            spoke = F.aggregate("votes", F.lit(quiet), lambda total, v: total + F.element_at(F.lit(gain), v + 1))
            score = spoke + F.when(seen, float(none[1])).otherwise(float(none[0]))
            post = 1 / (1 + F.exp(-F.greatest(F.least(score, F.lit(30.0)), F.lit(-30.0))))

    def _estimate(self, counts: np.ndarray) -> None:
        size = counts.shape[1] - 1
        of = counts[:, size, size]
        self.rates = (np.diagonal(counts, axis1=1, axis2=2)[:, :size] + 0.1) / (of[:, None] + 0.2)
        self.prior = float((of[1] + 1) / (of.sum() + 2))
        apart = np.zeros((size, size))
        for y in (0, 1):
            mean = np.diagonal(counts[y])[:size] / max(of[y], 1e-9)
            cov = counts[y, :size, :size] / max(of[y], 1e-9) - np.outer(mean, mean)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            apart = np.maximum(apart, np.abs(cov / np.outer(sd, sd)) * (np.outer(sd, sd) > 1e-6))
        np.fill_diagonal(apart, 1)
        self.weights = 1 / (apart**2).sum(axis=1)

    def _evidence(self) -> tuple[np.ndarray, float, np.ndarray]:
        """What each vote adds, what silence of all says, what no entry and any entry say."""
        yes = np.log(self.rates[1] / self.rates[0])
        no = np.log((1 - self.rates[1]) / (1 - self.rates[0]))
        clean, toxic = self.known
        quiet = float(no @ self.weights + np.log(self.prior / (1 - self.prior)))
        return (yes - no) * self.weights, quiet, np.log([(1 - toxic) / (1 - clean), toxic / clean])

    def posterior(self, votes: list[list[int]]) -> np.ndarray:
        gain, quiet, none = self._evidence()
        score = np.array([quiet + gain[v].sum() + none[int(any(i < self.entries for i in v))] for v in votes])
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def _features(hits: list[list[int]], n_hits, n_words, entries: int) -> np.ndarray:
    x = np.zeros((len(hits), entries + EXTRA))
    for i, found in enumerate(hits):
        x[i, found] = 1
        x[i, entries] = len(found)
    n_hits = np.asarray(n_hits, float)
    x[:, entries] = np.minimum(x[:, entries], 8) / 4
    x[:, entries + 1] = np.minimum(n_hits / np.maximum(np.asarray(n_words, float), 1) * 100, 3)
    x[:, entries + 2] = np.minimum(np.log1p(n_hits), 3)
    return x


def _regression(x: np.ndarray, y: np.ndarray, penalty: float = 0.3, rounds: int = 25) -> np.ndarray:
    """Logistic regression on soft labels, Newton's method; the last weight is the constant.
    Equal rows are put together first."""
    x, same = np.unique(x, axis=0, return_inverse=True)
    n = np.bincount(same.ravel()).astype(float)
    y = np.bincount(same.ravel(), y) / n
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    shrink = np.full(len(w), penalty)
    shrink[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(shrink), x.T @ (n * (p - y)) + shrink * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text_hash, score (0 to 1) of every row of (doc_id, text); labels: (doc_id, toxic).

    NULL and empty texts have no votes and a low score. Without toxic training rows no
    entry is found and every score is 0. Repeated rows get equal scores. The regression
    learns from at most ``sample`` rows, half of them among those with votes.
    """
    entries, known = lexicon(docs, labels, sample)
    table = keep(hits(docs, entries), "hits")
    if not entries:
        return table.select("doc_id", "text_hash", F.lit(0.0).alias("score"))
    n = len(entries)
    votes = keep(table.groupBy(_votes(n).alias("votes")).agg(F.count("*").alias("n")), "votes")
    if votes.isEmpty():
        return table.select("doc_id", "text_hash", F.lit(0.0).alias("score"))
    model = LabelModel(votes, n, known)
    order = [F.xxhash64(F.lit(SEED), "doc_id", "hits", "n_words"), F.col("doc_id")]
    some = F.size("hits") > 0
    rows = [
        r
        for part in (table.where(some), table.where(~some))
        for r in part.orderBy(*order).limit(sample // 2)
        .select("hits", "n_hits", "n_words", _votes(n).alias("votes")).collect()
    ]
    x = _features([r["hits"] for r in rows], [r["n_hits"] for r in rows], [r["n_words"] for r in rows], n)
    weights = _regression(x, model.posterior([r["votes"] for r in rows]))

    def run(cols: dict) -> dict:
        z = _features(cols["hits"], cols["n_hits"], cols["n_words"], n) @ weights[:-1] + weights[-1]
        return {"doc_id": cols["doc_id"], "text_hash": cols["text_hash"], "score": 1 / (1 + np.exp(-np.clip(z, -30, 30)))}

    return per_batch(
        table.select("doc_id", "text_hash", "hits", "n_hits", "n_words"), run, "doc_id long, text_hash long, score double"
    )


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of all ``docs``."""
    return scores(docs, labels).select(
        "doc_id", (~training()).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those predicted toxic. Each row is judged on its own text: rows that share
    an id, or have none, go or stay one by one."""
    found = keep(scores(docs, labels).where(F.col("score") >= threshold).select("doc_id", "text_hash"), "toxic")
    gone = found.select(F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(gone["_doc_id"]) & (F.xxhash64(docs["text"]) == gone["_text_hash"])
    return docs.join(gone, same, "left_anti")
