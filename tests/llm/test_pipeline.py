"""The pipeline, stage by stage, against what plain Python says of each stage's own input."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tramline.llm.common import read

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
BLANK = r"[^\x20\x09-\x0D]+"


def _prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def _shingles(text):
    words = re.findall(BLANK, text or "")
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def _kept_ids(rows):
    """Rows left of each group of linked texts, by breadth-first search over all pairs."""
    sets = {t: _shingles(t.translate({c: c + 32 for c in range(65, 91)})) for _, t in rows if t}
    sets = {t: s for t, s in sets.items() if s}
    links = {t: [u for u in sets if 100 * len(s & sets[u]) >= 75 * len(s | sets[u])] for t, s in sets.items()}
    left, seen = [r for r in rows if r[1] not in sets], set()
    for start in sets:
        if start not in seen:
            group, open_ = {start}, [start]
            while open_:
                new = [u for u in links[open_.pop()] if u not in group]
                group.update(new)
                open_ += new
            seen |= group
            left.append(min(r for r in rows if r[1] in group))
    return left


def _rows(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)


def test_every_stage_does_its_whole_work(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, _prose(rng, 60) + (" zzscum zzloser" if i % 6 == 0 else "")) for i in range(300)]
    toxic = {t for i, t in rows if i % 6 == 0}
    copied = [t for _, t in rows if t not in toxic][:20]
    rows += [(400 + i, t) for i, t in enumerate(copied)] + [(450 + i, t + " more") for i, t in enumerate(copied)]
    rows += [(500, None), (501, ""), (502, "  "), (503, "one"), (504, _prose(rng, 4_000)), rows[1]]
    rows += [(600 + i, _prose(rng, 30) + f" write to joe{i}@mail.example.org now") for i in range(20)]
    full = [(i, t, "en", ["a", "b", "c", None][(i or 0) % 4], len(t or "")) for i, t in rows]
    spark.createDataFrame(full, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(i, int(i % 6 == 0)) for i in range(300)]
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs = read(spark, str(tmp_path), "documents")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        found = stage(spark, docs, str(tmp_path))
        found.write.parquet(f"{tmp_path}/stage-{name}")
        docs = after[name] = spark.read.parquet(f"{tmp_path}/stage-{name}")
        assert name == "packing" or docs.columns == before.columns

    clean = sorted([r for r in rows if r[1] not in toxic], key=str)
    assert _rows(after["toxicity"]) == clean
    single = sorted(_kept_ids(clean), key=str)
    assert _rows(after["minhash_near_dedup"]) == single
    masked = dict(_rows(after["pii"]))
    assert masked.keys() == {i for i, _ in single}
    for i, text in single:
        hidden = (text or "").replace(f"joe{i - 600}@mail.example.org", "")
        assert "@" not in (masked[i] or "") and ("@" not in (text or "") or masked[i].startswith(hidden[:40]))
        assert "@" in (text or "") or masked[i] == text
    words = {i: len(re.findall(BLANK, t or "")) for i, t in masked.items()}
    taken = Counter()
    for i, text in _rows(after["mixing"]):
        taken[i] += len(re.findall(BLANK, text or ""))
    assert all(n <= 3 * words[i] for i, n in taken.items())
    source = {r.doc_id: r.source for r in after["pii"].collect()}
    sizes, got = Counter(), Counter()
    for i, n in words.items():
        sizes[source[i]] += n
        got[source[i]] += taken[i]
    targets, weights = {}, {"a": 5, "b": 2, "c": 1, None: 5}
    while True:
        rest = sum(sizes.values()) - sum(targets.values())
        still = {s: weights[s] for s in sizes if s not in targets}
        share = {s: rest * w / sum(still.values()) for s, w in still.items()}
        above = {s: 3 * sizes[s] for s in share if share[s] > 3 * sizes[s]}
        targets.update(above or share)
        if not above:
            break
    assert all(abs(got[s] - targets[s]) <= 64 for s in sizes)
    pieces = after["packing"]
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert {r.doc_id for r in pieces.collect()} == {i for i, _ in _rows(after["mixing"])}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == pieces.count()
