"""Exact duplicates, importance resampling and vector codes against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import connect, difference
from tests.test_oracle import SF_DIR
from tramline.llm import codes, exact, queries, resampling

ODD = "doc_id long, text string, digest string, salt int, place long, class string, _key string, rank int, facts map<string,int>"


def _prose(rng, n, of="abcdefgh"):
    return " ".join("".join(rng.choice(of) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """NULLs, empties, blanks, copies that differ in blanks, a text that a third of the rows hold, a very long one."""
    rng = random.Random(5)
    texts = [None, "", " ", "\t\n", "a b", "a  b", "a\tb", "a\x0bb", " a b", "a b ", "A b", "a\xa0b", "é 漢 😀", _prose(rng, 60_000)]
    base = [_prose(rng, 40) for _ in range(30)]
    texts += base + [t.replace(" ", "\r\n", 3) for t in base[:15]] + ["the common text " * 9] * 40
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    found = list(zip(ids, texts))
    return [*found, found[20], found[20], (None, base[7]), (None, "only without id"), (None, "only without id")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, "y", "z", 3, {"a": 1}) for i, t in rows], ODD).repartition(6)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_same_as_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SF_DIR), connect(SF_DIR), queries.ORACLES[name]) is None


# --- op13 ------------------------------------------------------------------------------------


def _groups(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc_id)
    return groups


@pytest.mark.parametrize("digest", [exact.sha256, lambda t: F.pmod(F.crc32(t), F.lit(3)).cast("string"), lambda t: F.lit("same")])
def test_exact_groups(docs, rows, digest):
    """Also with digests that many different texts share: contents decide."""
    want = Counter()
    for text, ids in _groups(rows).items():
        known = [i for i in ids if i is not None]
        for doc_id in ids:
            want[doc_id, min(known) if known else None, len(ids), hashlib.sha256(text.encode()).hexdigest()] += 1
    got = exact.exact_groups(docs, digest, salts=3).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(_groups(rows))
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_copies_are_dropped(docs, rows):
    left = exact.drop_copies(docs)
    assert left.columns == docs.columns
    got = left.collect()
    assert len(got) == len(_groups(rows))
    want = {min((i for i in ids if i is not None), default=None) for ids in _groups(rows).values()}
    assert {r.doc_id for r in got} == want


def test_a_partition_sends_a_common_text_once(spark):
    """The rows that leave the first aggregation's map side: one per partition, salt or not."""
    many = spark.range(20_000, numPartitions=8).select(F.col("id").alias("doc_id"), F.lit("same words").alias("text"))
    found = exact.winners(many.withColumn("digest", exact.sha256(F.col("text"))), 4)
    assert [(r.keep_id, r.group_size) for r in found.collect()] == [(0, 20_000)]
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("HashAggregate") == 4 and "Sort" not in plan and "Python" not in plan


def test_exact_groups_of_nothing(docs):
    assert exact.exact_groups(docs.limit(0)).collect() == []
    assert exact.drop_copies(docs.limit(0)).collect() == []


# --- op12 ------------------------------------------------------------------------------------


def _features(text, longest):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def _resampled(rows, target, longest, buckets, least, percent):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for counts, texts in ((s, [r[1] for r in rows]), (t, target)):
        for text in texts:
            counts.update(map(bucket, _features(text, longest)[1]))
    big_s, big_t = sum(s.values()), sum(t.values())
    out, able = [], []
    for doc_id, text in rows:
        words, features = _features(text, longest)
        gain = [
            math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
            for b in map(bucket, features)
        ]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        row = [doc_id, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        out.append(row)
        if len(words) >= least:
            able.append(row)
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(able[: percent * len(able) // 100], 1):
        row[4] = rank
    return Counter(map(tuple, out))


@pytest.mark.parametrize("longest, buckets, percent", [(1, 10_000, 10), (1, 50, 50), (3, 97, 100)])
def test_resampled(spark, docs, rows, longest, buckets, percent):
    target = ["a b c", "The Common TEXT", None, "", "é 漢"]
    held = spark.createDataFrame([(1, t) for t in target], "item_id long, text string")
    got = resampling.resampled(docs, held, longest, buckets, percent=percent).collect()
    assert Counter(map(tuple, got)) == _resampled(rows, target, longest, buckets, 20, percent)


def test_features_do_not_cross_documents():
    texts = ["one two", None, "", "  ", "three", "four-five\x00six", "ÄÖ Z9z"]
    owner, bucket, words = resampling.features(texts, 3, 1000)
    for i, text in enumerate(texts):
        own, features = _features(text, 3)
        assert words[i] == len(own)
        assert sorted(bucket[owner == i]) == sorted(zlib.crc32(f.encode()) % 1000 for f in features)


def test_resampling_of_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resampled(docs.limit(0), none).collect() == []
    assert resampling.resampled(docs, none).count() == docs.count()


# --- op11 ------------------------------------------------------------------------------------


def _codes(rows, parts, entries, rounds):
    """(vec_id, label, whole components) rows; plain assignment to all entries."""
    width = -(-len(rows[0][2]) // parts)
    cut = lambda v: [tuple((v + [0] * width * parts)[p * width : (p + 1) * width]) for p in range(parts)]
    vectors = [cut(r[2]) for r in rows]
    first = sorted((r[0], r[2], i) for i, r in enumerate(rows) if r[0] is not None)[:entries]
    books = [[vectors[i][p] for _, _, i in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for v in vectors:
                members.setdefault(nearest(v[p], books[p]), []).append(v[p])
            books[p] = [
                tuple(sum(c) // len(members[e]) for c in zip(*members[e])) if e in members else entry
                for e, entry in enumerate(books[p])
            ]
    found = [[nearest(v[p], books[p]) for p in range(parts)] for v in vectors]
    errors = [sum(far(v[p], books[p][c]) for p, c in enumerate(code)) for v, code in zip(vectors, found)]
    by_label = Counter()
    for r, e in zip(rows, errors):
        by_label[r[1]] += e
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return Counter(
        (r[0], "".join(f"{c:02x}" for c in code), e, by_label[r[1]], sha) for r, code, e in zip(rows, found, errors)
    )


VECTORS = "vec_id long, embedding array<float>, label int, place long, parts string, code string, n int, facts map<string,int>"


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "p", "c", 2, {"a": 1}) for i, v, label in rows], VECTORS).repartition(5)


@pytest.mark.parametrize("dims, chunk", [(32, 64), (35, 1000), (64, 100)])
def test_vector_codes(spark, monkeypatch, dims, chunk):
    """Several chunks, ties, repeated rows and ids, a vector that a third hold, NULL ids and labels, negative floors."""
    rng = np.random.default_rng(dims)
    some = (rng.integers(-40, 40, (260, dims)) / 128).astype(np.float32)
    some[100:140] = some[3]
    some[200:230] = some[5] + np.float32(1 / 300)
    rows = [(int(i) // 2 if i < 10 else int(i), v.tolist(), [0, 1, None][i % 3]) for i, v in enumerate(some)]
    rows += [rows[20], rows[20], (None, rows[30][1], 1)]
    dropped = [(900, None, 1), (901, [1.0, None] * (dims // 2), 1), (902, [float("nan")] * dims, 1), (903, [float("inf")] * dims, 0)]
    odd = [(904, [0.5] * (dims + 1), 7), (905, [1e30] * dims, 7)]
    want = _codes([(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, label in rows], 16, 64, 2)
    got = codes.vector_codes(_vectors(spark, rows + dropped + odd), chunk=chunk).collect()
    sha = got[0].codebooks_sha256
    assert Counter(map(tuple, (r for r in got if r.vec_id not in (904, 905)))) == want
    assert sorted(tuple(r) for r in got if r.vec_id in (904, 905)) == [(i, None, None, None, sha) for i in (904, 905)]


def test_few_and_no_vectors(spark):
    one = codes.vector_codes(_vectors(spark, [(5, [0.5] * 16, None)])).collect()
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in one] == [(5, "00" * 16, 0, 0)]
    assert codes.vector_codes(_vectors(spark, [(1, [], 1)])).collect()[0].code == "00" * 16
    assert [r.code for r in codes.vector_codes(_vectors(spark, [(None, [0.5] * 16, 1)])).collect()] == [None]
    assert codes.vector_codes(spark.createDataFrame([], VECTORS)).collect() == []


def test_cover_tree_invariants_and_pruning():
    rng = np.random.default_rng(2)
    points = (rng.normal(size=(4000, 4)) * 60).astype(np.int64)
    points[1000:1500] = points[7]
    tree = codes.CoverTree.build(points)
    assert (tree.points[tree.place] == points).all() and tree.counts.sum() == 4000
    for node in range(len(tree.start)):
        own = tree.points[tree.start[node] : tree.end[node]]
        assert np.sqrt(((own - own[0]) ** 2).sum(1)).max() <= tree.radius[node]
        low, high = tree.child[node]
        centres = tree.points[tree.start[low:high]].astype(float)
        if len(centres) > 1:
            assert (tree.start[low], tree.end[high - 1]) == (tree.start[node], tree.end[node])
            apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(-1)) + np.eye(len(centres)) * 1e9
            assert apart.min() > tree.radius[node] / 2 * (1 - 1e-9)
    entries = points[rng.choice(1000, 64, replace=False)]
    found, sums, counts = tree.assign(entries)
    plain = codes.squared(points, entries).argmin(axis=1)
    assert (found[tree.place] == plain).all()
    assert (counts == np.bincount(plain, minlength=64)).all()
    assert (sums == np.array([points[plain == e].sum(axis=0) for e in range(64)])).all()
    again = codes.CoverTree.loaded(tree.dumped())
    assert (again.assign(entries)[0] == found).all()


def test_tight_groups_are_assigned_whole(monkeypatch):
    """Points in tight groups: only the groups' nodes are compared, not the points."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-4000, 4000, (40, 4))
    points = np.concatenate([c + rng.integers(-5, 6, (500, 4)) for c in centres])
    tree, compared = codes.CoverTree.build(points), []
    plain = codes.squared
    monkeypatch.setattr(codes, "squared", lambda p, e: compared.append(len(p)) or plain(p, e))
    tree.assign(centres)
    assert sum(compared) < len(tree.points) / 20
