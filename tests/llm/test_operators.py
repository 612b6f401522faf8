"""The training-data operators against brute force, round trips and planted cases."""

import base64
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as sf

from tramline.llm import archives, languages, minmax, mixing, neighbours, packing, privacy, sharding, syncmers, toxicity
from tramline.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int"


def _prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Nulls, empties, ties, repeats, short, long and near-copied texts."""
    rng = random.Random(3)
    found = [None, "", "   ", "one", "One", "two words here", "é ü ñ 漢字 😀"]
    base = [_prose(rng, 120) for _ in range(12)]
    for text in base:
        words = text.split()
        found += [text, text.upper(), " ".join(words[:110]), " ".join(words[:60] + ["x"] + words[60:])]
    found += [_prose(rng, 30_000), base[0], base[0]]
    return found


@pytest.fixture(scope="module")
def docs(spark, texts):
    langs, sources = ["en", "de", None], ["a", "b", None, "a", "a"]
    rows = [(i * 3, t, langs[i % 3], sources[i % 5], len(t or ""), 7, 1) for i, t in enumerate(texts)]
    rows += [rows[8], (None, texts[8], "en", "a", 1, 7, 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- op1 -------------------------------------------------------------------------------------


def _brute_syncmers(text, k=24, s=8):
    if len(text) < k:
        return 1 if text else 0
    codes = np.array([ord(c) for c in text], np.uint64) + np.uint64(1)
    small = syncmers.mixed(syncmers._rolling(codes, s)).tolist()
    chosen = []
    for i in range(len(text) - k + 1):
        inner = small[i : i + k - s + 1]
        if min(inner) in (inner[0], inner[-1]):
            chosen.append(i)
    return chosen


def test_syncmers_are_those_of_the_definition():
    text = _prose(random.Random(1), 300)
    at, hashes = syncmers.anchors(text)
    assert at.tolist() == _brute_syncmers(text)
    again = syncmers.anchors(text, chunk=97)
    assert again[0].tolist() == at.tolist() and again[1].tolist() == hashes.tolist()


def test_edited_fingerprints(docs, texts):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = {}
    for i, (doc_id, text) in enumerate(rows):
        after, part = rows[(i + 1) % len(rows)][1], len(text) // 3
        want[doc_id] = (len(text), hashlib.sha256((text[: len(text) - part] + after[:part]).encode()).hexdigest())
    for blocks in (1, 7, 102):
        got = syncmers.edited_fingerprints(docs, blocks=blocks).collect()
        assert len(got) == len(rows)
        assert all(want[r.doc_id] == (r.n_chars, r.edited_sha256) for r in got if r.doc_id != 24)
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[0].fingerprint == by_id[3].fingerprint == "" and by_id[0].near_edited == 1
    assert by_id[21].fingerprint == by_id[None].fingerprint if texts[7] == texts[8] else True


def test_fingerprints_hold_all_anchors_of_long_texts(spark):
    rng = random.Random(14)
    words = _prose(rng, 4000).split()
    other = _prose(rng, 4000).split()
    other[1000:1060] = words[2000:2060]  # one passage in common
    nearly = [*words[:30], "zzz", *words[31:]]
    rows = [(3, " ".join(words)), (2, " ".join(nearly)), (1, " ".join(other))]
    got = {r.doc_id: r for r in syncmers.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), blocks=1).collect()}
    for doc_id, text in rows:
        at, hashes = syncmers.anchors(text)
        r = got[doc_id]
        assert r.positions == at.tolist() == _brute_syncmers(text) and r.fingerprint == syncmers.as_text(hashes)
        assert len(r.edited_fingerprint) == 8 * len(r.edited_positions)
    assert 0.9 < got[3].near_next < 1
    assert 0 < got[2].near_next < 0.05


# --- op2 -------------------------------------------------------------------------------------


def _set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _brute_components(rows):
    sets = {i: _set(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {i: root(i) for i in ids}, sets


def test_near_duplicates(docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, sets = _brute_components(rows)
    got = minmax.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept, r.n_shingles) == (want[r.doc_id], want[r.doc_id] == r.doc_id, len(sets[r.doc_id]))
    assert minmax.near_duplicates(empty).count() == 0
    left = minmax.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.where("doc_id IS NOT NULL").collect()) == sorted(i for i, c in want.items() if i == c)


@pytest.mark.parametrize("block", [minmax.BLOCK, 16])
def test_heavily_edited_copies_keep_their_components(spark, monkeypatch, block):
    monkeypatch.setattr(minmax, "BLOCK", block)
    rng = random.Random(8)
    base = _prose(rng, 150).split()
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(50)}"
        rows.append((i, " ".join(words)))
    want, _ = _brute_components(rows)
    got = minmax.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_texts_of_one_id_keep_their_own_links(spark):
    rng = random.Random(10)
    rows = []
    for i in range(12):  # an id with two texts, and a near copy of each
        one, two = _prose(rng, 80), _prose(rng, 80)
        rows += [(i, one), (i, two), (100 + i, one + " tail"), (200 + i, two + " tail")]
    got = minmax.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert all(r.component_id == r.doc_id % 100 and r.kept == (r.doc_id < 100) for r in got)


def test_near_dedup_keeps_different_texts_of_one_id(spark):
    rng = random.Random(11)
    hot = [(7, _prose(rng, 60), f"s{i}") for i in range(40)]
    copies = [(100 + i, t + " tail", s) for i, (_, t, s) in enumerate(hot[:20])]
    odd = [(7, "", "e"), (7, None, "n"), (None, hot[0][1], "x"), (5, hot[1][1] + " end", "five")]
    rows = [*hot, *copies, *odd, (7, hot[2][1], "z"), (7, hot[2][1], "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = [*odd, *(r for i, r in enumerate(hot) if i not in (1, 2)), (7, hot[2][1], "a")]
    for part in (frame, frame.repartition(5)):
        assert sorted(map(tuple, minmax.drop_near_duplicates(part).collect()), key=str) == sorted(want, key=str)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (70, 71)], "a long, b long")
    assert {r.id: r.component for r in components(edges).collect()} == {**{i: 0 for i in range(61)}, 70: 70, 71: 70}


# --- op3 -------------------------------------------------------------------------------------


def test_nearest(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(700, 16)).astype(np.float32)
    vectors[10:40] = vectors[10]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] * 16), (1150, [None] * 16), (None, [1.0] * 16)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(frame).collect()
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 700, 50):
        scores = np.round(unit @ unit[q], 12)
        best = [i for i in np.lexsort((np.arange(700), -scores)).tolist() if i != q][:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert all(abs(r.score - unit[r.vec_id] @ unit[q]) < 1e-12 for r in mine)
        hits += len({r.vec_id for r in mine} & set(best))
    assert len(got) == 70 and hits / 70 >= 0.9
    assert neighbours.nearest(frame.where("vec_id < 0")).count() == 0


def test_nearest_over_shards(spark):
    """Ties over several shards and splits, repeated vec_ids, clashing names, any order of rows."""
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(400, 8))
    vectors[1::40] = vectors[0] * np.arange(2, 12)[:, None]  # the same direction, different nodes
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(50, vectors[300].tolist()), (50, vectors[301].tolist()), (7, vectors[300].tolist())]

    def run(rows):
        frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, shard int, links string")
        kept = neighbours.usable(frame)
        index = neighbours.build_index(kept, 5, shard=60)
        assert index.count() >= 6
        asking = kept.where("vec_id % 50 = 0").groupBy(sf.col("vec_id").alias("query_id")).agg(sf.min("embedding").alias("query"))
        got = neighbours.search(index, asking, 5, block=2).orderBy("query_id", "rank").collect()
        return [(r.query_id, r["rank"], r.vec_id, r.score) for r in got]

    got = run(rows)
    assert got == run(rows[::-1])
    own = {q: min(v for i, v in rows if i == q) for q in range(0, 400, 50)}
    want = []
    for q, query in own.items():
        scores = neighbours.cosines(np.array(query), np.array([v for _, v in rows]))
        best = sorted((-s, i) for s, (i, _) in zip(scores.tolist(), rows) if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert [r[:3] for r in got] == [r[:3] for r in want]  # shards of 60 are searched whole
    assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=1e-12)


# --- op4 -------------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _brute_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0
            ok = {
                "email": True, "ip": all(int(p) <= 255 for p in m[0].split(".") if kind == "ip"),
                "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((k, *m.span()))
    return out


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(6)
    parts = ["1", "29", ".", "@", "a", "-", " ", "+", "(", ")", "..", "4111111111111111", "192.168.0.1", "a@b.co", "+1 (499) 555-6503"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(12))
        assert privacy.base_spans(text) == _brute_spans(text), text


def test_long_runs_take_linear_time():
    assert privacy.base_spans("7" * 200_000) == [] and privacy.base_spans("a" * 200_000) == []
    assert privacy.base_spans("a" * 200_000 + "@b.c") == [(0, 0, 200_004)]


def test_repeated_mentions_are_added_and_masked(spark):
    text = "Call +1 (499) 555-6503 now, I repeat: 555-6503 please. Order 555-1111."
    rows = [(i, f"{text} {i}") for i in range(40)] + [(90, None), (91, ""), (92, "no data 12345")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in privacy.personal_data(frame).collect()}
    base = "phone:5:22"
    assert got[0].n_phone == 1 and got[0].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert got[0].spans.startswith(base)
    assert all(got[i].spans == "" and got[i].n_phone == 0 for i in (90, 91, 92))
    masked = {r.doc_id: r.text for r in privacy.mask_personal_data(frame).collect()}
    assert masked[0].startswith("Call [PHONE] now") and masked[90] is None and masked[92] == "no data 12345"


def test_learned_field_adds_mentions_however_grouped(spark):
    again = ["499 555 6503", "(499) 555-6503", "4995556503", "0499 555 6503"]
    rows = [(i, f"Call +1 (499) 555-6503 now, or {again[i % 4]} later. Order 361-2931 of 2024, {i} pieces") for i in range(40)]
    rows += [(100, "Order 555 1111 and 2024"), (101, "Card 4111111111111111, order 4111, year 1111.")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in privacy.personal_data(frame).collect()}
    assert all(got[i].n_added > 0 for i in range(40)) and got[100].n_added == got[101].n_added == 0
    masked = {r.doc_id: r.text for r in privacy.mask_personal_data(frame).collect()}
    for i in range(40):
        assert masked[i] == f"Call [PHONE] now, or [PHONE] later. Order 361-2931 of 2024, {i} pieces"
    text = "Call +1 (499) 555-6503 now, I repeat: 555-6503 please. Order 555-1111."
    frame = spark.createDataFrame([(i, f"{text} {i}") for i in range(40)], "doc_id long, text string")
    for r in privacy.mask_personal_data(frame).collect():
        assert r.text == f"Call [PHONE] now, I repeat: [PHONE] please. Order 555-1111. {r.doc_id}"


def test_field_spreads_a_known_label():
    # Repeated cores labelled alike in training; the second mention has no base span here.
    text = "x +1 (499) 555-6503 y +1 (499) 555-6503 z"
    graphs = [privacy.Graph(text, privacy.base_spans(text)) for _ in range(50)]
    features = [f for g in graphs for f in g.features]
    size = len(graphs[0].spans)
    labels = np.array([y for g in graphs for y in g.labels])
    chain = np.array([k * size + i for k, g in enumerate(graphs) for i in g.chain])
    skip = np.array([(k * size + i, k * size + j) for k, g in enumerate(graphs) for i, j in g.skip]).reshape(-1, 2)
    field = privacy.Field().fit(features, labels, chain, skip)
    other = "x +1 (499) 555-6503 y 555-6503 z"
    base = privacy.base_spans(other)
    assert field.added([privacy.Graph(other, base)], [other], [base]) == [[(3, 22, 30)]]


# --- op5 -------------------------------------------------------------------------------------


def test_targets_and_takes(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    assert all(r.size == words[r.doc_id] and 0 <= r.taken <= 3 * r.size for r in got)
    sources = {(r.source_size, r.target) for r in got}
    total = sum(s for s, _ in sources)
    assert sum(t for _, t in sources) == pytest.approx(total) and all(t <= 3 * s + 1e-6 for s, t in sources)
    for size, target in sources:
        assert sum(r.taken for r in got if r.source_size == size) == pytest.approx(target, abs=3 * mixing.BLOCK + 0.02 * target)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()), key=str)
    assert mixing.mix(empty).count() == 0


def test_rare_source_of_short_texts_meets_its_target(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_DOCS", 10)
    rng = random.Random(13)
    rows = [(i, "big", _prose(rng, 40)) for i in range(4000)] + [(10_000 + i, "rare", _prose(rng, 20)) for i in range(200)]
    rows += [(20_000 + i, "rare", None if i % 2 else " ") for i in range(30)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert len(got) == len(rows)
    rare = [r for r in got if r.doc_id >= 10_000]
    assert {r.target for r in rare} == {12_000.0}
    assert sum(r.taken for r in rare) == pytest.approx(12_000, abs=3 * mixing.BLOCK)


def _levelled(sizes, weights=(5, 2, 1), most=3):
    """Targets by resharing in a plain loop."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, free = {}, float(sum(sizes.values())), set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > most * sizes[s]]
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
            free.remove(s)
    return target


def test_small_sources_meet_their_targets(spark):
    """Sources of 1 to 40 words beside large ones: each takes its target to within a block of its own."""
    rows = [(i, " ".join(f"w{j}" for j in range(i)), f"s{i:02d}") for i in range(1, 41)]
    rows += [(100 + i, " ".join(f"v{j}" for j in range(300)), None if i % 2 else "zz") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    sizes, taken = {}, {}
    for (doc_id, _, source), r in zip(rows, sorted(got, key=lambda r: r.doc_id)):
        assert r.doc_id == doc_id and r.taken <= 3 * r.size
        sizes[source] = sizes.get(source, 0) + r.size
        taken[source] = taken.get(source, 0) + r.taken
    want = _levelled(sizes)
    for (_, _, source), r in zip(rows, sorted(got, key=lambda r: r.doc_id)):
        assert r.target == pytest.approx(want[source])
    for source, words in taken.items():
        assert abs(words - want[source]) <= (1 if sizes[source] < 2048 else 33), source
    texts = mixing.mixed_documents(docs).collect()
    for source in sizes:
        assert sum(len(r.text.split()) for r in texts if r.source == source) == taken[source]


CLASHING = (
    "doc_id long, text string, lang string, source string, n_chars int, _doc_id int, _lang string, _row string, _words int, _passes int, "
    "_number int, _turn int, _id long, _text string, _text_hash long, digest string, component long, facts map<string,int>"
)


@pytest.fixture(scope="module")
def clashing(spark):
    """Columns named like helpers, a map, repeated rows."""
    rng = random.Random(8)
    rows = []
    for i in range(60):
        text = _prose(rng, 40) if i % 3 else f"call me at +1 (499) 555-650{i % 10} or write to a{i}@b.org today"
        rows.append((i, text, "en", "ab"[i % 2], len(text), 1, "x", "r", 2, 3, 4, 5, 6, "t", 7, "d", 8, {"a": 1, "b": 2}))
    return spark.createDataFrame([*rows, rows[3], rows[3], rows[4]], CLASHING).repartition(3)


def test_columns_named_like_helpers(spark, clashing):
    none = clashing.limit(0)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    stages = {
        "toxicity": lambda d: toxicity.drop_toxic(d, labels), "near": minmax.drop_near_duplicates,
        "pii": privacy.mask_personal_data, "mixing": mixing.mixed_documents,
    }
    for name, stage in stages.items():
        out = stage(clashing)
        assert out.columns == clashing.columns, name
        assert all(r.facts == {"a": 1, "b": 2} and r._lang == "x" for r in out.collect()), name
        assert stage(none).collect() == [], name
    assert minmax.drop_near_duplicates(clashing).count() == 60
    for query in (privacy.personal_data, languages.languages, packing.packed, mixing.mix, syncmers.edited_fingerprints):
        assert query(clashing).count() >= 60
        assert query(none).collect() == []


def test_apportion_is_sainte_lague(spark):
    votes = [53, 24, 23, 7, 0]
    frame = spark.createDataFrame([(0, i, float(v), 37) for i, v in enumerate(votes)], "g int, k int, share double, seats long")
    got = {r.k: r.quota for r in mixing.apportion(frame, ["g"], ["k"], "share", "seats", "quota").collect()}
    seats = [0] * len(votes)
    for _ in range(37):
        seats[max(range(5), key=lambda i: (votes[i] / (2 * seats[i] + 1), -i))] += 1
    assert [got[i] for i in range(5)] == seats


def test_mixed_documents_hold_the_words_taken(docs):
    unique = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    takes = {r.doc_id: r.taken for r in mixing.mix(unique).collect()}
    mixed = mixing.mixed_documents(unique)
    assert mixed.columns == docs.columns
    words: dict = {}
    for r in mixed.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert r.n_chars == len(r.text)
    assert words == {i: n for i, n in takes.items() if n}


# --- op6 -------------------------------------------------------------------------------------


def test_shuffle(docs, empty):
    got = sharding.shuffle(docs).collect()
    assert len(got) == docs.count()
    counts = [sum(r.shard == j for r in got) for j in range(16)]
    assert max(counts) - min(counts) <= 1
    for j in range(16):
        assert sorted(r.slot for r in got if r.shard == j) == list(range(counts[j]))
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id])) for r in got)
    assert sharding.shuffle(empty).count() == 0


def test_matrix_has_its_margins_and_means(spark):
    sizes = spark.createDataFrame([(i, n) for i, n in enumerate([400, 0, 37, 1000, 163])], "part long, rows long").where("rows > 0")
    total = np.zeros(4)
    for seed in range(6):
        got = {r.part: r.counts for r in sharding.matrix(sizes, 4, seed).collect()}
        assert {p: sum(c) for p, c in got.items()} == {0: 400, 2: 37, 3: 1000, 4: 163}
        assert np.sum(list(got.values()), axis=0).tolist() == [400] * 4
        total += got[3]
    assert np.all(np.abs(total / 6 - 250) < 30)


# --- op7, op10 -------------------------------------------------------------------------------


def test_toxicity_of_planted_words(spark, empty):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        words, toxic = _prose(rng, 40).split(), i % 6 == 0
        if toxic:
            words[5:5] = rng.sample(["zzscum", "zzloser", "zzclown", "zzidiot"], 2)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(700, None), (701, ""), (702, "A ZZSCUM, a zzclown!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, marks).collect()}
    assert len(got) == len(rows)
    assert all(got[i].predicted == int(i % 6 == 0) for i in range(600))
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert (got[700].predicted, got[701].predicted, got[702].predicted) == (0, 0, 1)
    assert toxicity.drop_toxic(docs, marks).count() == len(rows) - 101
    assert toxicity.toxicity(docs, marks.where("toxic = 0")).where("predicted = 1").count() == 0
    assert toxicity.toxicity(empty, marks).count() == 0


def test_levels_of_entries(spark):
    entries = ["bad", "ugly*%1", "worse%3"]
    texts = [
        None, "", "Bad!", "uglyness " + "so " * 98, "uglyness " + "so " * 100, "worse", "worse worse " + "so " * 198,
        "worse worse " + "so " * 199, "ugly, BAD uglyish worse worse", "nothing bade",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.hits, r.n_hits) for r in toxicity.hits(docs, entries).collect()}
    want = [([], 0), ([], 0), ([0], 1), ([1], 1), ([], 0), ([], 0), ([2], 2), ([], 0), ([0, 1, 2], 5), ([], 0)]
    assert [got[i] for i in range(len(texts))] == want


def test_label_model_counts_like_a_plain_loop(spark):
    rng = random.Random(8)
    n, docs = 3, []
    for _ in range(400):
        toxic = rng.random() < 0.2
        first = rng.random() < (0.8 if toxic else 0.03)
        docs.append([v for v, on in enumerate([
            first, first and rng.random() < 0.9, rng.random() < (0.6 if toxic else 0.02),
            rng.random() < (0.7 if toxic else 0.1), False, rng.random() < 0.3, rng.random() < (0.3 if toxic else 0.2),
        ]) if on])
    known, size = [0.05, 0.9], n + toxicity.PATTERNS
    table = spark.createDataFrame([(d, 1) for d in docs], "votes array<int>, n long")
    model = toxicity.LabelModel(table.groupBy("votes").agg(sf.sum("n").alias("n")), n, known, rounds=6)

    x = np.array([[float(v in d) for v in range(size)] for d in docs])
    seen = x[:, :n].any(axis=1)
    post = np.where(seen, 0.95, 0.02)
    for _ in range(6):
        share = [1 - post, post]
        rates = np.array([[(sum(s * x[:, v]) + 0.1) / (sum(s) + 0.2) for v in range(size)] for s in share])
        prior = (sum(post) + 1) / (len(docs) + 2)
        weights = []
        for a in range(size):
            total = 0.0
            for b in range(size):
                most = 0.0
                for s in share:
                    ma, mb = sum(s * x[:, a]) / sum(s), sum(s * x[:, b]) / sum(s)
                    cov = sum(s * (x[:, a] - ma) * (x[:, b] - mb)) / sum(s)
                    spread = math.sqrt(max(ma * (1 - ma), 1e-9) * max(mb * (1 - mb), 1e-9))
                    most = max(most, abs(cov / spread)) if spread > 1e-6 else most
                total += 1.0 if a == b else most**2
            weights.append(1 / total)
        spoke = x @ (np.log(rates[1] / rates[0]) * weights)
        quiet = (1 - x) @ (np.log((1 - rates[1]) / (1 - rates[0])) * weights)
        anchor = np.where(seen, math.log(known[1] / known[0]), math.log((1 - known[1]) / (1 - known[0])))
        score = spoke + quiet + math.log(prior / (1 - prior)) + anchor
        post = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    assert np.allclose(model.rates, rates, atol=1e-6) and np.allclose(model.weights, weights, atol=1e-6)
    assert np.allclose(model.posterior(docs), post, atol=1e-6)
    assert model.weights[0] < model.weights[2]


def test_lexicon_takes_every_entry_that_passes_and_none_by_chance(spark):
    rng = random.Random(9)
    bad = ["".join(rng.choices("bcdfghklmnprstvwz", k=7)) for _ in range(200)]
    rows = [(i, _prose(rng, 60) + (" " + " ".join(rng.sample(bad, 40)) if i % 5 == 0 else "")) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(3000)], "doc_id long, toxic int")
    found = {e.rstrip("%0123456789").rstrip("*") for e in toxicity.lexicon(docs, marks)[0]}
    assert all(any(b.startswith(e) for e in found) for b in bad)
    assert all(any(b.startswith(e) for b in bad) for e in found)
    shuffled = spark.createDataFrame([(i, int(rng.random() < 0.2)) for i in range(3000)], "doc_id long, toxic int")
    assert toxicity.lexicon(docs, shuffled)[0] == []


def test_toxicity_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").withColumn("_doc_id", sf.lit(1)).withColumn("toxic", sf.lit(2))
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.toxicity(docs, labels).where("held_out").join(labels, "doc_id")
    n = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n.get((0, 1), 0)) >= 0.97
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) >= 0.9


def test_toxicity_of_very_long_texts(spark):
    rng = random.Random(10)
    rows = [(i, _prose(rng, 40) + (" zzscum zzloser" if i % 6 == 0 else "")) for i in range(300)]
    long_one = _prose(rng, 200_000)
    rows += [(1000, long_one), (1001, long_one + " zzscum, zzloser! " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(300)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, marks).collect()}
    assert got[1000].predicted == 0 and got[1001].score > got[1000].score


def test_rows_of_one_id_are_judged_on_their_own_texts(spark):
    rng = random.Random(4)
    rows = [(i, _prose(rng, 40) + (" zzscum zzloser" if i % 6 == 0 else "")) for i in range(300)]
    marks = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(300)], "doc_id long, toxic int")
    clean = [(i, _prose(rng, 40)) for i in (None, 900) for _ in range(30)] + [(None, None), (900, None)]
    rows += clean + [(None, "zzscum, zzloser, go"), (900, "zzloser and zzscum")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = [(r.doc_id, r.text) for r in toxicity.drop_toxic(docs, marks).collect()]
    want = [r for r in rows[:300] if r[0] % 6] + clean
    assert sorted(left, key=str) == sorted(want, key=str)


def test_language_of_held_out_texts(spark):
    found = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(5000, None, None), (5001, "12 !", "en"), (5002, "", "fr")], found.schema)
    got = languages.languages(found.union(odd)).collect()
    truth = {r.doc_id: r.lang for r in found.collect()}
    held = [r for r in got if r.held_out and r.doc_id < 5000]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) / len(held) >= 0.95
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id >= 5000)
    assert all(0 <= r.score <= 1 for r in got)


def test_sample_of_a_language_is_ranked_in_two_steps(spark):
    rows = [(i % 700, "de" if i % 3 else "fr") for i in range(3000)] + [(None, "de")] * 50 + [(7, "de")] * 900
    frame = spark.createDataFrame(rows, "doc_id long, lang string").repartition(6)
    got = languages._chosen(frame, 40)
    hashed = frame.selectExpr("doc_id", "lang", "xxhash64(doc_id) AS h").collect()
    want = set()
    for lang in ("de", "fr"):
        mine = sorted((r.h, r.doc_id is not None, r.doc_id or 0) for r in hashed if r.lang == lang)[:40]
        want |= {(i if some else None, lang) for _, some, i in mine}
    assert set(map(tuple, got.collect())) == want
    assert "_bucket" in got._jdf.queryExecution().toString()


def test_ngrams_do_not_depend_on_chunks(monkeypatch):
    text = _prose(random.Random(9), 400)
    whole = languages.ngrams(text)
    monkeypatch.setattr(languages, "CHUNK", 101)
    parts = languages.ngrams(text)
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()


# --- op8 -------------------------------------------------------------------------------------


def test_archives_round_trip(spark):
    rows = [(5, "u", "<p>a"), (3, "u v\r\nX: y", "<p>a"), (9, None, None), (7, "u", ""), (11, "u", "é" * 70_000), (None, "u", "z"), (3, "u", "<p>a")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(archives.archive(frame).collect(), key=lambda r: (r.page_id is None, r.page_id or 0))
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    texts = {r[0]: r[2] for r in rows}
    assert [r.page_id for r in got] == [3, 3, 5, 7, 9, 11, None]
    assert all((r.payload_bytes, r.payload_digest) == (len((texts[r.page_id] or "").encode()), digest(texts[r.page_id])) for r in got)
    assert [(r.record_type, r.refers_to) for r in got] == [
        ("response", None), ("response", None), ("revisit", 3), ("response", None), ("revisit", 7), ("response", None), ("response", None),
    ]
    assert archives.archive(frame.where("page_id < 0")).count() == 0


# --- op9 -------------------------------------------------------------------------------------


def test_encoder_forgets_rare_parts_only():
    import public_tokenizers

    encoder = packing.Encoder(public_tokenizers.path(packing.VOCABULARY), remembered=40)
    rng, often = random.Random(2), "the same words again and"
    for _ in range(30):
        text = f"{often} {_prose(rng, 15)}\n  x\t y"
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.encode([text]) == [np.array(want, "<u4").tobytes()]
        assert len(encoder.young) + len(encoder.old) < 40 + 2 * 25
    assert all(word in encoder.young or word in encoder.old for word in often.split()[1:])


def test_pieces_hash_the_tokenizer_ids_of_whole_texts(docs):
    import public_tokenizers

    plain = packing.Encoder(public_tokenizers.path(packing.VOCABULARY)).tokenizer
    want = set()
    for r in docs.collect():
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 0]
        for piece, (start, n) in enumerate(packing.cuts(len(ids))):
            want.add((r.doc_id, piece, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())))
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in packing.pieces(docs).collect()} == want


def test_encoder_gives_the_tokenizer_its_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    plain.encode_special_tokens = True
    rng, mine = random.Random(5), packing.encoder()
    parts = [" ", "a", "\n", "'s", "\t", "1", "é", "!", "\x85", "  ", "<|endoftext|>", " word"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(10))
        assert np.frombuffer(mine.encode([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_packing(docs, empty):
    got = packing.packed(docs).collect()
    by_sequence: dict = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_sequence) <= -(-sum(r.length for r in got) // 2048) + 2
    long = sorted((r for r in got if r.doc_id == 55 * 3), key=lambda r: r.piece)
    assert [r.length for r in long[1:]] == [2048] * (len(long) - 1) and long[0].start == 0
    assert [(r.length, r.piece) for r in got if r.doc_id == 0] == [(1, 0)]
    assert packing.packed(empty).count() == 0
    full = packing.sequences(docs)
    assert sum(len(r.ids) for r in full.collect()) == sum(r.length for r in got)


def test_sum_of_squares_places_where_the_sum_is_smallest():
    rng, packer = random.Random(12), packing.SumOfSquares(50)
    gaps: dict[int, int] = {}
    for _ in range(600):
        size = rng.randint(1, 50)
        options = []
        for gap in [g for g in set(gaps.values()) if g >= size] + [50]:
            counts: dict[int, int] = {}
            for g in gaps.values():
                counts[g] = counts.get(g, 0) + 1
            if gap < 50 or 50 in gaps.values():
                counts[gap] -= 1
            if gap > size:
                counts[gap - size] = counts.get(gap - size, 0) + 1
            options.append(sum(n * n for g, n in counts.items() if g))
        sequence, offset = packer.place(size)
        gaps[sequence] = 50 - offset - size
        gaps = {s: g for s, g in gaps.items() if g}
        assert int((packer.counts[1:50] ** 2).sum()) == min(options)
