"""Personal data: rules, and a skip-chain conditional random field that spreads their findings.

Rules find base spans. A document's tokens with a digit or an at sign form a graph: neighbours
in the text are linked, and so is each token with the one before it that repeats its core (the
address, the last seven digits), however far away. The core of a number is that of a whole run
of adjacent tokens, so it does not matter how its digits are grouped. A conditional random field
over that graph labels tokens; tokens in base spans are known, and loopy message passing carries
their labels to repeated mentions that no rule matches, such as a number without its prefix.
While the field is learned, such mentions are hidden: that no rule matches them says nothing. The
field adds repeated mentions only, so a text without a base span gains none. All other
tokens cannot carry a label, so they cut the chain and need not be visited.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import per_batch, ship

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS, SAMPLE_TOKENS = 2_000, 60_000
CERTAIN = 0.9
SEED = 31

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# Possessive, and never from the middle of digits: the same matches, in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]+")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_REST = re.compile(r"\S*")


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of the address pattern: for each at sign the local run before it and the domain behind."""
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _part_ok(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start; code points, end exclusive."""
    if not text:
        return []
    found = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            found += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_part_ok, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = _NOT_DIGIT.sub("", m[0])
                if 13 <= len(digits) <= 19 and _luhn(digits):
                    found.append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    found.append((3, *m.span()))
    return found


def as_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


# --- tokens and their graph -----------------------------------------------------------------


def _tokens(text: str) -> list[tuple[int, int]]:
    """Runs of visible characters with a digit or an at sign."""
    found, end = [], 0
    for m in _MARK.finditer(text):
        start = m.start()
        if start < end:
            continue
        while start > end and not text[start - 1].isspace():
            start -= 1
        end = _REST.match(text, m.end()).end()
        found.append((start, end))
    return found


def _shape(token: str) -> str:
    out: list[str] = []
    for c in token[:64]:
        kind = "9" if "0" <= c <= "9" else "a" if c.isalpha() else c
        if len(out) < 3 or not (out[-1] == out[-2] == out[-3] == kind):
            out.append(kind)
    return "".join(out[:24])


def _core(token: str) -> str | None:
    """What makes two tokens mentions of the same: an address, the last seven digits."""
    if "@" in token:
        core = token.lower().strip(".,;:!?()[]<>\"'%*$&#")
        return core if len(core) > 3 else None
    digits = _NOT_DIGIT.sub("", token)
    return digits[-7:] if len(digits) >= 4 else None


_NUMBER = re.compile(r"[(+]*[0-9][0-9().-]*")
_GAP = 3


def _mentions(text: str, spans: list[tuple[int, int]], labels: list[int], base: list[tuple[int, int, int]]) -> dict[int, str]:
    """Cores of the tokens of base phone and card numbers, and of runs of adjacent tokens that
    repeat such a number's last seven digits and as many before them as the run has.

    Blanks, brackets, dots and hyphens may group the digits; a zero may stand for the prefix.
    """
    found: dict[int, str] = {}
    numbers: dict[str, list[str]] = {}
    starts = [s for s, _ in spans]
    for kind, s, e in base:
        if KINDS[kind] in ("card", "phone"):
            digits = _NOT_DIGIT.sub("", text[s:e])
            numbers.setdefault(digits[-7:], []).append(digits)
            for j in range(max(int(np.searchsorted(starts, s, "right")) - 1, 0), len(spans)):
                if starts[j] >= e:
                    break
                if spans[j][1] > s and labels[j] == kind + 1:
                    found[j] = digits[-7:]
    if not numbers:
        return found
    words = [text[s:e].strip(",;:!?'\"[]") for s, e in spans]
    part = [_NOT_DIGIT.sub("", w) if _NUMBER.fullmatch(w) else "" for w in words]
    for j in range(len(spans) - 1, -1, -1):
        if labels[j] or j in found or not part[j]:
            continue
        digits, best = "", None
        for i in range(j, -1, -1):
            if labels[i] or not part[i] or (i < j and not _adjacent(text, spans, i)):
                break
            digits = part[i] + digits
            if len(digits) > 19:
                break
            if len(digits) >= 7 and any(n.endswith(digits) or n.endswith(digits[1:]) and digits[0] == "0" and len(digits) > 7 for n in numbers.get(digits[-7:], ())):
                best = i
        if best is not None:
            core = "".join(part[best : j + 1])[-7:]
            found.update((i, core) for i in range(best, j + 1))
    return found


def _adjacent(text: str, spans: list[tuple[int, int]], i: int) -> bool:
    """Whether only a few blanks, brackets, dots or hyphens stand between token i and the next."""
    between = text[spans[i][1] : spans[i + 1][0]]
    return len(between) <= _GAP and not between.strip(" \t\u00a0().-")


class Graph:
    """Tokens of a text with features, base labels (0 none, else kind + 1) and links."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]):
        self.spans = _tokens(text)
        n = len(self.spans)
        self.labels = [0] * n
        starts = [s for s, _ in self.spans]
        for kind, s, e in base:
            i = int(np.searchsorted(starts, s, "right")) - 1
            for j in range(max(i, 0), n):
                if starts[j] >= e:
                    break
                if self.spans[j][1] > s and not self.labels[j]:
                    self.labels[j] = kind + 1
        words = [text[s:e] for s, e in self.spans]
        shapes = [_shape(w) for w in words]
        near = [i > 0 and self.spans[i][0] - self.spans[i - 1][1] <= 3 for i in range(n)]
        self.chain = [i for i in range(1, n) if near[i]]
        self.skip: list[tuple[int, int]] = []
        found = _mentions(text, self.spans, self.labels, base)
        self.cores = [found.get(i, _core(w)) for i, w in enumerate(words)]
        held = {c for c, y in zip(self.cores, self.labels) if y and c is not None}
        # Four to six digits may be any number: of those, the rules' silence is taken as an answer.
        self.hidden = [not y and c in held and ("@" in c or len(c) > 6) for c, y in zip(self.cores, self.labels)]
        # Every token of a run is linked with the last token of the mention before it.
        last: dict[str, int] = {}
        before: dict[str, int] = {}
        for i, core in enumerate(self.cores):
            if core is not None:
                if core in last and not (last[core] == i - 1 and near[i] and self.labels[i] == self.labels[i - 1]):
                    before[core] = last[core]
                if core in before:
                    self.skip.append((before[core], i))
                last[core] = i
        self.features = [
            [
                "s" + shapes[i],
                f"n{min(sum(map(str.isdigit, w[:64])), 20)}",
                "p" + (shapes[i - 1][:8] if near[i] else ""),
                "f" + (shapes[i + 1][:8] if i + 1 < n and near[i + 1] else ""),
                "+" if w[0] == "+" else "-",
            ]
            for i, w in enumerate(words)
        ]


class Field:
    """A conditional random field: token weights, neighbour table, agreement of repeated tokens.

    Learned by pseudo-likelihood (each token given its neighbours' labels), which is concave,
    by gradient ascent with a Gaussian prior around ``AGREE`` for the agreement and 0 else.
    Hidden tokens have no label to learn from: they begin as their linked tokens and count, after
    every ``ROUNDS_KNOWN`` rounds, as what the field makes of them (expectation-maximisation).
    """

    AGREE, PRIOR, ROUNDS, STEP = 2.0, 0.05, 150, 0.5
    ROUNDS_KNOWN = 30
    CLASSES = len(KINDS) + 1

    def __init__(self):
        self.index: dict[str, int] = {}
        self.weights = np.zeros((0, self.CLASSES))
        self.pairs = np.zeros((self.CLASSES, self.CLASSES))
        self.agree = self.AGREE

    def fit(self, features: list[list[str]], labels: np.ndarray, chain: np.ndarray, skip: np.ndarray, hidden: np.ndarray | None = None) -> Field:
        """``chain``: tokens linked with the one before; ``skip``: pairs of linked tokens;
        ``hidden``: whether a token's label is unknown."""
        n, c = len(features), self.CLASSES
        if n == 0:
            return self
        self.index = {f: i for i, f in enumerate(sorted({f for row in features for f in row}))}
        flat = np.array([self.index[f] for row in features for f in row])
        owner = np.repeat(np.arange(n), [len(row) for row in features])
        self.weights = np.zeros((len(self.index), c))
        truth = np.eye(c)[labels]
        unknown = np.zeros(n, bool) if hidden is None else np.asarray(hidden, bool)
        if unknown.any():  # at first, what their linked tokens are
            truth[unknown] = 0
            for one, two in ((skip[:, 0], skip[:, 1]), (skip[:, 1], skip[:, 0])):
                use = unknown[one] & ~unknown[two]
                np.add.at(truth, one[use], np.eye(c)[labels[two[use]]])
            some = truth.sum(axis=1, keepdims=True)
            truth = np.where(some > 0, truth / np.maximum(some, 1), 1 / c)
        after = chain - 1
        usual = np.bincount(flat, minlength=len(self.index))[:, None] + 1.0
        for turn in range(self.ROUNDS):
            partner = np.zeros((n, c))
            if len(skip):
                np.add.at(partner, skip[:, 0], truth[skip[:, 1]])
                np.add.at(partner, skip[:, 1], truth[skip[:, 0]])
            score = np.zeros((n, c))
            np.add.at(score, owner, self.weights[flat])
            score += self.agree * partner
            score[chain] += truth[after] @ self.pairs
            score[after] += truth[chain] @ self.pairs.T
            score -= score.max(axis=1, keepdims=True)
            p = np.exp(score)
            p /= p.sum(axis=1, keepdims=True)
            off = truth - p
            grad = np.zeros_like(self.weights)
            np.add.at(grad, flat, off[owner])
            self.weights += self.STEP * (grad - self.PRIOR * self.weights) / usual
            pairs = truth[after].T @ off[chain] + off[after].T @ truth[chain]
            self.pairs += self.STEP * (pairs - self.PRIOR * self.pairs) / max(1, len(chain))
            if len(skip):
                self.agree += self.STEP * ((off * partner).sum() - self.PRIOR * (self.agree - self.AGREE)) / len(skip)
            if turn % self.ROUNDS_KNOWN == self.ROUNDS_KNOWN - 1:
                truth[unknown] = p[unknown]
        return self

    def beliefs(self, graphs: list[Graph], rounds: int = 12) -> np.ndarray:
        """Label probabilities of all tokens of ``graphs`` by loopy sum-product, all graphs at once."""
        sizes = [len(g.spans) for g in graphs]
        begin = np.concatenate(([0], np.cumsum(sizes))).astype(int)
        unary = np.zeros((begin[-1], self.CLASSES))
        rows = [(begin[k] + i, self.index[f]) for k, g in enumerate(graphs) for i, row in enumerate(g.features) for f in row if f in self.index]
        if rows:
            at, which = np.array(rows).T
            np.add.at(unary, at, self.weights[which])
        for k, g in enumerate(graphs):
            for i, label in enumerate(g.labels):
                if label:
                    unary[begin[k] + i] = np.where(np.arange(self.CLASSES) == label, 0.0, -20.0)
        chain = np.array([(begin[k] + i - 1, begin[k] + i) for k, g in enumerate(graphs) for i in g.chain]).reshape(-1, 2)
        skip = np.array([(begin[k] + i, begin[k] + j) for k, g in enumerate(graphs) for i, j in g.skip]).reshape(-1, 2)
        source = np.concatenate((chain[:, 0], skip[:, 0], chain[:, 1], skip[:, 1])).astype(int)
        target = np.concatenate((chain[:, 1], skip[:, 1], chain[:, 0], skip[:, 0])).astype(int)
        half = len(chain) + len(skip)
        same = self.agree * np.eye(self.CLASSES)
        tables = np.concatenate((
            np.broadcast_to(self.pairs, (len(chain), *same.shape)), np.broadcast_to(same, (len(skip), *same.shape)),
            np.broadcast_to(self.pairs.T, (len(chain), *same.shape)), np.broadcast_to(same, (len(skip), *same.shape)),
        ))
        message = np.zeros((2 * half, self.CLASSES))
        total = unary
        for _ in range(rounds if half else 0):
            reverse = np.concatenate((message[half:], message[:half]))
            scores = (total[source] - reverse)[:, :, None] + tables
            top = scores.max(axis=1, keepdims=True)
            new = np.log(np.exp(scores - top).sum(axis=1)) + top[:, 0]
            new -= new.max(axis=1, keepdims=True)
            moved = np.abs(new - message).max()
            message = (message + new) / 2
            total = unary.copy()
            np.add.at(total, target, message)
            if moved < 1e-3:
                break
        total = np.exp(total - total.max(axis=1, keepdims=True))
        return total / total.sum(axis=1, keepdims=True)

    def added(self, graphs: list[Graph], texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
        """Spans the field adds to each text: tokens outside base spans whose label is nearly
        certain and is the label of a base token with the same core in the text."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in graphs]
        # Only a text with a base token and an unlabelled token of the same core can gain a span.
        open_ = []
        for k, g in enumerate(graphs):
            held = {(c, y) for c, y in zip(g.cores, g.labels) if c is not None and y}
            cores = {c for c, _ in held}
            if held and any(c in cores and not y for c, y in zip(g.cores, g.labels)):
                open_.append((k, held))
        if not open_:
            return out
        chosen = [graphs[k] for k, _ in open_]
        p = self.beliefs(chosen)
        at = 0
        for (k, held), g in zip(open_, chosen):
            covered = [(s, e) for _, s, e in base[k]]
            run: tuple | None = None  # core, label and number of the token before, if a span was added there
            for i, (s, e) in enumerate(g.spans):
                label = int(p[at + i].argmax())
                if not label or g.labels[i] or p[at + i, label] < CERTAIN or (g.cores[i], label) not in held:
                    continue
                while s < e and not (texts[k][s].isalnum() or texts[k][s] in "+("):
                    s += 1
                while e > s and not texts[k][e - 1].isalnum():
                    e -= 1
                if s < e and not any(a < e and s < b for a, b in covered):
                    if run == (g.cores[i], label, i - 1) and _adjacent(texts[k], g.spans, i - 1):
                        s = out[k].pop()[1]
                    out[k].append((label - 1, s, e))
                    run = (g.cores[i], label, i)
            at += len(g.spans)
        return out


def learn(docs: DataFrame, docs_most: int = SAMPLE_DOCS, tokens_most: int = SAMPLE_TOKENS) -> Field:
    """A field learned from base labels of at most ``docs_most`` documents with digits or at signs
    (smallest hashes of the id) and at most ``tokens_most`` of their tokens."""
    docs = docs.select("doc_id", "text")
    ids = (
        docs.where(F.col("text").rlike("[0-9@]")).select(F.col("doc_id").alias("_doc_id"))
        .orderBy(F.xxhash64(F.lit(SEED), "_doc_id"), "_doc_id").limit(docs_most).distinct()
    )
    some = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("_doc_id"), "left_semi").select(F.col("doc_id").cast("long"), "text")

    def run(cols: dict) -> dict:
        out: dict = {n: [] for n in ("doc", "place", "features", "label", "near", "partner", "hidden")}
        for doc_id, text in zip(cols["doc_id"], cols["text"]):
            if not text:
                continue
            g = Graph(text, base_spans(text))
            near, partner = set(g.chain), dict((j, i) for i, j in g.skip)
            digest = hashlib.md5(f"{SEED}:{doc_id}".encode()).hexdigest()
            for i, features in enumerate(g.features):
                out["doc"].append(digest)
                out["place"].append(i)
                out["features"].append(features)
                out["label"].append(g.labels[i])
                out["near"].append(i in near)
                out["partner"].append(partner.get(i, -1))
                out["hidden"].append(g.hidden[i])
        return out

    schema = "doc string, place int, features array<string>, label int, near boolean, partner int, hidden boolean"
    rows = per_batch(some, run, schema).orderBy("doc", "place", "label").limit(tokens_most).collect()
    number = {(r["doc"], r["place"]): i for i, r in enumerate(rows)}
    chain = [i for i, r in enumerate(rows) if r["near"] and i and rows[i - 1]["doc"] == r["doc"]]
    skip = [(number[r["doc"], r["partner"]], i) for i, r in enumerate(rows) if r["partner"] >= 0 and (r["doc"], r["partner"]) in number]
    return Field().fit(
        [r["features"] for r in rows], np.array([r["label"] for r in rows], int),
        np.array(chain, int), np.array(skip, int).reshape(-1, 2), np.array([r["hidden"] for r in rows], bool),
    )


def _found(texts: list[str], field: Field) -> tuple[list, list]:
    """Base spans and added spans of texts, a few hundred graphs at a time."""
    base = [base_spans(t) for t in texts]
    more: list[list] = [[] for _ in texts]
    waiting: list[int] = []
    graphs: list[Graph] = []

    def flush() -> None:
        for k, spans in zip(waiting, field.added(graphs, [texts[k] for k in waiting], [base[k] for k in waiting])):
            more[k] = spans
        waiting.clear()
        graphs.clear()

    for k, spans in enumerate(base):
        if spans:  # without a base span there is no label to spread
            waiting.append(k)
            graphs.append(Graph(texts[k], spans))
            if len(waiting) == 500:
                flush()
    flush()
    return base, more


def personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every whole text.

    The counts and the hash are of the base spans; ``spans`` has all, by kind and start, and
    ``n_added`` says how many the field added. NULL texts count as empty: no spans.
    """
    field = field or learn(docs)

    def run(cols: dict) -> dict:
        texts = [t or "" for t in cols["text"]]
        base, more = _found(texts, field)
        return {
            "doc_id": cols["doc_id"],
            **{f"n_{kind}": [sum(k == i for k, _, _ in b) for b in base] for i, kind in enumerate(KINDS)},
            "base_sha256": [hashlib.sha256(as_text(b).encode()).hexdigest() for b in base],
            "spans": [as_text(sorted(b + m)) for b, m in zip(base, more)],
            "n_added": [len(m) for m in more],
        }

    return per_batch(
        docs.select(F.col("doc_id").cast("long"), "text"), run,
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long",
    )


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask_personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with all spans masked in ``text``, and ``n_chars`` (if there) following."""
    field = field or learn(docs)
    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def mask(column: pd.Series) -> pd.Series:
        texts = [t or "" for t in column]
        base, more = _found(texts, field)
        return pd.Series([t if t is None else masked(t, b + m) for t, b, m in zip(column, base, more)], dtype=object)

    out = docs.withColumn("text", mask("text"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(kind))
    return out
