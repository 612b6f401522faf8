"""Packing token sequences: sum-of-squares bin packing.

Documents become token ids plus an end id and are cut into pieces of at most ``LENGTH``
tokens. A packer keeps, for every residual gap, the number N(g) of open sequences with that
gap, and places each piece where the sum of N(g)^2 comes out smallest: into an open sequence
or a new one. That keeps gaps spread evenly, so what comes later finds a fit.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import cache, keep, per_batch, ship

LENGTH, END = 2048, 0
BIN_PIECES = 100_000
VOCABULARY = "byte_bpe_50k.json"
REMEMBERED = 400_000
# A cut before a blank that follows a visible character is always a cut between pre-tokens.
_BLANK_AFTER_BLANK = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")
# Marks that are common behind words, and the character below which a letter is Latin.
MARKS, LATIN = ",.;:!?", "\u0250"


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes; words behind blanks are remembered.

    The pre-tokeniser starts a new token at a blank that follows a visible character, and each
    pre-token is encoded on its own, so a text's ids are those of its first word and of every
    blank with the word behind it, in a row. Words are kept in two generations: when the young
    one is full it becomes the old one, and what the old one held and nobody asked for since is
    forgotten. Frequent words so stay, rare ones go.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.most = remembered // 2
        # Bytes of each token: a character of its name stands for one.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for name, number in vocabulary.items():
            self.sizes[number] = len(name)
        self.marks = dict(zip(MARKS, self._each(list(MARKS))))

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self._words(text) for text in texts]
        young, old = self.young, self.old
        fresh = []
        for word in set(chain.from_iterable(cut)).difference(young):
            known = old.get(word)
            if known is None:
                fresh.append(word)
            else:
                young[word] = known
        for start in range(0, len(fresh), 4096):
            self._learn(fresh[start : start + 4096])
        first = self._each([text[: len(text) - sum(map(len, words)) - len(words)] for text, words in zip(texts, cut)])
        out = [b"".join([head, *map(young.__getitem__, words)]) for head, words in zip(first, cut)]
        if len(young) > self.most:
            self.old, self.young = young, {}
        return out

    @staticmethod
    def _words(text: str) -> list[str]:
        """What stands behind the blanks at which ``text`` is cut."""
        if _BLANK_AFTER_BLANK.search(text) or text[:1] == " ":
            parts = _CUT.split(text)
            return [part[1:] for part in parts[parts[0][:1] != " " :]]
        words = text.split(" ")
        del words[0]
        return words

    def _learn(self, words: list[str]) -> None:
        """Encode new words. A mark behind a letter is a pre-token of its own; words that end in
        a visible character are encoded in one text, whose ids are told apart by the bytes they
        stand for; others one by one."""
        young = self.young
        marked = [w for w in words if w[-1:] in self.marks and w[-2:-1].isalpha() and w[-2] < LATIN]
        # One at a time: with several, Python walks the whole of the later ones.
        bare = {w[:-1] for w in marked}.union(words).difference(marked).difference(young)
        for word in [w for w in bare if w in self.old]:
            young[word] = self.old[word]
            bare.remove(word)
        joined = [w for w in bare if w and not w[-1].isspace()]
        ids = np.array(self._ids(["".join([" " + w for w in joined])])[0], np.uint32)
        ends = np.cumsum([1 + len(w.encode("utf-8", "surrogatepass")) for w in joined], dtype=np.int64)
        at = np.cumsum(self.sizes[ids])
        upto = np.searchsorted(at, ends)
        if len(joined) and upto[-1] < len(at) and (at[upto] == ends).all():
            body, low = ids.astype("<u4").tobytes(), 0
            for word, high in zip(joined, (4 * (upto + 1)).tolist()):
                young[word] = body[low:high]
                low = high
        rest = [w for w in bare if w not in young]
        young.update(zip(rest, self._each([" " + w for w in rest])))
        for word in marked:
            young[word] = young[word[:-1]] + self.marks[word[-1]]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [found.ids for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, texts: list[str]) -> list[bytes]:
        return [array("I", found).tobytes() for found in self._ids(texts)]


_encoders: dict[str, Encoder] = {}
cache("encoders", _encoders.clear)


def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """The worker's encoder for a vocabulary: a path, or the name of an installed public file."""
    if vocabulary not in _encoders:
        import os

        import public_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[vocabulary] = Encoder(vocabulary if os.path.sep in vocabulary else public_tokenizers.path(vocabulary))
    return _encoders[vocabulary]


def cuts(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, and the remainder, if any, first."""
    first = n % length or min(n, length)
    return [(0, first), *((at, length) for at in range(first, n, length))] if n else []


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids of every piece.

    A NULL or empty text is the end id alone. ids_crc32 is over little-endian unsigned 32-bit ids.
    """
    end = np.array([END], "<u4").tobytes()

    def run(cols: dict) -> dict:
        out: dict = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
        if with_ids:
            out["ids"] = []
        use = encoder(vocabulary)
        texts = [t or "" for t in cols["text"]]
        for low in range(0, len(texts), 500):
            for doc_id, body in zip(cols["doc_id"][low : low + 500], use.encode(texts[low : low + 500])):
                body += end
                for piece, (start, n) in enumerate(cuts(len(body) // 4, length)):
                    part = body[4 * start : 4 * (start + n)]
                    out["doc_id"].append(doc_id)
                    out["piece"].append(piece)
                    out["start"].append(start)
                    out["length"].append(n)
                    out["ids_crc32"].append(zlib.crc32(part))
                    if with_ids:
                        out["ids"].append(np.frombuffer(part, "<u4").astype(np.int32))
        return out

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return per_batch(docs.select(F.col("doc_id").cast("long"), "text"), run, schema, "encoders")


class SumOfSquares:
    """Open sequences by residual gap; ``place`` gives (sequence, offset) of a piece."""

    def __init__(self, length: int = LENGTH):
        self.length = length
        self.counts = np.zeros(length + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(length + 1)]
        self.sequences = 0

    def place(self, size: int) -> tuple[int, int]:
        """Change of the sum when gap g becomes g - size: 2 (N(g - size) - N(g)) + 2, without the
        terms of gap 0, which is not open. A new sequence only adds its own gap. Equal sums:
        the tightest open sequence, a new one last.
        """
        counts, length = self.counts, self.length
        gaps = counts[size:length]
        change = np.where(gaps > 0, 1 - 2 * gaps, 1 << 60)
        change[1:] += 2 * counts[1 : length - size] + 1
        best = int(change.argmin()) if len(change) else -1
        new = 0 if size == length else 2 * int(counts[length - size]) + 1
        if best < 0 or change[best] > new:
            sequence, gap = self.sequences, length
            self.sequences += 1
        else:
            gap = size + best
            sequence = self.open[gap].pop()
            counts[gap] -= 1
        left = gap - size
        if left:
            counts[left] += 1
            self.open[left].append(sequence)
        return sequence, length - gap


def pack(rows: DataFrame, length: int = LENGTH, bin_pieces: int = BIN_PIECES) -> DataFrame:
    """Adds sequence_id and offset to ``rows`` (doc_id, piece, start, length, ids_crc32).

    Rows are dealt at random into groups of about ``bin_pieces``, each packed by one task: the
    pieces over an eighth of ``length`` by falling length, then the others in random order. A
    group holds numbers only (some MB) and leaves a handful of sequences partly empty, less
    than one in a thousand. Repeated rows are pieces of their own.
    """
    rows = keep(rows, "pieces")
    groups = max(1, round(rows.count() / bin_pieces))
    key = F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())
    dealt = keep(rows.withColumn("_key", key), "dealt").withColumn("_group", F.pmod("_key", F.lit(groups)).cast("int"))
    ship(rows.sparkSession)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        # Long pieces first, longest first; the short ones then fill what gaps these leave.
        group["_long"] = -group["length"].where(group["length"] > length // 8, 0)
        group = group.sort_values(["_long", "_key", "doc_id", "piece"], kind="stable")
        packer = SumOfSquares(length)
        found = [packer.place(n) for n in group["length"].tolist()]
        group["sequence_id"] = [(g << 40) + s for g, (s, _) in zip(group["_group"].tolist(), found)]
        group["offset"] = [o for _, o in found]
        return group.drop(columns=["_key", "_group", "_long"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("_group").applyInPandas(run, schema)


def packed(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH) -> DataFrame:
    """All pieces of ``docs`` with their places."""
    return pack(pieces(docs, vocabulary, length), length)


def sequences(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (array<int>, at most ``length``)."""
    body = pieces(docs, vocabulary, length, with_ids=True)
    places = pack(body.drop("ids"), length)
    same = ["doc_id", "piece", "start", "length", "ids_crc32"]
    # Equal pieces are interchangeable; their numbers pair them.
    turn = F.row_number().over(_equal(same))
    left, right = body.withColumn("_turn", turn).alias("l"), places.withColumn("_turn", turn).alias("r")
    on = F.lit(True)
    for c in [*same, "_turn"]:
        on = on & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    part = F.struct(F.col("r.offset").alias("offset"), F.col("l.ids").alias("ids"))
    found = left.join(right, on).groupBy("r.sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return found.select("sequence_id", F.flatten("parts.ids").alias("ids"))


def _equal(cols: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*cols).orderBy("start")


def waste(lengths: Iterator[int], length: int = LENGTH) -> tuple[int, int]:
    """Sequences used for ``lengths`` in this order, and the least any packing needs."""
    packer, total = SumOfSquares(length), 0
    for n in lengths:
        packer.place(n)
        total += n
    return packer.sequences, -(-total // length)
