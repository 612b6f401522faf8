"""Records of delimited text whose quoted fields may hold line breaks, read in blocks.

A line's effect on the reader is one of four: it leaves the state (inside or outside quotes)
as it was, turns it, or sets it to one of the two. One pass composes these per file block; a
scan over the blocks, one row each, tells which begin inside quotes; a second pass cuts each
block into records. Records that cross block borders are put together from their pieces, at
most two a block. No line is shuffled, and no file has to be read by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_CHARS = 1 << 24  # of one record: beyond, a quote is taken for never closed, an error

# Possessive throughout: the match never goes back, and long fields need no stack.
_TEXT = '[^"]*+(?:""[^"]*+)*+'  # inside quotes, doubled quotes included
_FIELDS = f'(?:(?:"{_TEXT}"[^,]*+|[^",][^,]*+|),)*+'  # whole fields, each with its comma
_OPENS = f'\\A{_FIELDS}"{_TEXT}\\z'
_STAYS = f'\\A{_TEXT}(?:\\z|"[^,]*+,{_FIELDS}"{_TEXT}\\z)'
KEEP, TURN, OUTSIDE, INSIDE = 2, 1, 0, 3  # bit 0: ends inside from outside; bit 1: from inside


def _effect(line: Column) -> Column:
    ends = F.when(line.rlike(_OPENS), 1).otherwise(0) + F.when(line.rlike(_STAYS), 2).otherwise(0)
    return F.when(line.contains('"'), ends).otherwise(KEEP).cast("int")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, block, line, value, effect`` in file order within a block; ``line`` rises with it."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), "value", _effect(F.col("value")).alias("effect"),
    )


def _after(effects: np.ndarray, inside: bool) -> np.ndarray:
    """The state behind each line: what the last setting line says, turned by those since."""
    places = np.arange(len(effects))
    turns = np.cumsum(effects == TURN)
    last = np.maximum.accumulate(np.where((effects == OUTSIDE) | (effects == INSIDE), places, -1))
    known = last >= 0
    start = np.where(known, effects[last] == INSIDE, inside)
    return start ^ ((turns - np.where(known, turns[last], 0)) % 2 == 1)


def _runs(path: pd.Series, block: pd.Series) -> Iterator[tuple[int, int]]:
    """Bounds of the rows of one block after another."""
    new = (block != block.shift()) | (path != path.shift())
    starts = np.flatnonzero(new.to_numpy())
    yield from zip(starts.tolist(), [*starts[1:].tolist(), len(block)])


def _composed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    done, at, ends = [], None, (False, True)
    for batch in batches:
        for low, high in _runs(batch["path"], batch["block"]):
            here = (batch["path"].iat[low], int(batch["block"].iat[low]))
            if here != at:
                done += [(*at, ends[0] + 2 * ends[1])] if at else []
                at, ends = here, (False, True)
            effects = batch["effect"].to_numpy()[low:high]
            ends = tuple(bool(_after(effects, state)[-1]) for state in ends)
    done += [(*at, ends[0] + 2 * ends[1])] if at else []
    yield pd.DataFrame(done, columns=["path", "block", "effect"])


def _inside(blocks: DataFrame) -> DataFrame:
    """``path, block, inside``: the blocks that begin inside quotes; ``blocks`` has one row each."""
    order = Window.partitionBy("path").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sets = F.col("effect").isin(OUTSIDE, INSIDE)
    turned = blocks.withColumn("turns", F.sum((F.col("effect") == TURN).cast("int")).over(order))
    seen = turned.select(
        "path", "block",
        F.coalesce(F.max("turns").over(before), F.lit(0)).alias("turns"),
        F.last(F.when(sets, F.struct("effect", "turns")), ignorenulls=True).over(before).alias("last"),
    )
    start = F.coalesce((F.col("last.effect") == INSIDE).cast("int"), F.lit(0))
    since = F.col("turns") - F.coalesce("last.turns", F.lit(0))
    return seen.where((start + since) % 2 == 1).select("path", "block", F.lit(True).alias("inside"))


PIECES = "path string, block long, line long, value string, part string"


class _Block:
    """Lines of one block to records; what is open at its end is a piece."""

    def __init__(self, path: str, block: int, inside: bool):
        self.path, self.block, self.inside = path, block, inside
        self.open: list[str] = []
        self.line, self.rest, self.chars = -1, inside, 0
        self.head = block == 0  # the first record that is not blank is the header

    def feed(self, lines: np.ndarray, values: np.ndarray, effects: np.ndarray) -> list[tuple]:
        after = _after(effects, self.inside)
        before = np.concatenate([[self.inside], after[:-1]])
        self.inside = bool(after[-1])
        out = []
        for line, value, begun, goes_on in zip(lines.tolist(), values.tolist(), before.tolist(), after.tolist()):
            if not begun and not goes_on:
                if value.strip():
                    out += self._record(line, value, "whole")
                continue
            if not self.open:
                self.line, self.chars = line, 0
            self.open.append(value)
            self.chars += len(value) + 1
            if self.chars > MOST_CHARS:
                raise ValueError(f"{self.path}: a quote opened near byte {self.block} is not closed within {MOST_CHARS} characters")
            if not goes_on:
                out += self.close()
        return out

    def _record(self, line: int, value: str, part: str) -> list[tuple]:
        if self.head and part != "rest":
            self.head = False
            return []
        return [(self.path, self.block, line, value, part)]

    def close(self, end: bool = False) -> list[tuple]:
        """The open lines as a row: a whole record, its ``head`` if the block ends, or the ``rest`` of an earlier one."""
        if not self.open:
            return []
        part = "rest" if self.rest else "head" if end else "whole"
        value, self.open, self.rest = "\n".join(self.open), [], False
        return self._record(self.line, value, part)


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [field.split()[0] for field in PIECES.split(", ")]
    current = None
    for batch in batches:
        out = []
        for low, high in _runs(batch["path"], batch["block"]):
            part = batch.iloc[low:high]
            here = (part["path"].iat[0], int(part["block"].iat[0]))
            if current is None or here != (current.path, current.block):
                out += current.close(end=True) if current else []
                current = _Block(*here, bool(part["inside"].iat[0]))
            out += current.feed(*(part[c].to_numpy() for c in ("line", "value", "effect")))
        yield pd.DataFrame(out, columns=columns)
    if current:
        yield pd.DataFrame(current.close(end=True), columns=columns)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``ord, record``: the records of a file, or of every file of a folder, header lines left out.

    Quotes that do not begin a field are text. Blank lines between records are skipped; a
    record keeps its inner line breaks. ``ord`` rises in file order. A quote that is never
    closed takes the rest of the file for its field, or is an error once that exceeds
    ``MOST_CHARS``.
    """
    lines = _lines(spark, path)
    blocks = lines.select("path", "block", "effect").mapInPandas(_composed, "path string, block long, effect int")
    # At most one row per block of the file, and only of those that begin inside quotes. Lines
    # must stay in order, so the other side may not be shuffled.
    begun = F.broadcast(_inside(blocks))
    marked = lines.join(begun, ["path", "block"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    pieces = marked.select("path", "block", "line", "value", "effect", "inside").mapInPandas(_cut, PIECES)
    whole = pieces.where("part = 'whole'").select(F.col("line").alias("ord"), F.col("value").alias("record"))
    heads = F.sum((F.col("part") == "head").cast("int")).over(Window.partitionBy("path").orderBy("block", "line"))
    joined = (
        pieces.where("part <> 'whole'").withColumn("number", heads)
        .groupBy("path", "number").agg(F.sort_array(F.collect_list(F.struct("block", "line", "value"))).alias("found"))
        .select(F.col("found")[0]["line"].alias("ord"), F.array_join(F.col("found.value"), "\n").alias("record"))
    )
    return whole.unionByName(joined).withColumn("record", F.regexp_replace("record", "\r\\z", ""))
