"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks.

The words of each source are laid out shard by shard in a seeded order and cut into blocks
of ``BLOCK`` words, those of sources below ``SMALL`` blocks into blocks of one word. The mix
takes as many blocks of either kind as the targets of its sources hold; sources get whole
numbers of them by the highest quotients target / (2q + 1), and the shards of a source share
its quota by the same rule over their sizes. So a source takes its target to within a block,
which is one word for a small one. A shard's quota is met by whole passes over its
blocks and one seeded choice among them for the rest.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.llm.common import keep, ship, words_in

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK, SMALL = 32, 64
SHARD_DOCS, SHARD_BLOCKS = 10_000, 1_000
SEED = 11
# Primes above any number of blocks in a shard; a step by one visits each block once.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source``, ``source_size``, ``weight``, ``target`` from (source, source_size), one row each.

    Weights repeat along the sources in code-point order, NULL last. Targets share the sum of
    all sizes by weight; none exceeds ``most`` times its source's size, and what is cut off is
    shared again until none does: target = min(most × size, level × weight) with one level.
    Sorted by most × size / weight, the sources below the level are a prefix, so running sums
    find it. The windows run over one row per source.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    rows = rows.withColumn("_ratio", F.col("_cap") / F.col("weight"))
    order = Window.orderBy("_ratio", F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    rows = rows.withColumn("_level", level).withColumn("_rank", F.row_number().over(order))
    first = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_rank", "_level"))).over(every)
    rows = rows.withColumn("_final", first["_level"])
    return rows.withColumn("target", F.least("_cap", F.coalesce(F.col("_final") * F.col("weight"), F.col("_cap")))).select(
        "source", "source_size", "weight", "target"
    )


def apportion(rows: DataFrame, group: list[str], key: list[str], share: str, seats: str, quota: str) -> DataFrame:
    """Sainte-Laguë: ``seats`` of each ``group`` over its rows in proportion to ``share``.

    Rounding shares against a divisor a little too large gives seats that the method gives
    too; the few left go to the highest quotients share / (2q + 1), ties by ``key``. Rows
    without a share get none.
    """
    whole = Window.partitionBy(*group)
    total = F.sum(share).over(whole)
    exact = F.when(total > 0, F.col(share) * F.greatest(F.col(seats) - F.count("*").over(whole), F.lit(0)) / total)
    rows = rows.withColumn("_q", F.floor(F.coalesce(exact, F.lit(0.0)) + 0.5).cast("long"))
    rows = rows.withColumn("_left", F.when(total > 0, F.col(seats) - F.sum("_q").over(whole)).otherwise(F.lit(0)))
    # A row can win about its share of the seats left, and one or two by rounding.
    more = F.when(F.col(share) > 0, F.ceil(F.col(share) * F.col("_left") / total).cast("int") + 2).otherwise(F.lit(0))
    tries = rows.where("_left > 0").withColumn("_more", more).where("_more > 0").select(
        *dict.fromkeys([*group, *key]), "_left", F.col(share).alias("_share"), "_q", F.explode(F.sequence(F.lit(0), F.col("_more") - 1)).alias("_i"),
    )
    quotient = F.col("_share") / (2 * (F.col("_q") + F.col("_i")) + 1)
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("_quotient"), *key, "_i"))
    won = (
        tries.withColumn("_quotient", quotient).withColumn("_place", place).where("_place <= _left")
        .groupBy(*group, *key).agg(F.count("*").alias("_won"))
    )
    left, right = rows.alias("l"), won.alias("r")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in dict.fromkeys([*group, *key])]
    condition = same[0]
    for other in same[1:]:
        condition = condition & other
    return left.join(right, condition, "left").select(
        "l.*", (F.col("l._q") + F.coalesce("r._won", F.lit(0))).cast("long").alias(quota)
    ).drop("_q", "_left")


def plan(docs: DataFrame, text: str = "text", block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """Each row's words in the mix, for rows (doc_id, source, text): adds what ``chosen`` needs.

    Columns: doc_id, source, size, source_size, target, passes (whole repeats), start (its
    first word's place in the shard's layout), blocks, rest (blocks of the last, partial
    pass), step and shift (which blocks those are), unit (words of a block), taken.

    NULL text or source: size 0, a source of its own. Rows of size 0 take 0. Repeated rows
    count each. An empty table gives an empty one.
    """
    sized = keep(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words_in(text).alias("size"))
        .withColumn("order", F.when(F.col("size") > 0, F.xxhash64(F.lit(seed), "doc_id", "source")).otherwise(F.monotonically_increasing_id())),
        "sized",
    )
    # A source's shards follow its own rows, and hold SHARD_BLOCKS blocks on average at least, so that
    # rounding a shard up to whole blocks costs its quota little.
    by_docs, by_words = F.ceil(F.count("*") / SHARD_DOCS), F.floor(F.sum("size") / (SHARD_BLOCKS * block))
    shards = keep(
        sized.groupBy(F.col("source").alias("_source"))
        .agg(F.greatest(F.lit(1), by_docs).alias("_docs"), F.greatest(F.lit(1), F.least(by_docs, by_words)).alias("_shards")),
        "shards",
    )
    # Rows without words take no place in a layout: they are dealt by number apart, below 0.
    pick = F.xxhash64(F.lit(seed + 1), "doc_id", "size")
    empty = -1 - F.pmod(F.xxhash64("order"), F.col("_docs"))
    shard = F.when(F.col("size") > 0, F.pmod(pick, F.col("_shards"))).otherwise(empty)
    sized = sized.join(shards, F.col("source").eqNullSafe(F.col("_source")), "left")
    sized = sized.withColumn("shard", shard.cast("int")).drop("_source", "_docs", "_shards")
    parts = sized.groupBy("source", "shard").agg(F.sum("size").alias("part"))
    sources = targets(parts.groupBy("source").agg(F.sum("part").cast("long").alias("source_size")))
    # Blocks in all, of either size: as many as the targets hold words for. No source gets more than MOST passes.
    sources = sources.withColumn("unit", F.when(F.col("source_size") < SMALL * block, 1).otherwise(block))
    seats = F.round(F.sum("target").over(Window.partitionBy("unit")) / F.col("unit")).cast("long")
    quotas = apportion(sources.withColumn("_seats", seats), ["unit"], ["source"], "target", "_seats", "quota")
    quotas = keep(quotas.select("source", "source_size", "target", "quota", "unit"), "quotas")
    parts = parts.withColumnRenamed("source", "_source")
    parts = (
        parts.join(quotas, F.col("_source").eqNullSafe(F.col("source")))
        .select("source", "shard", "source_size", "target", "quota", "part", "unit")
        .withColumn("blocks", F.ceil(F.col("part") / F.col("unit")).cast("long"))
    )
    most = F.sum("blocks").over(Window.partitionBy("source")) * MOST
    parts = apportion(
        parts.withColumn("quota", F.least("quota", most)), ["source"], ["shard"], "blocks", "quota", "own"
    )
    pick = F.xxhash64(F.lit(seed + 2), "source", "shard")
    parts = keep(
        parts.select(
            F.col("source").alias("_source"), F.col("shard").alias("_shard"), "source_size", "target", "blocks", "unit",
            F.when(F.col("blocks") > 0, F.floor(F.col("own") / F.col("blocks"))).otherwise(0).cast("long").alias("passes"),
            F.when(F.col("blocks") > 0, F.col("own") % F.col("blocks")).otherwise(0).cast("long").alias("rest"),
            F.element_at(F.array(*[F.lit(p).cast("long") for p in PRIMES]), (F.pmod(pick, F.lit(len(PRIMES))) + 1).cast("int")).alias("step"),
            F.when(F.col("blocks") > 0, F.pmod(pick, F.col("blocks"))).otherwise(0).cast("long").alias("shift"),
        ),
        "parts",
    )
    layout = Window.partitionBy("source", "shard").orderBy("order", "doc_id", "size")
    placed = sized.withColumn(
        "start", F.coalesce(F.sum("size").over(layout.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    rows = placed.join(parts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", "passes", "start", "blocks", "rest", "step", "shift", "unit",
        (F.col("passes") * F.col("size") + _partly()).cast("long").alias("taken"),
    )


def _partly() -> Column:
    """Words of a row that lie in the blocks chosen for the last pass."""
    block = F.col("unit")
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)

    def words(b: Column) -> Column:
        low = F.greatest(b * block, F.col("start"))
        high = F.least((b + 1) * block, F.col("start") + F.col("size"))
        chosen = (b * F.col("step") + F.col("shift")) % F.col("blocks") < F.col("rest")
        return F.when(chosen, high - low).otherwise(F.lit(0).cast("long"))

    total = F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), lambda acc, b: acc + words(b).cast("long"))
    return F.when((F.col("size") > 0) & (F.col("rest") > 0), total).otherwise(F.lit(0).cast("long"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row; taken is at most MOST × size."""
    return plan(docs).select("doc_id", "size", "source_size", "target", "taken")


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def mixed_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix itself: ``docs`` with each row as often as whole passes take it, and once more with
    the chosen blocks of its text where the last pass takes a part. Rows that no pass takes go.

    Where rows share doc_id, source and size, they are interchangeable and share their parts.
    ``n_chars`` follows the new text.
    """
    takes = plan(docs, block=block).where("taken > 0")
    same = Window.partitionBy("doc_id", "source", "size").orderBy("start")
    takes = keep(
        takes.withColumn("_turn", F.row_number().over(same)).select(
            F.col("doc_id").alias("_id"), F.col("source").alias("_from"), F.col("size").alias("_size"), "_turn",
            F.col("passes").alias("_passes"), F.col("start").alias("_start"), F.col("blocks").alias("_blocks"),
            F.col("rest").alias("_rest"), F.col("step").alias("_step"), F.col("shift").alias("_shift"), F.col("unit").alias("_unit"),
            (F.col("taken") - F.col("passes") * F.col("size")).alias("_part"),
        ),
        "takes",
    )
    repeated = takes.where("_turn > 1").limit(1).count() > 0
    # The columns of docs stay together in one, so that none can clash with a name used here.
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("doc_id").cast("long").alias("_doc"),
        F.col("source").alias("_source"), F.col("text").alias("_body"), words_in().alias("_words"),
    )
    if repeated:
        order = Window.partitionBy("_doc", "_source", "_words").orderBy(F.xxhash64("_body"))
        rows = rows.withColumn("_number", F.row_number().over(order))
    else:
        rows = rows.withColumn("_number", F.lit(1))
    rows = rows.join(
        takes,
        F.col("_doc").eqNullSafe(F.col("_id")) & F.col("_source").eqNullSafe(F.col("_from"))
        & (F.col("_words") == F.col("_size")) & (F.col("_number") == F.col("_turn")),
    )
    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def cut(
        text: pd.Series, start: pd.Series, blocks: pd.Series, rest: pd.Series, step: pd.Series, shift: pd.Series, unit: pd.Series
    ) -> pd.Series:
        return pd.Series([_cut(*row) for row in zip(text, start, blocks, rest, step, shift, unit)], dtype=object)

    whole = F.array_repeat(F.col("_body"), F.col("_passes").cast("int"))
    part = F.when(F.col("_part") > 0, F.array(cut("_body", "_start", "_blocks", "_rest", "_step", "_shift", "_unit")))
    texts = F.concat(whole, F.coalesce(part, F.array().cast("array<string>")))
    out = rows.withColumn("_text", F.explode(texts))
    return out.select(
        *(
            F.col("_text").alias(c) if c == "text"
            else F.char_length("_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
            else F.col("_row").getField(c).alias(c)
            for c in docs.columns
        )
    )


def _cut(text: str, start: int, blocks: int, rest: int, step: int, shift: int, block: int) -> str:
    """The words of a text that lie in chosen blocks, with the white space between neighbours."""
    parts: list[str] = []
    begin = end = -1
    for i, m in enumerate(_WORD.finditer(text)):
        b = (start + i) // block
        if (b * step + shift) % blocks < rest:
            if begin < 0:
                begin = m.start()
            end = m.end()
        elif begin >= 0:
            parts.append(text[begin:end])
            begin = -1
    if begin >= 0:
        parts.append(text[begin:end])
    return "\n".join(parts)
