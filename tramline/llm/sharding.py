"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many rows of each input partition go to each shard is drawn first, from the joint
distribution a uniform permutation of all rows would give (margins fixed: partition sizes and
shard sizes). The partitions are halved again and again; a half's share of every shard is a
chain of hypergeometric draws, so P partitions need log2 P steps over a table of at most P
rows. Then every partition permutes its rows and deals them by its row of the matrix, and
every shard permutes what it received. Built from DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.llm.common import keep, tasks

SHARDS = 16
SEED = 23


def _uniform(*parts: Column) -> Column:
    """A seeded number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def hypergeometric(total: Column, marked: Column, draws: Column, u: Column) -> Column:
    """Number of marked among ``draws`` of ``total`` rows, of which ``marked`` are; by inversion.

    Probabilities relative to the mode follow from their neighbours' by the ratio of two
    binomials, so no factorial is needed. They are summed 12 standard deviations and 30 to
    both sides, beyond which doubles hold nothing, then the outcomes are walked from the mode
    upwards and downwards until ``u`` of the sum is used up.
    """
    total, marked, draws = (c.cast("double") for c in (total, marked, draws))
    low = F.greatest(F.lit(0.0), draws + marked - total)
    high = F.least(draws, marked)
    mode = F.least(high, F.greatest(low, F.floor((draws + 1) * (marked + 1) / (total + 2)).cast("double")))
    share = marked / F.greatest(total, F.lit(1.0))
    spread = F.sqrt(draws * share * (1 - share)) * 12 + 30
    top, bottom = F.least(high, F.ceil(mode + spread).cast("double")), F.greatest(low, F.floor(mode - spread).cast("double"))

    def up(x: Column) -> Column:  # p(x) / p(x - 1)
        return (marked - x + 1) * (draws - x + 1) / (x * (total - marked - draws + x))

    def down(x: Column) -> Column:  # p(x) / p(x + 1)
        return (x + 1) * (total - marked - draws + x + 1) / ((marked - x) * (draws - x))

    above = F.when(top > mode, F.sequence((mode + 1).cast("long"), top.cast("long"))).otherwise(F.array().cast("array<long>"))
    below = F.when(bottom < mode, F.sequence((mode - 1).cast("long"), bottom.cast("long"), F.lit(-1).cast("long"))).otherwise(
        F.array().cast("array<long>")
    )

    def summed(values: Column, ratio) -> Column:
        start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("s"))
        step = lambda acc, x: F.struct(
            (acc["p"] * ratio(x.cast("double"))).alias("p"), (acc["s"] + acc["p"] * ratio(x.cast("double"))).alias("s")
        )
        return F.aggregate(values, start, step, lambda acc: acc["s"])

    def walked(values: Column, ratio, left: Column) -> Column:
        # left: what remains of u; the outcome where it drops below zero is the draw.
        start = F.struct(F.lit(1.0).alias("p"), left.alias("left"), mode.alias("x"))

        def step(acc: Column, x: Column) -> Column:
            p = acc["p"] * ratio(x.cast("double"))
            return F.when(acc["left"] < 0, acc).otherwise(
                F.struct(p.alias("p"), (acc["left"] - p).alias("left"), x.cast("double").alias("x"))
            )

        return F.aggregate(values, start, step, lambda acc: acc["x"])

    rise, fall = summed(above, up), summed(below, down)
    left = u * (1 + rise + fall) - 1
    drawn = F.when(left < 0, mode).when(left < rise, walked(above, up, left)).otherwise(walked(below, down, left - rise))
    return drawn.cast("long")


def _halved(caps: Column, total: Column, own: Column, seed: int, level: Column, node: Column) -> Column:
    """How many of ``own`` rows, out of ``total`` that fill ``caps``, go to each shard."""
    start = F.struct(
        F.lit(0).alias("i"), total.cast("long").alias("total"), own.cast("long").alias("own"),
        F.array().cast("array<long>").alias("x"),
    )

    def step(acc: Column, cap: Column) -> Column:
        x = hypergeometric(acc["total"], cap, acc["own"], _uniform(F.lit(seed), level, node, acc["i"]))
        return F.struct(
            (acc["i"] + 1).alias("i"), (acc["total"] - cap).alias("total"), (acc["own"] - x).alias("own"),
            F.concat(acc["x"], F.array(x)).alias("x"),
        )

    return F.aggregate(caps, start, step, lambda acc: acc["x"])


def matrix(sizes: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``part``, ``counts`` (array by shard) from (part: 0 to P-1, rows): the communication matrix."""
    facts = sizes.agg(F.sum("rows").alias("rows"), F.max("part").alias("last")).first()
    rows, last = facts["rows"] or 0, facts["last"] or 0
    levels = int(last).bit_length()
    caps = [rows // shards + (j < rows % shards) for j in range(shards)]
    spark = sizes.sparkSession
    nodes = spark.range(1).select(
        F.lit(0).cast("long").alias("node"), F.lit(rows).cast("long").alias("own"),
        F.array(*[F.lit(c).cast("long") for c in caps]).alias("counts"),
    )
    for level in range(levels - 1, -1, -1):
        lefts = (
            sizes.groupBy(F.shiftright(F.col("part").cast("long"), level).alias("_left"))
            .agg(F.sum("rows").cast("long").alias("_own")).where("_left % 2 = 0")
        )
        step = nodes.join(lefts, F.col("node") * 2 == F.col("_left"), "left").withColumn("_own", F.coalesce("_own", F.lit(0)))
        step = step.withColumn("_x", _halved(F.col("counts"), F.col("own"), F.col("_own"), seed, F.lit(level), F.col("node")))
        children = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("_own").alias("own"), F.col("_x").alias("counts")),
            F.struct(
                (F.col("node") * 2 + 1).alias("node"), (F.col("own") - F.col("_own")).alias("own"),
                F.zip_with("counts", "_x", lambda a, b: a - b).alias("counts"),
            ),
        )
        # Written step by step: the plan of the next one stays small.
        nodes = keep(step.select(F.inline(children)).where("own > 0"), "matrix")
    return nodes.select(F.col("node").alias("part"), "counts")


def shuffle(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of (doc_id, text).

    The law is ``rows``: shard sizes differ by one at most. Slots number a shard's rows from 0
    in a random order. NULL text counts as no bytes (size 1), repeated rows are rows of their
    own, NULL ids are ids like any other; an empty table gives an empty one.

    A row's identity is its place in the input (partition and number), so no key is hot: the
    narrow rows (no texts) are written once with that place and everything else reads them.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = keep(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("_row"),
        ).withColumn("_task", F.shiftright("_row", 33)),
        "narrow",
    )
    by_task = narrow.groupBy("_task").agg(F.count("*").alias("rows"))
    # One row per input partition.
    sizes = keep(by_task.withColumn("part", F.row_number().over(Window.orderBy("_task")) - 1), "partitions")
    dealt = matrix(sizes.select("part", "rows"), shards, seed)
    ends = F.transform(
        F.sequence(F.lit(1), F.lit(shards)), lambda i: F.aggregate(F.slice("counts", F.lit(1), i), F.lit(0).cast("long"), lambda a, b: a + b)
    )
    table = keep(sizes.join(dealt, "part").select("_task", ends.alias("_ends")), "dealt")
    local = Window.partitionBy("_task").orderBy(F.xxhash64(F.lit(seed + 1), "_row"), "_row")
    sent = (
        narrow.join(table, "_task")
        .withColumn("_place", F.row_number().over(local) - 1)
        .withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_place"))))
        .drop("_ends", "_place")
    )
    # The second permutation, in random bins of each shard: no window holds a whole shard.
    bins = F.lit(max(4, tasks(docs.sparkSession) // 4))
    sent = keep(sent.withColumn("_key", F.xxhash64(F.lit(seed + 2), "_row")).withColumn("_bin", F.pmod("_key", bins)), "sent")
    counts = sent.groupBy("shard", "_bin").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inner = Window.partitionBy("shard", "_bin").orderBy("_key", "_row")
    return sent.join(offsets, ["shard", "_bin"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("_offset") + F.row_number().over(inner) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
