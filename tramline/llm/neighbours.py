"""Approximate nearest neighbours: a navigable small-world graph per shard, shard results merged.

Equal vectors are one node. Nodes are dealt to shards of about ``SHARD`` at random; each
shard's hierarchical graph is built by one task and written as flat arrays (a row of
neighbour numbers per node and level). Every shard answers all queries, and the
best of all shards are merged.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.llm.common import keep, ship, tasks

SHARD, BLOCK = 4_000, 1_000
ROUNDS = 4  # tasks of a search for each that can run at once
LINKS, BUILD, SEARCH = 12, 64, 80
SEED = 17


class Graph:
    """A hierarchical small-world graph over unit vectors (float32), as flat neighbour arrays.

    ``links[level]`` is int32[nodes, width] with -1 behind the last neighbour; a node's level
    is drawn with a rate of 1 / LINKS per step up. Level 0 keeps twice as many neighbours.
    """

    def __init__(self, vectors: np.ndarray, links: list[np.ndarray] | None = None, entry: int = 0):
        self.vectors, self.links, self.entry = vectors, links or [], entry

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = SEED) -> Graph:
        n = len(vectors)
        draws = np.random.default_rng(seed).random(n)
        levels = np.minimum((-np.log(1 - draws) / np.log(LINKS)).astype(int), 8)
        graph = cls(vectors)
        graph.links = [np.full((n, LINKS * (2 if level == 0 else 1)), -1, np.int32) for level in range(levels.max(initial=0) + 1)]
        top = levels[0] if n else 0
        for node in range(1, n):
            at = graph.entry
            for level in range(top, levels[node], -1):
                at = graph._search(vectors[node], [at], level, 1)[0][1]
            starts = [at]
            for level in range(min(top, levels[node]), -1, -1):
                found = graph._search(vectors[node], starts, level, BUILD)
                starts = [i for _, i in found]
                graph._link(node, found, level)
            if levels[node] > top:
                top, graph.entry = levels[node], node
        return graph

    def _link(self, node: int, found: list[tuple[float, int]], level: int) -> None:
        table = self.links[level]
        chosen = self._spread(found, LINKS)
        table[node, : len(chosen)] = chosen
        for other in chosen:
            row = table[other]
            free = int((row >= 0).sum())
            if free < len(row):
                row[free] = node
                continue
            near = np.append(row, node)
            ranked = self.vectors[near] @ self.vectors[other]
            kept = self._spread(sorted(zip((-ranked).tolist(), near.tolist())), len(row))
            row[:] = -1
            row[: len(kept)] = kept

    def _spread(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Near nodes in different directions: skip one nearer to a chosen node than to the centre, then fill up."""
        ids = np.array([i for _, i in found])
        near = np.array([-d for d, _ in found])
        if len(ids) <= most:
            return ids.tolist()
        between = self.vectors[ids] @ self.vectors[ids].T
        chosen: list[int] = []
        closest = np.full(len(ids), -2.0)
        for i in range(len(ids)):
            if closest[i] <= near[i]:
                chosen.append(i)
                closest = np.maximum(closest, between[i])
                if len(chosen) == most:
                    break
        rest = [i for i in range(len(ids)) if i not in set(chosen)]
        return ids[chosen + rest[: most - len(chosen)]].tolist()

    def _search(self, query: np.ndarray, starts: list[int], level: int, most: int) -> list[tuple[float, int]]:
        """Up to ``most`` nearest nodes found from ``starts``, as (-cosine, node), nearest first."""
        table, vectors = self.links[level], self.vectors
        seen = set(starts)
        first = (-(vectors[starts] @ query)).tolist()
        ahead = list(zip(first, starts))
        heapq.heapify(ahead)
        best = [(-d, -i) for d, i in ahead]
        heapq.heapify(best)
        while len(best) > most:
            heapq.heappop(best)
        while ahead:
            d, node = heapq.heappop(ahead)
            if len(best) >= most and d > -best[0][0]:
                break
            fresh = [i for i in table[node].tolist() if i >= 0 and i not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for nd, i in zip((-(vectors[fresh] @ query)).tolist(), fresh):
                if len(best) < most:
                    heapq.heappush(best, (-nd, -i))
                    heapq.heappush(ahead, (nd, i))
                elif nd < -best[0][0]:
                    heapq.heapreplace(best, (-nd, -i))
                    heapq.heappush(ahead, (nd, i))
        return sorted((-d, -i) for d, i in best)

    def nearest(self, query: np.ndarray, most: int = SEARCH) -> list[int]:
        if not len(self.vectors):
            return []
        at = self.entry
        for level in range(len(self.links) - 1, 0, -1):
            at = self._search(query, [at], level, 1)[0][1]
        return [i for _, i in self._search(query, [at], 0, most)]


def _unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled by the largest component first, so that no square over- or underflows.
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return (vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))).astype(np.float32)


def cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines in double precision of one vector with each row."""
    query, vectors = query.astype(np.float64), vectors.astype(np.float64)
    big, each = np.abs(query).max(), np.abs(vectors).max(axis=1)
    query, vectors = query / big, vectors / each[:, None]
    return (vectors * query).sum(axis=1) / (np.sqrt((query * query).sum()) * np.sqrt((vectors * vectors).sum(axis=1)))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding: array<double>) of vectors without NULL or non-finite components, not zero."""
    part = F.col("embedding").cast("array<double>")
    finite = F.forall(part, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), part.alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(
        finite & F.exists("embedding", lambda x: x != 0)
    )


INDEX = "shard int, dims int, vectors binary, members binary, offsets binary, entry int, levels int, links binary"


def build_index(rows: DataFrame, k: int, shard: int = SHARD) -> DataFrame:
    """One row per shard: unit vectors' originals, member ids, and the graph's flat arrays.

    Equal vectors (and dimensions) share a node that lists its k + 1 smallest ids: more can
    never be among k nearest, as all score the same. Every vector is in the index.
    """
    key = F.xxhash64("embedding")
    place = F.row_number().over(Window.partitionBy("_key", "embedding").orderBy("vec_id"))
    members = rows.select("vec_id", "embedding").distinct().withColumn("_key", key).withColumn("_place", place)
    nodes = keep(
        members.where(F.col("_place") <= k + 1).groupBy("_key", "embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")),
        "vectors",
    )
    shards = max(1, -(-nodes.count() // shard))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64(F.lit(SEED), "_key"), F.lit(shards)).cast("int")).withColumn("dims", F.size("embedding"))
    ship(rows.sparkSession)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_key", kind="stable")
        vectors = np.stack(group["embedding"].to_list()).astype(np.float64)
        graph = Graph.build(_unit(vectors))
        ids = group["ids"].to_list()
        return pd.DataFrame({
            "shard": [int(group["shard"].iloc[0])], "dims": [vectors.shape[1]], "vectors": [vectors.tobytes()],
            "members": [np.concatenate(ids).astype(np.int64).tobytes()],
            "offsets": [np.cumsum([0, *map(len, ids)]).astype(np.int64).tobytes()],
            "entry": [graph.entry], "levels": [len(graph.links)],
            "links": [b"".join(table.tobytes() for table in graph.links)],
        })

    spread = dealt.repartition(shards, "shard", "dims")
    return keep(spread.groupBy("shard", "dims").applyInPandas(run, INDEX), "graphs")


def _loaded(row: pd.Series) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, int(row["dims"]))
    n, flat = len(vectors), np.frombuffer(row["links"], np.int32)
    links, at = [], 0
    for level in range(int(row["levels"])):
        width = LINKS * (2 if level == 0 else 1)
        links.append(flat[at : at + n * width].reshape(n, width))
        at += n * width
    return (
        Graph(_unit(vectors), links, int(row["entry"])), vectors,
        np.frombuffer(row["members"], np.int64), np.frombuffer(row["offsets"], np.int64),
    )


def _answers(graph: tuple, query_ids: list[int], queries: np.ndarray, k: int) -> list[tuple]:
    index, vectors, members, offsets = graph
    out: list[tuple] = []
    for query_id, query, unit in zip(query_ids, queries, _unit(queries)):
        near = np.array(index.nearest(unit))
        scores = cosines(query, vectors[near])
        found = [
            (-score, vec_id)
            for node, score in zip(near.tolist(), scores.tolist())
            for vec_id in members[offsets[node] : offsets[node + 1]].tolist()
            if vec_id != query_id
        ]
        out += [(query_id, vec_id, -d) for d, vec_id in heapq.nsmallest(k, found)]
    return out


def search(index: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest found, itself excluded.

    Every shard answers all queries of its dimension. A shard's queries are split over as many
    tasks as keep the session's busy, a block of queries each at least, and never more: a
    graph is sent once to each of these tasks, ahead of the queries it answers there, which
    then pass in Arrow batches. A task holds one graph and one batch.
    """
    spark = index.sparkSession
    shards, asked = max(1, index.count()), queries.count()
    splits = max(1, min(-(-asked // block), -(-ROUNDS * tasks(spark) // shards)))
    number = F.pmod(F.xxhash64(F.lit(SEED), "query_id"), F.lit(splits)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))
    graphs = index.select("*", every.alias("split"), F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("array<double>").alias("query"))
    places = index.select("shard", "dims")
    sent = queries.select("query_id", "query", F.size("query").alias("dims"), number.alias("split")).join(places, "dims")
    keys = ["shard", "dims", "split"]
    rows = graphs.unionByName(sent, allowMissingColumns=True).repartition(min(shards * splits, ROUNDS * tasks(spark)), *keys)
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = None
        for batch in batches:
            out: list[tuple] = []
            heads = batch["links"].notna().to_numpy()
            # A graph begins the rows of its key; those before the first belong to the batch before.
            bounds = [0, *np.flatnonzero(heads).tolist(), len(batch)]
            for low, high in zip(bounds, bounds[1:]):
                if low < high and heads[low]:
                    graph, low = _loaded(batch.iloc[low]), low + 1
                if low < high:
                    part = batch.iloc[low:high]
                    out += _answers(graph, part["query_id"].astype("int64").tolist(), np.stack(part["query"].to_list()).astype(np.float64), k)
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    # NULL sorts first: the graph comes ahead of its queries.
    found = rows.sortWithinPartitions(*keys, F.col("query_id").asc_nulls_first()).mapInPandas(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = found.withColumn("rank", F.row_number().over(order).cast("int"))
    return merged.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The ``k`` nearest of every row whose vec_id is divisible by ``every``, by cosine.

    Vectors that are NULL, zero or hold NULL or non-finite components take no part, nor do
    rows without vec_id. Equal scores go to the smaller vec_id; repeated rows count once, and
    rows that share a vec_id with different vectors are candidates each, and ask with the
    smallest of these vectors (component by component). Vectors of different
    lengths never meet. An empty table gives an empty result.
    """
    rows = keep(usable(vectors), "usable")
    asking = rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id"))
    queries = asking.agg(F.min("embedding").alias("query"))
    return search(build_index(rows, k), queries, k)
