"""The registered queries of these operators: (spark, folder of the tables) -> DataFrame.

``ORACLES`` has SQL where DuckDB can express a query's rows on whole tables in good time; the others are held against brute force, an exact round trip or held-out
labels in tests/llm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tramline.llm import (
    archives, codes, exact, languages, minmax, mixing, neighbours, packing, privacy, resampling, sharding, syncmers,
    toxicity,
)
from tramline.llm.common import read


def op1_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_fingerprints(read(spark, sf_dir, "documents"))


def op2_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(read(spark, sf_dir, "documents"))


def op3_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"))


def op4_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.personal_data(read(spark, sf_dir, "documents"))


def op5_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op6_hypergeometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffle(read(spark, sf_dir, "documents"))


def op7_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_gzip_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.archive(read(spark, sf_dir, "pages"))


def op9_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"))


def op10_rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.languages(read(spark, sf_dir, "documents"))


def op11_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.vector_codes(read(spark, sf_dir, "embeddings"))


def op12_batch_concatenation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_skew_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_syncmers, op2_minmax, op3_hnsw, op4_skip_chain, op5_sainte_lague, op6_hypergeometric,
        op7_weak_supervision, op8_gzip_normaliser, op9_sum_of_squares, op10_rank_order,
        op11_cover_tree, op12_batch_concatenation, op13_skew_safe, pipeline,
    )
}

ORACLES: dict[str, str] = {
    "op11_cover_tree": codes.SQL,
    "op12_batch_concatenation": resampling.SQL,
    "op13_skew_safe": exact.SQL,
}
