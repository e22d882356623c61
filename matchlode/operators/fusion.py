"""Fusion of two ranked lists by reciprocal ranks, and gold pairs put in for training."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import rrf_score, source_label

KEYS = ["google_id", "amazon_id"]


def union_pool(lexical: DataFrame, dense: DataFrame, constant: float = 60.0) -> DataFrame:
    """Every pair of either list, with both ranks where it has them, fused and ranked. Lists: KEYS, score, rank."""
    left = lexical.select(*KEYS, F.col("score").alias("lexical_score"), F.col("rank").cast("int").alias("lexical_rank"))
    right = dense.select(*KEYS, F.col("score").alias("dense_score"), F.col("rank").cast("int").alias("dense_rank"))
    joined = left.join(right, KEYS, "full_outer")
    scored = joined.withColumn("rrf_score", F.round(rrf_score(constant, F.col("lexical_rank"), F.col("dense_rank")), 12))
    best = Window.partitionBy("google_id").orderBy(F.desc("rrf_score"), F.col("amazon_id").cast("string"))
    return scored.select(
        *KEYS, "lexical_score", "dense_score", "lexical_rank", "dense_rank", "rrf_score", F.row_number().over(best).alias("rrf_rank"),
        source_label(F.col("lexical_rank"), F.col("dense_rank")).alias("retrieval_sources"), F.lit(False).alias("gold_injected"),
    )


def fused(pool: DataFrame, k: int) -> DataFrame:
    return pool.filter(F.col("rrf_rank") <= k)


def inject_gold(pool: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """The k best pairs of each listing and all its gold pairs; those that were put in are marked.

    A gold pair further down the pool keeps its ranks; one outside has none and RRF 0.
    """
    marked = pool.join(gold.select(*KEYS).distinct().withColumn("_gold", F.lit(True)), KEYS, "full_outer")
    put_in = F.coalesce(F.col("_gold"), F.lit(False)) & (F.coalesce(F.col("rrf_rank"), F.lit(k + 1)) > k)
    label = F.when(put_in, F.concat_ws("+", F.nullif(F.col("retrieval_sources"), F.lit("")), F.lit("gold_injected"))).otherwise(F.col("retrieval_sources"))
    out = marked.filter((F.col("rrf_rank") <= k) | F.col("_gold"))
    return out.select(*KEYS, "lexical_score", "dense_score", "lexical_rank", "dense_rank", F.coalesce("rrf_score", F.lit(0.0)).alias("rrf_score"), "rrf_rank", label.alias("retrieval_sources"), put_in.alias("gold_injected"))


def with_label(pairs: DataFrame, gold: DataFrame) -> DataFrame:
    """Adds label: 1 for gold pairs, else 0."""
    known = gold.select(*KEYS).distinct().withColumn("label", F.lit(1))
    return pairs.join(known, KEYS, "left").withColumn("label", F.coalesce("label", F.lit(0)))
