"""Choice of the top candidate, and ranking metrics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import action_correct, policy_action, ranking_outcome, safe_rate


def ranked(pairs: DataFrame, score: str = "probability") -> DataFrame:
    """Adds model_rank (score descending, then amazon_id as text) and runner_up, the next score."""
    best = Window.partitionBy("google_id").orderBy(F.desc(score), F.col("amazon_id").cast("string"))
    return pairs.withColumn("model_rank", F.row_number().over(best)).withColumn("runner_up", F.lead(score, 1, 0.0).over(best))


def top_candidates(pairs: DataFrame, score: str = "probability") -> DataFrame:
    return ranked(pairs, score).filter("model_rank = 1").drop("model_rank", "runner_up")


def top_margins(pairs: DataFrame, score: str = "probability") -> DataFrame:
    """The top row of each listing with top1_top2_margin; a missing second counts as 0."""
    return ranked(pairs, score).filter("model_rank = 1").withColumn("top1_top2_margin", F.col(score) - F.col("runner_up")).drop("model_rank", "runner_up")


def gold_ranks(pairs: DataFrame, gold: DataFrame, score: str = "probability") -> DataFrame:
    """google_id, best_rank of each gold-bearing listing, whether it has candidates or not (null: not retrieved)."""
    own = gold.select("google_id", "amazon_id").distinct()
    hits = ranked(pairs, score).join(own, ["google_id", "amazon_id"], "left_semi").groupBy("google_id").agg(F.min("model_rank").alias("best_rank"))
    return own.select("google_id").distinct().join(hits, "google_id", "left")


def _evaluated(pairs: DataFrame, gold: DataFrame, listings: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Pairs and gold of the evaluated listings (google_id), all by default."""
    if listings is None:
        return pairs, gold
    ids = listings.select("google_id").distinct()
    return pairs.join(ids, "google_id", "left_semi"), gold.join(ids, "google_id", "left_semi")


def ranking_metrics(pairs: DataFrame, gold: DataFrame, score: str = "probability", listings: DataFrame | None = None) -> DataFrame:
    """One row: Hit@1 over all and over retrieved gold-bearing listings, MRR, and misses; 0 if there are none.

    Evaluated are `listings` (google_id; all gold-bearing ones by default): one without candidates is a retrieval miss.
    """
    pairs, own = _evaluated(pairs, gold, listings)
    n, found = F.count(F.lit(1)), F.count("best_rank")
    hits = F.count(F.when(F.col("best_rank") == 1, 1))
    return gold_ranks(pairs, own, score).agg(
        n.alias("gold_listings"),
        found.alias("retrieved_listings"),
        hits.alias("hits"),
        safe_rate(hits, n).alias("overall_hit_at_1"),
        safe_rate(hits, found).alias("conditional_hit_at_1"),
        F.coalesce(safe_rate(F.sum(F.coalesce(1 / F.col("best_rank"), F.lit(0.0))), n), F.lit(0.0)).alias("mrr"),
        (n - found).alias("retrieval_misses"),
        (found - hits).alias("reranking_misses"),
    )


def score_baselines(pairs: DataFrame, gold: DataFrame, scores: Iterable[str], listings: DataFrame | None = None) -> DataFrame:
    """ranking_metrics by each score over the same pairs, in one pass over the stacked scores; 0 for a score without hits."""
    pairs, own = _evaluated(pairs, gold.select("google_id", "amazon_id").distinct(), listings)
    stacked = pairs.select("google_id", "amazon_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, scores)), F.array(*(F.coalesce(F.col(s), F.lit(0.0)) for s in scores)))).alias("baseline", "value"))
    best = Window.partitionBy("baseline", "google_id").orderBy(F.desc("value"), F.col("amazon_id").cast("string"))
    hits = stacked.withColumn("r", F.row_number().over(best)).join(own, ["google_id", "amazon_id"], "left_semi").groupBy("baseline", "google_id").agg(F.min("r").alias("r"))
    sums = hits.groupBy("baseline").agg(F.count(F.when(F.col("r") == 1, 1)).alias("hits"), F.sum(1 / F.col("r")).alias("total"), F.count(F.lit(1)).alias("found"))
    names = pairs.sparkSession.createDataFrame([(s,) for s in scores], "baseline string")
    n = own.agg(F.countDistinct("google_id").alias("n"))
    filled = names.join(sums, "baseline", "left").fillna(0, ["hits", "total", "found"])
    return filled.crossJoin(F.broadcast(n)).select(  # one row
        "baseline", safe_rate(F.col("hits"), F.col("n")).alias("overall_hit_at_1"), safe_rate(F.col("hits"), F.col("found")).alias("conditional_hit_at_1"), safe_rate(F.col("total"), F.col("n")).alias("mrr")
    )


def listing_predictions(pairs: DataFrame, gold: DataFrame, groups: DataFrame, no_match: float | None, match: float | None, score: str = "probability") -> DataFrame:
    """One decision row for each listing with candidates. groups: google_id, duplicate_group_id; a listing without one raises."""
    own = gold.select("google_id", "amazon_id").distinct()
    bearing = own.select("google_id").distinct().withColumn("has_gold_listing", F.lit(True))
    retrieved = pairs.join(own, ["google_id", "amazon_id"], "left_semi").select("google_id").distinct().withColumn("gold_retrieved", F.lit(True))
    top = top_margins(pairs, score).join(groups.select("google_id", "duplicate_group_id"), "google_id", "left")
    lost = F.raise_error(F.concat(F.lit("no duplicate group for listing "), F.col("google_id"))).cast("string")
    top = top.withColumn("duplicate_group_id", F.when(F.trim("duplicate_group_id") != "", F.col("duplicate_group_id")).otherwise(lost))
    out = top.join(own.withColumn("is_gold_pair", F.lit(True)), ["google_id", "amazon_id"], "left").join(bearing, "google_id", "left").join(retrieved, "google_id", "left")
    for c in ("is_gold_pair", "has_gold_listing", "gold_retrieved"):
        out = out.withColumn(c, F.coalesce(c, F.lit(False)))
    out = out.withColumn("ranking_outcome", ranking_outcome(F.col("has_gold_listing"), F.col("gold_retrieved"), F.col("is_gold_pair")))
    out = out.withColumn("action", policy_action(F.col(score), no_match, match))
    return out.withColumn("action_correct", action_correct(F.col("action"), F.col("is_gold_pair"), F.col("has_gold_listing")))
