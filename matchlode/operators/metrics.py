"""Retrieval, ranking and calibration metrics of labelled scores; ties in score form one threshold."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import safe_rate
from ..storage import cut

EDGES = tuple(i / 10 for i in range(1, 10))


def by_score(rows: DataFrame) -> DataFrame:
    """score, n, positives, tp, seen: running counts from the greatest score down. rows: score, label.

    Running sums are taken in ranges of scores, which are then put behind each other, so that no task
    holds all scores.
    """
    grouped = rows.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("long")).alias("positives"))
    dealt = cut(grouped.repartitionByRange(F.desc("score")).withColumn("part", F.spark_partition_id()), "scores")
    inside = Window.partitionBy("part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumn("tp", F.sum("positives").over(inside)).withColumn("seen", F.sum("n").over(inside))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = dealt.groupBy("part").agg(F.sum("positives").alias("p"), F.sum("n").alias("m"))
    starts = starts.select("part", F.coalesce(F.sum("p").over(ahead), F.lit(0)).alias("p0"), F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("m0"))
    return own.join(F.broadcast(starts), "part").select("score", "n", "positives", (F.col("tp") + F.col("p0")).alias("tp"), (F.col("seen") + F.col("m0")).alias("seen"))


def average_precision(rows: DataFrame) -> DataFrame:
    """One row: sum of recall steps times precision; 0 without positives."""
    return by_score(rows).agg(F.coalesce(safe_rate(F.sum(F.col("positives") * (F.col("tp") / F.col("seen"))), F.sum("positives")), F.lit(0.0)).alias("average_precision"))


def roc_auc(rows: DataFrame) -> DataFrame:
    """One row: share of positive-negative pairs in the right order, ties half; 0 with a single class."""
    behind = F.col("positives") * (F.col("n") - F.col("positives")) / 2
    below = F.col("positives") * (F.col("all_n") - F.col("seen") - (F.col("all_p") - F.col("tp")))
    totals = rows.agg(F.count(F.lit(1)).alias("all_n"), F.coalesce(F.sum(F.col("label").cast("long")), F.lit(0)).alias("all_p"))
    own = by_score(rows).crossJoin(F.broadcast(totals))  # one row
    p, n = F.max("all_p"), F.max("all_n") - F.max("all_p")
    return own.agg(F.coalesce(F.when((p > 0) & (n > 0), F.sum(below + behind) / (p * n)), F.lit(0.0)).alias("roc_auc"))


def brier(rows: DataFrame) -> DataFrame:
    d = F.col("score") - F.col("label")
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("long")).alias("positives"), F.avg(F.col("label").cast("double")).alias("observed_rate"), F.avg("score").alias("mean_score"), F.avg(d * d).alias("brier")
    )


def pr_curve(rows: DataFrame) -> DataFrame:
    """score, precision, recall for each distinct score."""
    total = rows.agg(F.sum(F.col("label").cast("long")).alias("total"))
    return by_score(rows).crossJoin(F.broadcast(total)).select("score", (F.col("tp") / F.col("seen")).alias("precision"), safe_rate(F.col("tp"), F.col("total")).alias("recall"))  # one row


def reliability_bins(rows: DataFrame) -> DataFrame:
    """bin, n, mean_score, positive_rate of ten equal bins; a value on an edge is in the lower bin, empty bins are left out."""
    place = F.size(F.filter(F.array(*map(F.lit, EDGES)), lambda e: e < F.col("score")))
    return rows.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.avg(F.col("label").cast("double")).alias("positive_rate"))


def pair_metrics(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: counts, precision, recall, F1 at threshold and Brier."""
    if not 0 <= threshold <= 1:
        raise ValueError("the classification threshold must be in [0, 1]")
    hit, said = F.count(F.when((F.col("score") >= threshold) & (F.col("label") == 1), 1)), F.count(F.when(F.col("score") >= threshold, 1))
    real = F.count(F.when(F.col("label") == 1, 1))
    d = F.col("score") - F.col("label")
    return rows.agg(
        F.count(F.lit(1)).alias("n"), real.alias("positives"), F.lit(float(threshold)).alias("threshold"),
        safe_rate(hit, said).alias("precision"), safe_rate(hit, real).alias("recall"), safe_rate(2 * hit, said + real).alias("f1"), F.avg(d * d).alias("brier"),
    )


def recall_at_k(pool: DataFrame, gold: DataFrame, ks: Iterable[int], depth: int) -> DataFrame:
    """channel, k, recall: gold-bearing listings with a gold pair within rank k, by channel, in one pass. Injected rows do not count."""
    ks = sorted(set(ks))
    if not ks or ks[0] < 1 or ks[-1] > depth:
        raise ValueError("every k must be from 1 to the retrieval depth")
    own = gold.select("google_id", "amazon_id").distinct()
    hits = pool.filter(~F.coalesce("gold_injected", F.lit(False))).join(own, ["google_id", "amazon_id"], "left_semi")
    best = hits.groupBy("google_id").agg(*(F.min(c).alias(c) for c in ("lexical_rank", "dense_rank", "rrf_rank")))
    total = own.select("google_id").distinct()
    joined = total.join(best, "google_id", "left").withColumn("union_rank", F.least("lexical_rank", "dense_rank"))
    names = {"lexical": "lexical_rank", "dense": "dense_rank", "rrf": "rrf_rank", "union": "union_rank"}
    one = joined.agg(F.count(F.lit(1)).alias("n"), *(F.count(F.when(F.col(c) <= k, 1)).alias(f"{name}_{k}") for name, c in names.items() for k in ks))
    cells = [F.struct(F.lit(name).alias("channel"), F.lit(k).alias("k"), safe_rate(F.col(f"{name}_{k}"), F.col("n")).alias("recall")) for name in names for k in ks]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def candidate_counts(pool: DataFrame, listings: DataFrame) -> DataFrame:
    """One row: listings and mean number of distinct candidates, 0 where a listing has none. listings: google_id."""
    own = pool.select("google_id", "amazon_id").distinct().groupBy("google_id").agg(F.count(F.lit(1)).alias("n"))
    return listings.select("google_id").distinct().join(own, "google_id", "left").agg(F.count(F.lit(1)).alias("listings"), F.avg(F.coalesce("n", F.lit(0))).alias("mean_candidates"))


def latency_summary(rows: DataFrame, column: str = "ms") -> DataFrame:
    return rows.agg(F.sum(column).alias("total_ms"), F.avg(column).alias("mean_ms"), F.percentile(column, 0.95).alias("p95_ms"))


def no_match_detection(decisions: DataFrame) -> DataFrame:
    """One row: average precision of 1 - score for listings without gold, precision (null if unused) and recall of auto_no_match."""
    rows = decisions.select((1 - F.col("score")).alias("score"), (~F.col("has_gold_listing")).cast("int").alias("label"))
    said = F.col("action") == "auto_no_match"
    hit, used = F.count(F.when(said & ~F.col("has_gold_listing"), 1)), F.count(F.when(said, 1))
    real = F.count(F.when(~F.col("has_gold_listing"), 1))
    rates = decisions.agg(F.when(used > 0, hit / used).alias("precision"), safe_rate(hit, real).alias("recall"))
    return average_precision(rows).crossJoin(rates)  # one row each
