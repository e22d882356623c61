"""Error examples, collisions of titles, and reports without them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import title_signature


def title_collisions(listings: DataFrame, catalog: DataFrame, gold: DataFrame) -> DataFrame:
    """Listings without gold whose title's signature is not empty and occurs in the catalog. Tables: google_id / amazon_id, title."""
    own = catalog.select(title_signature(F.col("title")).alias("signature")).filter("signature <> ''").distinct()
    return listings.join(gold.select("google_id"), "google_id", "left_anti").withColumn("signature", title_signature(F.col("title"))).join(own, "signature", "left_semi")


#: Error types of listings, in order, and what makes one.
LISTING_ERRORS = {
    "false_automatic_match": "action = 'auto_match' AND NOT is_gold_pair",
    "false_automatic_no_match": "action = 'auto_no_match' AND has_gold_listing",
    "reviewed_top_gold_match": "action = 'manual_review' AND is_gold_pair",
    "retrieval_miss": "ranking_outcome = 'retrieval_miss'",
    "reranking_miss": "ranking_outcome = 'reranking_miss'",
}


def listing_errors(decisions: DataFrame, most: int, key: str = "google_id") -> DataFrame:
    """error_type and the first `most` decisions of each type by key.

    One pass: tasks keep the least `most` keys of each type, and a decision may have two types.
    """
    if most <= 0:
        raise ValueError("at least one example of a type is needed")
    kinds = F.filter(F.array(*(F.when(F.expr(rule), F.lit(kind)) for kind, rule in LISTING_ERRORS.items())), lambda k: k.isNotNull())
    marked = decisions.withColumn("error_type", F.explode(kinds))
    return marked.withColumn("_place", F.row_number().over(Window.partitionBy("error_type").orderBy(key))).filter(F.col("_place") <= most).drop("_place")


def pair_errors(pairs: DataFrame, most: int, threshold: float = 0.5) -> DataFrame:
    """error_type and the most confident wrong pairs: score, label, ordinal; ties by ordinal."""
    if most <= 0:
        raise ValueError("at least one example of a type is needed")
    high = pairs.filter((F.col("label") == 0) & (F.col("score") >= threshold)).orderBy(F.desc("score"), "ordinal").limit(most).withColumn("error_type", F.lit("pair_false_positive_at_0_5"))
    low = pairs.filter((F.col("label") == 1) & (F.col("score") < threshold)).orderBy("score", "ordinal").limit(most).withColumn("error_type", F.lit("pair_false_negative_at_0_5"))
    return high.unionByName(low)


def with_context(errors: DataFrame, products: DataFrame, key: str, prefix: str) -> DataFrame:
    """Adds title, manufacturer and price of the product, prefixed; the first row of a repeated id."""
    own = products.groupBy(F.col("product_id").alias(key)).agg(F.min_by(F.struct("title", "manufacturer", "price"), F.col("ordinal")).alias("p"))
    return errors.join(own, key, "left").select(*errors.columns, *(F.col(f"p.{c}").alias(f"{prefix}_{c}") for c in ("title", "manufacturer", "price")))
