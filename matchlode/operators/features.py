"""Interpretable pair features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzy import indel_similarity, token_set_similarity
from ..functions.stats import reciprocal_rank
from ..functions.text import jaccard, model_tokens, normalized, relative_difference, sets_conflict, tokens, valid_price

#: Names and order of a saved matcher's features: fixed values.
LEXICAL = ("lexical_similarity", "title_token_jaccard", "title_fuzzy_similarity", "manufacturer_exact", "manufacturer_fuzzy_similarity")
DENSE = ("dense_similarity",)
HYBRID = (
    "lexical_similarity",
    "dense_similarity",
    "title_token_jaccard",
    "title_fuzzy_similarity",
    "manufacturer_exact",
    "manufacturer_fuzzy_similarity",
    "model_token_jaccard",
    "numeric_token_conflict",
    "relative_price_difference",
    "query_manufacturer_missing",
    "candidate_manufacturer_missing",
    "query_description_missing",
    "candidate_description_missing",
    "query_price_missing",
    "candidate_price_missing",
)
RANK = ("retrieval_source_agreement", "reciprocal_lexical_rank", "reciprocal_dense_rank")
VARIANTS = {"lexical_logistic": LEXICAL, "dense_logistic": DENSE, "hybrid_logistic": HYBRID, "hybrid_rank_logistic": (*HYBRID, *RANK)}


def _side(products: DataFrame, key: str, tag: str) -> DataFrame:
    title, maker, text = (normalized(F.col(c)) for c in ("title", "manufacturer", "description"))
    return products.select(
        F.col("product_id").alias(key), title.alias(f"{tag}_title"), maker.alias(f"{tag}_maker"), text.alias(f"{tag}_text"), valid_price(F.col("price")).alias(f"{tag}_price"),
        tokens(title).alias(f"{tag}_tokens"), model_tokens(title).alias(f"{tag}_models"),
    )


def pair_features(pairs: DataFrame, listings: DataFrame, catalog: DataFrame) -> DataFrame:
    """pairs (google_id, amazon_id, optional scores and ranks) with all features of HYBRID and RANK.

    Normalisation and token sets are computed once a product, before the join. An id that no product
    has raises when the rows are computed; the check is part of the join.
    """
    for key in ("google_id", "amazon_id"):
        if key not in pairs.columns:
            raise ValueError(f"pairs lack {key}")

    def given(c: str, kind: str):
        return F.col(c).cast(kind) if c in pairs.columns else F.lit(None).cast(kind)

    both = pairs.join(_side(listings, "google_id", "g"), "google_id", "left").join(_side(catalog, "amazon_id", "a"), "amazon_id", "left")

    def known(key: str, tag: str):
        lost = F.raise_error(F.concat(F.lit(f"{key} holds an id that no product has: "), F.col(key).cast("string"))).cast(pairs.schema[key].dataType)
        return F.when(F.col(f"{tag}_title").isNotNull(), F.col(key)).otherwise(lost).alias(key)

    keys = {"google_id": known("google_id", "g"), "amazon_id": known("amazon_id", "a")}
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    values = {
        "lexical_similarity": F.coalesce(given("lexical_score", "double"), F.lit(0.0)),
        "title_token_jaccard": jaccard(F.col("g_tokens"), F.col("a_tokens")),
        "title_fuzzy_similarity": token_set_similarity(F.col("g_title"), F.col("a_title")),
        "manufacturer_exact": flag((F.col("g_maker") != "") & (F.col("g_maker") == F.col("a_maker"))),
        "manufacturer_fuzzy_similarity": indel_similarity(F.col("g_maker"), F.col("a_maker")),
        "dense_similarity": F.coalesce(given("dense_score", "double"), F.lit(0.0)),
        "model_token_jaccard": jaccard(F.col("g_models"), F.col("a_models")),
        "numeric_token_conflict": flag(sets_conflict(F.col("g_models"), F.col("a_models"))),
        "relative_price_difference": relative_difference(F.col("g_price"), F.col("a_price")),
        "query_manufacturer_missing": flag(F.col("g_maker") == ""),
        "candidate_manufacturer_missing": flag(F.col("a_maker") == ""),
        "query_description_missing": flag(F.col("g_text") == ""),
        "candidate_description_missing": flag(F.col("a_text") == ""),
        "query_price_missing": flag(F.col("g_price").isNull()),
        "candidate_price_missing": flag(F.col("a_price").isNull()),
        "retrieval_source_agreement": flag(given("lexical_rank", "int").isNotNull() & given("dense_rank", "int").isNotNull()),
        "reciprocal_lexical_rank": reciprocal_rank(given("lexical_rank", "int")),
        "reciprocal_dense_rank": reciprocal_rank(given("dense_rank", "int")),
    }
    return both.select(*(keys.get(c, F.col(c)) for c in pairs.columns if c not in values), *(values[c].alias(c) for c in (*HYBRID, *RANK)))
