"""The two runs: develop (fit, choose, freeze) and evaluate (score a frozen run's test split)."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import policy_action
from ..functions.text import combined
from ..operators import errors, fusion, matcher, metrics, policy, ranking, search, splits
from ..operators.features import HYBRID, RANK, VARIANTS, pair_features
from ..sources.config import Config
from ..sources.encoder import identity
from ..storage import cut
from . import artifacts

Encoder = Callable[[DataFrame], DataFrame]
WIDTH = 128


def hashing_encoder(texts: DataFrame) -> DataFrame:
    """key, text to key, embedding: signed hashed 3-gram counts. A stand-in where no sentence model is at hand."""
    grams = texts.select("key", F.explode(search.char_grams(F.col("text"), 3, 3)).alias("gram"))
    cell = F.pmod(F.xxhash64("gram"), F.lit(WIDTH)).cast("int")
    sign = F.when(F.pmod(F.xxhash64("gram", F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    cells = grams.select("key", cell.alias("cell"), sign.alias("sign")).groupBy("key", "cell").agg(F.sum("sign").alias("v"))
    maps = cells.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("cell", "v"))).alias("m"))  # WIDTH entries at most
    own = F.coalesce("m", F.create_map().cast("map<int,double>"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda i: F.coalesce(F.try_element_at(own, i), F.lit(0.0)).cast("float"))
    return texts.select("key").join(maps, "key", "left").select("key", vector.alias("embedding"))


def _texts(products: DataFrame, key: str) -> DataFrame:
    return products.select(F.col("product_id").alias(key), "ordinal", combined(F.col("title"), F.col("manufacturer"), F.col("description")).alias("text"))


def _vectors(products: DataFrame, key: str, encoder: Encoder) -> DataFrame:
    texts = _texts(products, key)
    return texts.join(encoder(texts.select(F.col(key).alias("key"), "text")).withColumnRenamed("key", key), key).select(key, "ordinal", "embedding")


def fit_vocabulary(catalog: DataFrame, train: DataFrame, config: Config) -> DataFrame:
    texts = _texts(catalog, "key").unionByName(_texts(train, "key"))
    return search.vocabulary_of(search.gram_statistics(texts, *config.tfidf_ngram_range), texts.count(), config.tfidf_min_df, config.tfidf_max_features)


def retrieve(listings: DataFrame, catalog: DataFrame, vocabulary: DataFrame, catalog_vectors: DataFrame, encoder: Encoder, config: Config, gold: DataFrame | None = None, inject: bool = False) -> tuple[DataFrame, DataFrame]:
    """Candidates with both scores, and the whole pool. Only candidates get gold pairs put in, and only their pairs are scored."""
    if inject and gold is None:
        raise ValueError("injection needs gold pairs")
    low, high = config.tfidf_ngram_range
    queries, items = _texts(listings, "google_id"), _texts(catalog, "amazon_id")
    vectors = cut(_vectors(listings, "google_id", encoder), "vectors")
    k = config.top_k
    left = search.lexical_search(queries, items, vocabulary, k, low=low, high=high)
    right = search.dense_top_k(vectors, catalog_vectors, k)
    pool = cut(fusion.union_pool(left, right, config.rrf_constant), "pool")
    known = gold.join(queries.select("google_id"), "google_id", "left_semi").join(items.select("amazon_id"), "amazon_id", "left_semi") if inject else None
    picked = cut(fusion.inject_gold(pool, known, k) if inject else fusion.fused(pool, k), "picked")
    lexical = search.pair_scores(picked, queries, items, vocabulary, low=low, high=high)
    own = picked.drop("lexical_score", "dense_score").join(lexical.withColumnRenamed("score", "lexical_score"), fusion.KEYS, "left")
    own = own.join(vectors.select("google_id", F.col("embedding").alias("_q")), "google_id").join(catalog_vectors.select("amazon_id", F.col("embedding").alias("_c")), "amazon_id")
    scored = own.select(*fusion.KEYS, F.coalesce("lexical_score", F.lit(0.0)).alias("lexical_score"), search.cosine(F.col("_q"), F.col("_c")).alias("dense_score"), "lexical_rank", "dense_rank", "rrf_score", "rrf_rank", "retrieval_sources", "gold_injected")
    return cut(scored, "candidates"), pool


def _one(df: DataFrame) -> dict[str, Any]:
    return df.first().asDict(recursive=True)


def evaluate(candidates: DataFrame, pool: DataFrame, listings: DataFrame, catalog: DataFrame, gold: DataFrame, groups: DataFrame, model: matcher.Matcher, thresholds: dict[str, float | None], config: Config, seconds: float = 0.0) -> tuple[dict[str, Any], DataFrame, DataFrame]:
    """All metrics of one split, its listing predictions and error examples."""
    pairs = cut(matcher.predict(pair_features(candidates, listings, catalog), model), "scored")
    own_gold = gold.join(listings.select(F.col("product_id").alias("google_id")), "google_id", "left_semi")
    decisions = cut(ranking.listing_predictions(pairs, own_gold, groups, thresholds["no_match_threshold"], thresholds["match_threshold"]), "decisions")
    ids = listings.select(F.col("product_id").alias("google_id"))
    lost = ids.join(decisions, "google_id", "left_anti")
    if not lost.isEmpty():
        raise ValueError("a listing has no candidates")
    rows = fusion.with_label(pairs, own_gold).withColumn("score", F.col("probability"))
    said = decisions.withColumn("score", F.col("probability"))
    titles = [t.select(F.col("product_id").alias(k), "title") for t, k in ((listings, "google_id"), (catalog, "amazon_id"))]
    clear = said.join(errors.title_collisions(*titles, own_gold).select("google_id"), "google_id", "left_anti")
    top = said.select("score", F.col("is_gold_pair").cast("int").alias("label"))
    recall = metrics.recall_at_k(pool, own_gold, config.recall_ks, config.top_k).collect()  # a row a channel and k
    report = {
        "retrieval": {f"{r.channel}_recall_at_{r.k}": r.recall for r in recall} | _one(metrics.candidate_counts(candidates, listings.select(F.col("product_id").alias("google_id")))) | {"seconds": seconds},
        "score_baselines": [r.asDict() for r in ranking.score_baselines(pairs, own_gold, ("lexical_score", "dense_score", "rrf_score"), ids).collect()],
        "matcher_ranking": _one(ranking.ranking_metrics(pairs, own_gold, listings=ids)),
        "pair_matching": _one(metrics.pair_metrics(rows)) | _one(metrics.average_precision(rows)) | _one(metrics.roc_auc(rows)),
        "calibration": {"pair_level": _one(metrics.brier(rows)), "top_candidate": _one(metrics.brier(top)), "pair_bins": [r.asDict() for r in metrics.reliability_bins(rows).orderBy("bin").collect()]},
        "listing_policy": _one(policy.listing_report(said)),
        "action_statistics": [r.asDict() for r in policy.action_statistics(said).collect()],
        "no_match_detection": _one(metrics.no_match_detection(said)),
        "sensitivity": _one(policy.listing_report(clear)) | _one(metrics.no_match_detection(clear)) | {"action_statistics": [r.asDict() for r in policy.action_statistics(clear).collect()]},
    }
    n = config.error_examples_per_type
    found = errors.pair_errors(rows.withColumn("ordinal", F.xxhash64("google_id", "amazon_id")), n).unionByName(errors.listing_errors(said, n), allowMissingColumns=True)
    found = errors.with_context(errors.with_context(found, listings, "google_id", "google"), catalog, "amazon_id", "amazon")
    return report, decisions, found


def write_report(folder: str, report: dict[str, Any], tables: dict[str, DataFrame], csv: dict[str, DataFrame] | None = None) -> None:
    """Metrics and tables of a run, and small tables as one CSV file each; refuses a folder that is there."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        ordered = df.orderBy("google_id") if name == "listing_predictions" and "google_id" in df.columns else df
        ordered.write.mode("errorifexists").parquet(f"{folder}/{name}")
    for name, df in (csv or {}).items():  # a row a model, or a row a grid cell and action
        df.coalesce(1).write.mode("errorifexists").option("header", True).csv(f"{folder}/{name}_csv")
    artifacts.write_text(spark, f"{folder}/metrics.json", artifacts.canonical_json(report))


def _select_policy(pairs: DataFrame, gold: DataFrame, assignments: DataFrame, config: Config) -> tuple[dict[str, float | None], DataFrame]:
    """Thresholds from top candidates outside every duplicate group with an ambiguous member."""
    mixed = assignments.filter("ambiguous_label").select("duplicate_group_id").distinct()
    own = assignments.join(mixed, "duplicate_group_id", "left_anti").select("google_id", "duplicate_group_id")
    top = fusion.with_label(ranking.top_candidates(pairs), gold).join(own, "google_id")
    bearing = gold.select("google_id").distinct().withColumn("_has", F.lit(True))
    rows = top.join(bearing, "google_id", "left").select(F.col("probability").alias("score"), F.col("duplicate_group_id").alias("group_id"), (F.col("label") == 1).alias("correct_match"), F.col("_has").isNull().alias("correct_no_match"))
    diagnostics = cut(
        policy.threshold_diagnostics(
            rows,
            config.threshold_grid_step,
            {"auto_match": config.match_precision_target, "auto_no_match": config.no_match_precision_target},
            {"auto_match": config.min_auto_match_support, "auto_no_match": config.min_auto_no_match_support},
        ),
        "diagnostics",
    )
    return _one(policy.select_thresholds(diagnostics)), diagnostics


def develop(catalog: DataFrame, listings: DataFrame, gold: DataFrame, config: Config, folder: str, encoder: Encoder = hashing_encoder, raw_digests: dict[str, str] | None = None) -> dict[str, Any]:
    """Fits on train, chooses model and thresholds on validation, freezes to folder/artifacts and reports to folder/report."""
    catalog, listings, gold = cut(catalog, "catalog"), cut(listings, "listings"), cut(gold, "gold")
    assignments = cut(splits.entity_splits(listings, gold, config.split_seed, config.split_ratios), "assignments")
    splits.validate(assignments, listings.select("product_id"))
    train, validation = (cut(splits.pick(listings, assignments, s), s) for s in ("train", "validation"))
    vocabulary = cut(fit_vocabulary(catalog, train, config), "vocabulary")
    vectors = cut(_vectors(catalog, "amazon_id", encoder), "catalog_vectors")
    fitted, _ = retrieve(train, catalog, vocabulary, vectors, encoder, config, gold, inject=True)
    began = time.perf_counter()
    candidates, pool = retrieve(validation, catalog, vocabulary, vectors, encoder, config)
    seconds = time.perf_counter() - began
    ambiguous = assignments.filter("ambiguous_label").select("google_id")
    rows = fusion.with_label(pair_features(fitted, train, catalog), gold).join(ambiguous, "google_id", "left_anti").join(assignments.select("google_id", F.col("component_id").alias("group_id")), "google_id")
    rows = cut(rows.select("group_id", "label", *HYBRID, *RANK), "training")
    clear = cut(pair_features(candidates, validation, catalog).join(ambiguous, "google_id", "left_anti"), "validation_features")
    own_gold = gold.join(validation.select(F.col("product_id").alias("google_id")), "google_id", "left_semi").join(ambiguous, "google_id", "left_anti")
    own_ids = validation.select(F.col("product_id").alias("google_id")).join(ambiguous, "google_id", "left_anti")
    models, table = {}, []
    for name, columns in VARIANTS.items():
        models[name] = matcher.fit(rows, columns, config.calibration_folds, config.model_seed, steps=config.logreg_max_iter)
        scored = matcher.predict(clear, models[name])
        labelled = fusion.with_label(scored, own_gold).withColumn("score", F.col("probability"))
        one = _one(ranking.ranking_metrics(scored, own_gold, listings=own_ids))
        table.append({"model": name, **one, **_one(metrics.average_precision(labelled)), **_one(metrics.roc_auc(labelled)), "feature_count": len(columns)})
    best = matcher.select_model(table)
    pairs = matcher.predict(pair_features(candidates, validation, catalog), models[best])
    thresholds, diagnostics = _select_policy(pairs, gold, assignments, config)
    report, decisions, found = evaluate(candidates, pool, validation, catalog, gold, assignments.select("google_id", "duplicate_group_id"), models[best], thresholds, config, seconds)
    evidence = [r.asDict(recursive=True) for r in policy.selected_evidence(diagnostics, thresholds).collect()]  # two rows
    learned = splits.training_summary(assignments, gold, fusion.with_label(fitted.select("google_id", "amazon_id"), gold).join(ambiguous, "google_id", "left_anti"))
    report |= {"models": table, "selected_model": best, "policy": thresholds | {"evidence": evidence}, "splits": [r.asDict() for r in learned.collect()]}
    tables = {"catalog": catalog, "vocabulary": vocabulary, "catalog_vectors": vectors, "assignments": assignments}
    artifacts.freeze(f"{folder}/artifacts", tables, models[best], best, thresholds | {"evidence": evidence}, config, {"raw_csv_sha256": raw_digests, "encoder": identity(encoder)})
    write_report(f"{folder}/report", report, {"listing_predictions": decisions, "error_examples": found, "threshold_diagnostics": diagnostics, "pr_curve": metrics.pr_curve(fusion.with_label(pairs, gold).withColumn("score", F.col("probability")))}, {"model_comparison": catalog.sparkSession.createDataFrame([{k: float(v) if isinstance(v, (int, float)) else v for k, v in r.items()} for r in table]), "threshold_diagnostics": diagnostics})
    return report


def corrected_evaluation(listings: DataFrame, gold: DataFrame, config: Config, folder: str, output: str, encoder: Encoder = hashing_encoder, raw_digests: dict[str, str] | None = None) -> dict[str, Any]:
    """Scores the test split from a frozen run, without fitting anything, into a new folder."""
    spark = listings.sparkSession
    tables, model, run = artifacts.load(spark, f"{folder}/artifacts")
    artifacts.preflight(tables, model, run, config, VARIANTS[run["model"]], raw_digests, identity(encoder))
    again = splits.entity_splits(listings, gold, config.split_seed, config.split_ratios)
    if not splits.same_rows(splits.canonical(again), splits.canonical(tables["assignments"])):
        raise ValueError("the splits of these listings differ from the frozen ones")
    test = cut(splits.pick(listings, tables["assignments"], "test"), "test")
    began = time.perf_counter()
    candidates, pool = retrieve(test, tables["catalog"], tables["vocabulary"], tables["catalog_vectors"], encoder, config)
    report, decisions, found = evaluate(candidates, pool, test, tables["catalog"], gold, tables["assignments"].select("google_id", "duplicate_group_id"), model, run["policy"], config, time.perf_counter() - began)
    write_report(output, report, {"listing_predictions": decisions, "error_examples": found})
    return report


def score_listings(listings: DataFrame, folder: str, encoder: Encoder = hashing_encoder) -> DataFrame:
    """Candidates of new listings with probability and action of the top one, best first: the interactive table."""
    spark = listings.sparkSession
    tables, model, run = artifacts.load(spark, f"{folder}/artifacts")
    config = artifacts.load_config(run)
    candidates, _ = retrieve(listings, tables["catalog"], tables["vocabulary"], tables["catalog_vectors"], encoder, config)
    pairs = ranking.ranked(matcher.predict(pair_features(candidates, listings, tables["catalog"]), model))
    action = F.when(F.col("model_rank") == 1, policy_action(F.col("probability"), run["policy"]["no_match_threshold"], run["policy"]["match_threshold"]))
    shown = pairs.select("google_id", "amazon_id", "probability", "model_rank", "retrieval_sources", "lexical_similarity", "dense_similarity", action.alias("action"))
    names = tables["catalog"].select(F.col("product_id").alias("amazon_id"), "title", "manufacturer", "price")
    return shown.join(names, "amazon_id", "left").orderBy("google_id", F.desc("probability"), "amazon_id")
