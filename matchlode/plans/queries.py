"""Registered queries over the driver's tables. Their SQL twins are in oracles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats, text
from ..functions.fuzzy import indel_similarity, token_set_similarity
from ..operators import duplicates, errors, features, fusion, matcher, metrics, policy, ranking, search, splits
from ..sources import raw, tables
from ..sources.config import Config
from ..storage import cut, new_folder
from . import pipeline
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]
DIGITS, K, TOP, SCORE = 6, 20, 10, "rrf_score"
NO_MATCH, MATCH = 0.2, 0.8
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles with DIGITS digits: summation order differs between engines and runs."""
    names = columns or [n for n, k in df.dtypes if k == "double"]
    return reduce(lambda d, c: d.withColumn(c, F.round(c, DIGITS)), names, df)


# --- text and prices ---


@query
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "documents").select("doc_id", text.clean_text(F.col("text")).alias("clean"))


@query
def title_signature(spark, sf):
    return tables.listings(spark, sf).select("product_id", text.title_signature(F.col("title")).alias("signature"))


@query
def model_tokens(spark, sf):
    return tables.table(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(text.model_tokens(F.col("text"))), " ").alias("models"))


def _gold_texts(spark, sf):
    left = tables.listings(spark, sf).select(F.col("product_id").alias("google_id"), F.col("description").alias("left"))
    right = tables.catalog(spark, sf).select(F.col("product_id").alias("amazon_id"), F.col("description").alias("right"))
    return tables.gold(spark, sf).join(left, "google_id").join(right, "amazon_id")


@query
def token_jaccard(spark, sf):
    return rounded(_gold_texts(spark, sf).select("google_id", "amazon_id", text.jaccard(text.tokens(F.col("left")), text.tokens(F.col("right"))).alias("jaccard")))


@query
def numeric_token_conflict(spark, sf):
    conflict = text.sets_conflict(text.model_tokens(F.col("left")), text.model_tokens(F.concat_ws(" ", "right", "amazon_id")))
    return _gold_texts(spark, sf).select("google_id", "amazon_id", conflict.cast("int").alias("conflict"))


@query
def relative_price_difference(spark, sf):
    lines, parts = tables.table(spark, sf, "lineitem"), tables.table(spark, sf, "part")
    joined = lines.join(parts.select(F.col("p_partkey").alias("l_partkey"), "p_retailprice"), "l_partkey")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return rounded(joined.select("l_orderkey", "l_linenumber", text.relative_difference(unit, F.col("p_retailprice")).alias("difference")))


@query
def price_parse(spark, sf):
    o = tables.table(spark, sf, "orders")
    amount = F.format_number("o_totalprice", 2)
    raw = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("$"), amount)).when(F.col("o_orderstatus") == "O", F.concat(F.lit(" USD "), amount)).otherwise(F.concat(F.lit("GBP "), amount))
    return o.select("o_orderkey", text.parse_price(raw).alias("price"))


# --- duplicates, components, splits ---


@query
def gold_containment(spark, sf):
    return tables.gold(spark, sf)


def _partial_gold(spark, sf):
    """Gold without the last mapped listing of each duplicate group, so that some groups are mixed."""
    g = cut(tables.gold(spark, sf), "gold")
    own = duplicates.signatures(tables.listings(spark, sf)).join(g.select("google_id").distinct(), "google_id")
    last = own.groupBy("duplicate_group_id").agg(F.max(F.col("google_id").cast("long")).cast("string").alias("google_id"))
    return cut(g.join(last, "google_id", "left_anti"), "partial_gold")


def _groups(spark, sf):
    """Duplicate groups and the gold they were made with."""
    gold = _partial_gold(spark, sf)
    return cut(duplicates.duplicate_groups(tables.listings(spark, sf), gold), "groups"), gold


@query
def exact_duplicate_groups(spark, sf):
    own = duplicates.signatures(tables.listings(spark, sf))
    sizes = own.groupBy("duplicate_group_id").agg(F.count(F.lit(1)).alias("duplicate_group_size"))
    return own.join(sizes, "duplicate_group_id").select("google_id", "duplicate_group_id", "duplicate_group_size")


@query
def duplicate_summary(spark, sf):
    own, _ = _groups(spark, sf)
    many = F.col("duplicate_group_size") > 1
    sizes = own.groupBy("duplicate_group_id").agg(F.count(F.lit(1)).alias("duplicate_group_size"), F.count_if("ambiguous_label").alias("ambiguous"))
    return sizes.agg(
        F.count(F.lit(1)).alias("groups"), F.count_if(many).alias("groups_of_many"), F.sum(F.when(many, F.col("duplicate_group_size")).otherwise(0)).alias("rows_in_them"), F.sum("ambiguous").alias("ambiguous_rows")
    )


@query
def ambiguous_members(spark, sf):
    return _groups(spark, sf)[0].filter("ambiguous_label").select("google_id", "duplicate_group_id")


@query
def connected_components(spark, sf):
    return duplicates.entity_components(*_groups(spark, sf))


@query
def component_labels(spark, sf):
    return duplicates.component_labels(duplicates.entity_components(*_groups(spark, sf))).select("google_id", "component_id")


@query
def split_counts(spark, sf):
    return splits.rows_by_split(splits.entity_splits(tables.listings(spark, sf), _partial_gold(spark, sf)))


@query
def split_isolation_check(spark, sf):
    """Violations in a split by id alone, which tears groups and components apart, and in one by component, which does not."""
    groups, gold = _groups(spark, sf)
    made = cut(duplicates.component_labels(duplicates.entity_components(groups, gold)).join(groups, "google_id"), "components")
    by = {"id": F.col("google_id").cast("long"), "component": F.substring("component_id", 11, 20).cast("long")}
    found = [splits.isolation_violations(made.withColumn("split", F.element_at(F.array(*map(F.lit, splits.SPLITS)), (c % 3 + 1).cast("int")))).withColumn("rule", F.lit(r)) for r, c in by.items()]
    return reduce(DataFrame.unionByName, found).select("rule", "kind", "key", "splits")


def _assigned(spark, sf):
    """Components dealt out by number: whole, and the same in any engine."""
    groups, gold = _groups(spark, sf)
    made = duplicates.component_labels(duplicates.entity_components(groups, gold)).join(groups, "google_id")
    number = F.substring("component_id", 11, 20).cast("long")
    return cut(made.withColumn("split", F.element_at(F.array(*map(F.lit, splits.SPLITS)), (number % 3 + 1).cast("int"))), "assigned"), gold


@query
def assignment_digest(spark, sf):
    return splits.digest(_assigned(spark, sf)[0])


@query
def assignment_csv(spark, sf):
    return splits.csv_lines(_assigned(spark, sf)[0]).orderBy("google_id")


@query
def assigned_split_counts(spark, sf):
    return splits.rows_by_split(_assigned(spark, sf)[0])


@query
def split_listings(spark, sf):
    """The listings of each split, as a run takes them."""
    made, _ = _assigned(spark, sf)
    own = tables.listings(spark, sf)
    return reduce(DataFrame.unionByName, (splits.pick(own, made, s).select("product_id", F.lit(s).alias("split")) for s in splits.SPLITS))


@query
def training_summary(spark, sf):
    """Learned from: the pairs of train listings without an ambiguous label, each with its gold items and the first item."""
    made, gold = _assigned(spark, sf)
    first = tables.catalog(spark, sf).agg(F.min("product_id").alias("amazon_id"))
    own = made.filter("split = 'train' AND NOT ambiguous_label").select("google_id")
    pairs = own.crossJoin(F.broadcast(first)).unionByName(gold.join(own, "google_id", "left_semi").select("google_id", "amazon_id")).distinct()  # one row
    return splits.training_summary(made, gold, fusion.with_label(pairs, gold))


# --- lexical index and search ---


@query
def char_ngram_df(spark, sf):
    counts = search.gram_counts(tables.table(spark, sf, "benchmark"), "item_id", "text")
    return search.fit_vocabulary(counts, 1, max_features=None).select("gram", "df")


@query
def tfidf_postings(spark, sf):
    items = tables.table(spark, sf, "benchmark")
    counts = search.gram_counts(items, "item_id", "text")
    return rounded(search.postings(counts, search.fit_vocabulary(counts, items.count()), "item_id"))


@query
def lexical_topk(spark, sf):
    left = tables.listings(spark, sf).select(F.col("product_id").alias("google_id"), text.combined(F.col("title"), F.col("manufacturer"), F.col("description")).alias("text"))
    right = tables.catalog(spark, sf).select(F.col("product_id").alias("amazon_id"), "ordinal", text.combined(F.col("title"), F.col("manufacturer"), F.col("description")).alias("text"))
    return search.lexical_top_k(left, right, 5).select("google_id", "amazon_id", "score", "rank")


@query
def lexical_topk_postings(spark, sf):
    """lexical_topk for a vocabulary too large to be sent to the tasks, over the two shops."""
    left, right = pipeline._texts(tables.shop_listings(spark, sf), "google_id"), pipeline._texts(tables.shop_catalog(spark, sf), "amazon_id")
    return search.lexical_top_k(left, right, 3, bound=0).select("google_id", "amazon_id", "score", "rank")


LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def letter_encoder(texts: DataFrame) -> DataFrame:
    """key, embedding: how often each letter and digit occurs. An encoder that any engine can follow."""
    t = F.lower("text")
    return texts.select("key", F.array(*((F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))).cast("float") for c in LETTERS)).alias("embedding"))


@query
def hybrid_retrieval(spark, sf):
    """Both channels over the same texts of the two shops, fused: what a run retrieves."""
    own, listings, settings = cut(tables.shop_catalog(spark, sf), "catalog"), cut(tables.shop_listings(spark, sf), "listings"), Config(top_k=TOP)
    vocabulary = cut(pipeline.fit_vocabulary(own, listings, settings), "vocabulary")
    vectors = cut(pipeline._vectors(own, "amazon_id", letter_encoder), "catalog_vectors")
    found, _ = pipeline.retrieve(listings, own, vocabulary, vectors, letter_encoder, settings)
    return rounded(found).select("google_id", "amazon_id", "lexical_score", "dense_score", "lexical_rank", "dense_rank", "rrf_score", "rrf_rank", "retrieval_sources")


@query
def dense_topk(spark, sf):
    q, c = tables.queries_and_vectors(spark, sf)
    return search.dense_top_k(q, c, K).select("google_id", "amazon_id", "score", "rank")


def _lists(spark, sf):
    """Two rankings of one catalog: by the first half of each vector, and by all of it."""
    q, c = tables.queries_and_vectors(spark, sf)
    half = F.slice("embedding", 1, 32)
    return search.dense_top_k(q.withColumn("embedding", half), c.withColumn("embedding", half), K), search.dense_top_k(q, c, K)


def _pool(spark, sf):
    return fusion.union_pool(*_lists(spark, sf))


@query
def union_pool(spark, sf):
    return rounded(_pool(spark, sf)).select("google_id", "amazon_id", "lexical_rank", "dense_rank", "rrf_score", "rrf_rank", "retrieval_sources")


@query
def rrf_fusion(spark, sf):
    return rounded(fusion.fused(_pool(spark, sf), TOP)).select("google_id", "amazon_id", "rrf_score", "rrf_rank", "retrieval_sources")


@query
def gold_injection(spark, sf):
    return rounded(fusion.inject_gold(_pool(spark, sf), tables.vector_gold(spark, sf), TOP)).select("google_id", "amazon_id", "lexical_rank", "dense_rank", "rrf_score", "rrf_rank", "retrieval_sources", "gold_injected")


@query
def label_pairs(spark, sf):
    return fusion.with_label(_pool(spark, sf), tables.vector_gold(spark, sf)).select("google_id", "amazon_id", "label")


@query
def recall_at_k(spark, sf):
    return rounded(metrics.recall_at_k(_pool(spark, sf), tables.vector_gold(spark, sf), (5, 10, 20), K))


@query
def candidate_counts(spark, sf):
    return rounded(metrics.candidate_counts(_pool(spark, sf), tables.queries_and_vectors(spark, sf)[0]))


# --- features ---


@query
def rank_features(spark, sf):
    both = (F.col("lexical_rank").isNotNull() & F.col("dense_rank").isNotNull()).cast("double")
    return rounded(_pool(spark, sf).select("google_id", "amazon_id", both.alias("source_agreement"), stats.reciprocal_rank(F.col("lexical_rank")).alias("lexical_reciprocal"), stats.reciprocal_rank(F.col("dense_rank")).alias("dense_reciprocal")))


@query
def pair_features(spark, sf):
    """All features of two shops' products, with makers, prices, scores and ranks that may be missing."""
    made = features.pair_features(tables.shop_pairs(spark, sf), tables.shop_listings(spark, sf), tables.shop_catalog(spark, sf))
    return rounded(made.select("google_id", "amazon_id", "step", *features.HYBRID, *features.RANK))


@query
def duplicate_signatures(spark, sf):
    """Group ids of products with prices: the exact number is part of the signature."""
    return duplicates.signatures(tables.shop_listings(spark, sf)).select("google_id", "duplicate_group_id")


@query
def raw_files(spark, sf):
    """The shop's catalog written as a raw file with odd headers, quotes, markers and missing-value words, and read again."""
    own = tables.shop_catalog(spark, sf)
    price = F.format_string("%.2f", "price")
    marked = F.when(F.col("ordinal") % 3 == 0, F.concat(F.lit("$"), price)).when(F.col("ordinal") % 3 == 1, F.concat(F.lit("USD "), price)).otherwise(F.concat(F.lit("gbp "), price))
    rows = own.select(
        F.concat(F.lit(" "), "product_id", F.lit(" ")).alias("ID"), F.concat(F.lit('"'), "title", F.lit('",\n x')).alias("Title "), F.when(F.col("manufacturer") == "", "N/A").otherwise(F.col("manufacturer")).alias("Manu-facturer"),
        F.col("description").alias("description"), F.when(F.col("price").isNull(), "NaN").otherwise(marked).alias("PRICE"),
    )
    path = new_folder(spark, "raw")
    rows.coalesce(1).write.option("header", True).option("escape", '"').option("quoteAll", True).option("encoding", "ISO-8859-1").csv(path)
    return raw.products(raw.read_csv(spark, path), "amazon").select("product_id", "title", "manufacturer", "description", "price", "source")


def _part_names(spark, sf):
    p = tables.table(spark, sf, "part")
    return p.select("p_name", F.lower("p_type").alias("kind")).distinct()


@query
def manufacturer_fuzzy(spark, sf):
    return rounded(_part_names(spark, sf).select("p_name", "kind", indel_similarity(F.col("p_name"), F.col("kind")).alias("similarity")))


@query
def title_fuzzy(spark, sf):
    """Part names against their kind and last word: sets that share one word or more."""
    pairs = _part_names(spark, sf).select("p_name", F.concat_ws(" ", "kind", F.split_part("p_name", F.lit(" "), F.lit(-1))).alias("other"))
    return rounded(pairs.select("p_name", "other", token_set_similarity(F.col("p_name"), F.col("other")).alias("similarity")))


# --- ranking ---


@query
def top_candidate(spark, sf):
    return rounded(ranking.top_candidates(_pool(spark, sf), SCORE).select("google_id", "amazon_id", SCORE))


@query
def top_margin(spark, sf):
    return rounded(ranking.top_margins(_pool(spark, sf), SCORE).select("google_id", "amazon_id", "top1_top2_margin"))


def _incomplete(spark, sf):
    """The pool without the candidates of some evaluated listings, gold, and the ids of evaluated listings: all but some."""
    number = F.col("google_id").cast("long")
    ids = tables.queries_and_vectors(spark, sf)[0].select("google_id").filter(number % 500 != 300)
    return _pool(spark, sf).filter(number % 700 != 0), tables.vector_gold(spark, sf), ids


@query
def ranking_metrics(spark, sf):
    own, gold, ids = _incomplete(spark, sf)
    return rounded(ranking.ranking_metrics(own, gold, SCORE, ids))


@query
def score_baselines(spark, sf):
    own, gold, ids = _incomplete(spark, sf)
    return rounded(ranking.score_baselines(own, gold, ("lexical_score", "dense_score", "rrf_score"), ids))


@query
def listing_predictions(spark, sf):
    groups = tables.queries_and_vectors(spark, sf)[0].select("google_id", F.concat(F.lit("g"), "label").alias("duplicate_group_id"))
    made = ranking.listing_predictions(_pool(spark, sf), tables.vector_gold(spark, sf), groups, 0.017, 0.032, SCORE)
    return made.select("google_id", "amazon_id", "duplicate_group_id", "has_gold_listing", "is_gold_pair", "gold_retrieved", "ranking_outcome", "action", "action_correct")


# --- decisions ---


def _decisions(spark, sf):
    own = tables.scored(spark, sf)
    own = own.withColumn("action", stats.policy_action(F.col("score"), NO_MATCH, MATCH))
    own = own.withColumn("ranking_outcome", stats.ranking_outcome(F.col("has_gold_listing"), F.col("gold_retrieved"), F.col("is_gold_pair")))
    return own.withColumn("action_correct", stats.action_correct(F.col("action"), F.col("is_gold_pair"), F.col("has_gold_listing")))


@query
def policy_actions(spark, sf):
    return _decisions(spark, sf).select("doc_id", "score", "action", "action_correct")


@query
def ranking_outcome(spark, sf):
    return _decisions(spark, sf).select("doc_id", "ranking_outcome")


@query
def action_statistics(spark, sf):
    return rounded(policy.action_statistics(_decisions(spark, sf), "group_id"))


@query
def group_evidence(spark, sf):
    rows = _decisions(spark, sf).select("group_id", (F.col("score") <= NO_MATCH).alias("selected"), (~F.col("has_gold_listing")).alias("correct"))
    return rounded(policy.group_evidence(rows))


@query
def wilson_interval(spark, sf):
    by = tables.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("support"), F.count_if(F.col("l_returnflag") == "R").alias("correct"))
    low, high = stats.wilson(F.col("correct"), F.col("support"))
    return rounded(by.select("l_suppkey", "support", "correct", low.alias("low"), high.alias("high")))


@query
def threshold_grid(spark, sf):
    return policy.threshold_grid(spark, 0.03)


def _diagnostics(spark, sf):
    rows = tables.scored(spark, sf).select("score", "group_id", F.col("is_gold_pair").alias("correct_match"), (~F.col("has_gold_listing")).alias("correct_no_match"))
    return policy.threshold_diagnostics(rows, 0.01, {"auto_match": 0.7, "auto_no_match": 0.2}, {"auto_match": 20, "auto_no_match": 20})


@query
def threshold_diagnostics(spark, sf):
    return rounded(_diagnostics(spark, sf))


@query
def threshold_selection(spark, sf):
    return policy.select_thresholds(_diagnostics(spark, sf))


@query
def selected_evidence(spark, sf):
    """What the chosen thresholds rest on, and a disabled action."""
    made = cut(_diagnostics(spark, sf), "diagnostics")
    chosen = policy.select_thresholds(made).first().asDict()
    both = policy.selected_evidence(made, chosen).withColumn("chosen", F.lit(True)).unionByName(policy.selected_evidence(made, {"no_match_threshold": 0.2, "match_threshold": None}).withColumn("chosen", F.lit(False)))
    flat = [F.col(f"{v}.{k}").alias(f"{v}_{k}") for v in ("group_evidence", "listing_operation") for k in policy.EVIDENCE]
    return rounded(both.select("chosen", "action", "feasible", "enabled", "threshold", *flat))


@query
def listing_policy_report(spark, sf):
    return rounded(policy.listing_report(_decisions(spark, sf)))


@query
def no_match_detection(spark, sf):
    return rounded(metrics.no_match_detection(_decisions(spark, sf)))


def _collisions(spark, sf):
    """Documents without gold whose first line opens a benchmark item too."""
    left = tables.listings(spark, sf).select(F.col("product_id").alias("google_id"), "title")
    right = tables.listings(spark, sf).select(F.col("product_id").alias("amazon_id"), "title").join(tables.gold(spark, sf).select(F.col("google_id").alias("amazon_id")), "amazon_id", "left_semi")
    return errors.title_collisions(left, right, tables.gold(spark, sf))


@query
def title_collision(spark, sf):
    return _collisions(spark, sf).select("google_id", "signature")


@query
def sensitivity_report(spark, sf):
    left = _decisions(spark, sf).join(_collisions(spark, sf).select(F.col("google_id").cast("long").alias("doc_id")), "doc_id", "left_anti")
    return rounded(policy.listing_report(left))


@query
def error_examples(spark, sf):
    return errors.listing_errors(_decisions(spark, sf), 10, "doc_id").select("error_type", "doc_id", "action", "ranking_outcome")


@query
def pair_error_examples(spark, sf):
    return errors.pair_errors(tables.scored(spark, sf).withColumn("ordinal", F.col("doc_id")), 10).select("error_type", "doc_id", "score")


# --- score metrics ---


@query
def average_precision(spark, sf):
    return rounded(metrics.average_precision(tables.scored(spark, sf)))


@query
def roc_auc(spark, sf):
    return rounded(metrics.roc_auc(tables.scored(spark, sf)))


@query
def brier(spark, sf):
    return rounded(metrics.brier(tables.scored(spark, sf)))


@query
def pr_curve(spark, sf):
    return rounded(metrics.pr_curve(tables.scored(spark, sf)))


@query
def reliability_bins(spark, sf):
    return rounded(metrics.reliability_bins(tables.scored(spark, sf)))


@query
def pair_metrics(spark, sf):
    return rounded(metrics.pair_metrics(tables.scored(spark, sf)))


@query
def latency_summary(spark, sf):
    return rounded(metrics.latency_summary(tables.table(spark, sf, "events").select(F.col("value").alias("ms"))))


# --- matcher ---


def _training(spark, sf):
    y, d = tables.table(spark, sf, "labels"), tables.table(spark, sf, "documents")
    n = F.col("n_chars").cast("double")
    words = F.size(F.split("text", " ")).cast("double")
    features = d.select(  # numbers meet the labels, not texts
        "doc_id", F.md5(text.normalized(F.col("text"))).alias("group_id"),
        (F.log1p(n) / 10).alias("log_chars"), (n / words / 10).alias("word_length"), (F.regexp_count("text", F.lit("[^A-Za-z \n.,]")) / F.greatest(n, F.lit(1.0))).alias("odd_share"), (F.col("lang") == "en").cast("double").alias("english"),
    )
    return features.join(y.select("doc_id", F.col("quality").alias("label")), "doc_id").select("doc_id", "group_id", "label", *FEATURES)


FEATURES = ("log_chars", "word_length", "odd_share", "english")


@query
def logistic_scores(spark, sf):
    rows = cut(_training(spark, sf), "training")  # texts are read once, whatever passes follow
    return rounded(matcher.predict(rows, matcher.fit(rows, FEATURES)).select("doc_id", "label", "probability"))


@query
def model_selection(spark, sf):
    """Models that rank each eight neighbouring documents, of which those of quality are gold."""
    rows = cut(_training(spark, sf).withColumn("google_id", F.concat(F.lit("q"), F.floor(F.col("doc_id") / 8))).withColumn("amazon_id", F.col("doc_id").cast("string")), "training")
    gold = rows.filter("label = 1").select("google_id", "amazon_id")
    out = []
    for name, own in (("lengths", FEATURES[:2]), ("language", FEATURES[3:]), ("all", FEATURES)):
        scores = cut(matcher.predict(rows, matcher.fit(rows, own), "score").select("google_id", "amazon_id", "score", "label"), "scores")
        ranks = ranking.ranking_metrics(scores, gold, "score").first()
        out.append({"model": name, "overall_hit_at_1": ranks.overall_hit_at_1, "mrr": ranks.mrr, "pr_auc": metrics.average_precision(scores).first()[0], "roc_auc": metrics.roc_auc(scores).first()[0], "feature_count": len(own)})
    best = matcher.select_model(out)
    schema = "model string, overall_hit_at_1 double, mrr double, pr_auc double, roc_auc double, feature_count int, selected boolean"
    return rounded(spark.createDataFrame([(*o.values(), o["model"] == best) for o in out], schema))
