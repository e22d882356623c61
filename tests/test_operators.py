"""Operators on small tables with known results."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlode.operators import duplicates, errors, fusion, matcher, metrics, policy, ranking, search, splits
from matchlode.operators.components import connected_components
from matchlode.operators.containment import contained
from matchlode.operators.features import HYBRID, RANK, pair_features

PRODUCT = "product_id string, title string, manufacturer string, description string, price double, ordinal long"


def listings(spark, n=20):
    rows = [(f"g{i}", f"Title {i}", "maker", f"text {i}", 1.0 + i, i) for i in range(n)]
    return spark.createDataFrame(rows, PRODUCT)


def pairs(spark, rows):
    return spark.createDataFrame(rows, "google_id string, amazon_id string")


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got[i] for i in range(41)) == {0} and set(got[i] for i in range(100, 130)) == {100}


def test_duplicates_and_ambiguity(spark):
    rows = [("a", "Same  Title", "M", "d", None, 0), ("b", "same title", "m ", "D", None, 1), ("c", "other", "M", "d", None, 2), ("a", "later row", "M", "d", None, 3)]
    got = {r.google_id: r for r in duplicates.duplicate_groups(spark.createDataFrame(rows, PRODUCT), pairs(spark, [("a", "x")])).collect()}
    assert got["a"].duplicate_group_id == got["b"].duplicate_group_id != got["c"].duplicate_group_id
    assert (got["a"].duplicate_group_size, got["a"].ambiguous_label, got["b"].ambiguous_label, got["c"].ambiguous_label) == (2, False, True, False)


def test_components_never_cross_splits(spark):
    gold = pairs(spark, [("g0", "a"), ("g1", "a"), ("g2", "a"), ("g3", "b"), ("g4", "b"), ("unknown", "b")])
    made = splits.entity_splits(listings(spark), gold, 7)
    splits.validate(made, listings(spark).select("product_id"))
    by = {r.google_id: r for r in made.collect()}
    assert len({by[f"g{i}"].component_id for i in range(3)}) == 1 and by["g3"].component_id == by["g4"].component_id
    assert sorted({r.component_id for r in by.values()})[0] == "component_00000"
    assert splits.same_rows(made, splits.entity_splits(listings(spark).repartition(5), gold, 7))


def test_swapped_rows_are_another_assignment(spark):
    made = splits.entity_splits(listings(spark, 24), pairs(spark, []), 3, (0.5, 0.25, 0.25))
    counts = {r.split: r.n for r in splits.rows_by_split(made).collect()}
    assert counts == {"train": 12, "validation": 6, "test": 6}
    v, t = (made.filter(F.col("split") == s).first().google_id for s in ("validation", "test"))
    swapped = made.withColumn("split", F.when(F.col("google_id") == v, "test").when(F.col("google_id") == t, "validation").otherwise(F.col("split")))
    assert {r.split: r.n for r in splits.rows_by_split(swapped).collect()} == counts and not splits.same_rows(made, swapped)
    assert splits.digest(made).first() != splits.digest(swapped).first() and splits.digest(made).first() == splits.digest(made.repartition(3)).first()


def test_target_counts():
    assert splits.target_counts(10, (0.7, 0.15, 0.15)) == [7, 2, 1]
    for bad in ((0.5, 0.5), (1.2, -0.1, -0.1), (0.5, 0.2, 0.2)):
        with pytest.raises(ValueError):
            splits.check_ratios(bad)


def test_bad_assignments_are_refused(spark):
    made = splits.entity_splits(listings(spark, 4), pairs(spark, []))
    ids = listings(spark, 4).select("product_id")
    with pytest.raises(ValueError, match="unique"):
        splits.validate_ids(made.union(made), ids)
    with pytest.raises(ValueError, match="missing=1, extra=1"):
        splits.validate_ids(made.withColumn("google_id", F.when(F.col("google_id") == "g0", "zz").otherwise(F.col("google_id"))), ids)
    with pytest.raises(Exception, match="unknown split"):
        splits.canonical(made.withColumn("split", F.lit("dev"))).collect()
    with pytest.raises(ValueError, match="lack"):
        splits.canonical(made.drop("split"))


def test_char_grams_follow_word_bounds(spark):
    got = spark.range(1).select(search.char_grams(F.lit("Ab  c abcd")).alias("g")).first().g
    want = [" ab", "ab ", " ab ", " c ", " ab", "abc", "bcd", "cd ", " abc", "abcd", "bcd ", " abcd", "abcd "]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize(("bound", "block"), [(1 << 26, 1 << 20), (0, 1 << 20), (1 << 26, 1)])
def test_exact_search_fills_up_with_zero_scores(spark, bound, block):
    catalog = spark.createDataFrame([("a", 0, "red chair"), ("b", 1, "blue table"), ("c", 2, "red table")], "amazon_id string, ordinal long, text string")
    queries = spark.createDataFrame([("q", "red table"), ("r", "zzzz"), ("s", "")], "google_id string, text string")
    got = {(r.google_id, r["rank"]): r.amazon_id for r in search.lexical_top_k(queries, catalog, 2, bound=bound, block=block).collect()}
    assert got[("q", 1)] == "c" and got[("r", 1)] == got[("s", 1)] == "a" and got[("r", 2)] == got[("s", 2)] == "b"
    with pytest.raises(ValueError):
        search.top_k(catalog, "amazon_id", "ordinal", 0)


def test_lexical_search_matches_brute_force(spark):
    rng, words = np.random.default_rng(4), ["red", "blue", "chair", "table", "lamp", "oak", "x200"]
    text = lambda: " ".join(rng.choice(words, rng.integers(1, 6)))
    queries = spark.createDataFrame([(f"q{i}", text()) for i in range(30)], "google_id string, text string").repartition(3)
    catalog = spark.createDataFrame([(f"c{i}", i, text()) for i in range(50)], "amazon_id string, ordinal long, text string").repartition(4)
    grams = lambda t: [g for w in t.split(" ") for g in search.word_grams(w, 3, 5)]
    texts = [r.text for r in queries.select("text").union(catalog.select("text")).collect()]
    df = Counter(g for t in texts for g in set(grams(t)))
    idf = {g: np.log((1 + len(texts)) / (1 + n)) + 1 for g, n in df.items()}

    def vector(t):
        v = {g: (1 + np.log(n)) * idf[g] for g, n in Counter(grams(t)).items()}
        length = np.sqrt(sum(x * x for x in v.values()))
        return {g: x / length for g, x in v.items()}

    items = [(r.amazon_id, r.ordinal, vector(r.text)) for r in catalog.collect()]
    want = {}
    for r in queries.collect():
        own = vector(r.text)
        scores = sorted((-round(sum(x * v.get(g, 0) for g, x in own.items()), 6), o, key) for key, o, v in items)
        want |= {(r.google_id, i + 1): (key, -s) for i, (s, _, key) in enumerate(scores[:6])}
    for bound, block in ((1 << 26, 1 << 20), (0, 500)):
        found = {(r.google_id, r["rank"]): (r.amazon_id, r.score) for r in search.lexical_top_k(queries, catalog, 6, bound=bound, block=block).collect()}
        assert found.keys() == want.keys() and all(found[k][1] == pytest.approx(want[k][1], abs=2e-6) for k in want)
        assert sum(found[k][0] != want[k][0] for k in want) <= 2  # scores that differ in the last digit alone
    vocabulary = search.vocabulary_of(search.gram_statistics(queries.select("text").union(catalog.select("text"))), len(texts))
    pair = spark.createDataFrame([("q3", "c7"), ("q3", "c7"), ("q4", "c9")], "google_id string, amazon_id string")
    texts = {r.google_id: r.text for r in queries.collect()}
    items = {key: v for key, _, v in items}
    got = {(r.google_id, r.amazon_id): r.score for r in search.pair_scores(pair, queries, catalog, vocabulary).collect()}
    assert got == {(q, c): pytest.approx(sum(x * items[c].get(g, 0) for g, x in vector(texts[q]).items())) for q, c in {("q3", "c7"), ("q4", "c9")}}


def test_dense_search_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    q, c = rng.normal(size=(7, 5)).astype(np.float32), rng.normal(size=(60, 5)).astype(np.float32)
    c[3] = 0
    qs = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(q)], "google_id string, embedding array<float>")
    cs = spark.createDataFrame([(f"c{i}", i, v.tolist()) for i, v in enumerate(c)], "amazon_id string, ordinal long, embedding array<float>").repartition(4)
    got = {(r.google_id, r["rank"]): r.amazon_id for r in search.dense_top_k(qs, cs, 4, block=100).collect()}
    unit = lambda x: x / np.maximum(1e-30, np.linalg.norm(x.astype(float), axis=1, keepdims=True))
    order = np.argsort(-np.round(unit(q) @ unit(c).T, 6), axis=1, kind="stable")
    assert got == {(f"q{i}", k + 1): f"c{order[i, k]}" for i in range(7) for k in range(4)}
    assert search.dense_top_k(qs.filter("false"), cs, 4).count() == 0


def test_injected_gold(spark):
    ranked = "google_id string, amazon_id string, score double, rank int"
    left = spark.createDataFrame([("q", "a", 0.9, 1), ("q", "b", 0.8, 2)], ranked)
    right = spark.createDataFrame([("q", "b", 0.7, 1), ("q", "c", 0.6, 2)], ranked)
    pool = fusion.union_pool(left, right)
    assert [r.amazon_id for r in pool.orderBy("rrf_rank").collect()] == ["b", "a", "c"]
    got = {r.amazon_id: r for r in fusion.inject_gold(pool, pairs(spark, [("q", "c"), ("q", "z"), ("q", "b")]), 1).collect()}
    assert (got["b"].gold_injected, got["c"].gold_injected, got["z"].gold_injected) == (False, True, True)
    assert got["c"].rrf_rank == 3 and got["c"].retrieval_sources == "dense+gold_injected"
    assert got["z"].rrf_rank is None and got["z"].rrf_score == 0 and got["z"].retrieval_sources == "gold_injected"


def test_pair_features(spark):
    left = spark.createDataFrame([("g", "Acme X100 camera", "", None, None, 0)], PRODUCT)
    right = spark.createDataFrame([("a", "Acme X200 camera", "Acme", "", 0.0, 0)], PRODUCT)
    got = pair_features(pairs(spark, [("g", "a")]), left, right).first()
    assert got.numeric_token_conflict == got.query_manufacturer_missing == got.query_description_missing == got.query_price_missing == got.candidate_price_missing == 1.0
    assert got.relative_price_difference == got.candidate_manufacturer_missing == 0.0 and got.title_token_jaccard == 0.5
    assert all(np.isfinite(got[c]) for c in (*HYBRID, *RANK))
    for lost in (("g", "nope"), ("nope", "a")):
        with pytest.raises(Exception, match="no product has: nope"):
            pair_features(pairs(spark, [lost]), left, right).collect()


def test_top_rows_and_outcomes(spark):
    rows = [("g1", "a2", 0.9), ("g1", "a1", 0.9), ("g2", "a9", 0.4), ("g3", "a1", 0.7), ("g3", "a3", 0.6), ("g4", "a1", 0.1)]
    cand = spark.createDataFrame(rows, "google_id string, amazon_id string, probability double")
    gold = pairs(spark, [("g1", "a1"), ("g2", "a5"), ("g3", "a3")])
    groups = spark.createDataFrame([(f"g{i}", f"d{i}") for i in range(1, 5)], "google_id string, duplicate_group_id string")
    got = {r.google_id: r for r in ranking.listing_predictions(cand, gold, groups, 0.2, 0.8).collect()}
    assert got["g1"].amazon_id == "a1" and got["g1"].top1_top2_margin == 0 and got["g2"].top1_top2_margin == 0.4
    assert [got[f"g{i}"].ranking_outcome for i in range(1, 5)] == ["top_gold_match", "retrieval_miss", "reranking_miss", "assumed_no_match"]
    assert [got[f"g{i}"].action for i in range(1, 5)] == ["auto_match", "manual_review", "manual_review", "auto_no_match"]
    assert [got[f"g{i}"].action_correct for i in range(1, 5)] == [True, None, None, True]
    m = ranking.ranking_metrics(cand, gold).first()
    assert (m.gold_listings, m.hits, m.retrieval_misses, m.reranking_misses) == (3, 1, 1, 1) and m.mrr == pytest.approx(0.5)


def policy_rows(spark):
    rows = [(0.02, f"d{i}", False, True) for i in range(4) for _ in range(4)] + [(0.02, "mixed", False, True), (0.02, "mixed", False, False)] + [(0.03, f"s{i}", False, False) for i in range(2)]
    return spark.createDataFrame(rows, "score double, group_id string, correct_match boolean, correct_no_match boolean")


def test_groups_drive_thresholds(spark):
    made = policy.threshold_diagnostics(policy_rows(spark), 0.01, {"auto_match": 0.95, "auto_no_match": 0.8}, {"auto_match": 5, "auto_no_match": 5})
    got = {round(r.threshold, 2): r for r in made.filter("action = 'auto_no_match'").collect()}
    assert (got[0.02].group_correct_count, got[0.02].group_support, got[0.02].listing_correct_count, got[0.02].listing_support) == (4, 5, 17, 18)
    assert (got[0.03].group_correct_count, got[0.03].group_support, got[0.03].listing_correct_count, got[0.03].listing_support) == (4, 7, 17, 20)
    assert got[0.01].group_support == 0 and got[0.01].group_empirical_precision is None and got[0.02].listing_coverage == 0.9
    assert policy.select_thresholds(made).first().asDict() == {"no_match_threshold": 0.02, "match_threshold": None}


def test_manual_review_has_no_correctness(spark):
    rows = [("auto_match", True, True, "g1"), ("auto_match", False, True, "g1"), ("manual_review", True, True, "g2"), ("manual_review", False, False, "g1"), ("auto_match", True, True, "g3")]
    got = {r.action: r for r in policy.action_statistics(spark.createDataFrame(rows, "action string, is_gold_pair boolean, has_gold_listing boolean, duplicate_group_id string")).collect()}
    m, n, r = (got[a] for a in policy.ACTIONS)
    assert (m.listing_support, m.listing_correct_count, m.listing_error_count, m.listing_coverage) == (3, 2, 1, 0.6)
    assert (m.group_support, m.group_correct_count, m.group_empirical_precision) == (2, 1, 0.5)  # g1 has a wrong member
    assert (n.listing_support, n.listing_correct_count, n.listing_empirical_precision, n.group_support, n.group_coverage) == (0, 0, None, 0, 0.0)
    assert (r.listing_support, r.listing_coverage, r.group_support, r.group_coverage) == (2, 0.4, 2, 2 / 3)
    judged = [c for c in r.asDict() if "count" in c or "precision" in c]
    assert len(judged) == 10 and all(r[c] is None for c in judged)


def test_listings_without_candidates_are_misses(spark):
    found = spark.createDataFrame([("g1", "a1", 0.9), ("g3", "a9", 0.8)], "google_id string, amazon_id string, probability double")
    gold, ids = pairs(spark, [("g1", "a1"), ("g2", "a2"), ("g3", "a3")]), spark.createDataFrame([("g1",), ("g2",)], "google_id string")
    r = ranking.ranking_metrics(found, gold, listings=ids).first()
    assert (r.gold_listings, r.retrieved_listings, r.hits, r.overall_hit_at_1, r.conditional_hit_at_1, r.mrr, r.retrieval_misses) == (2, 1, 1, 0.5, 1.0, 0.5, 1)
    b = {r.baseline: r for r in ranking.score_baselines(found.withColumn("other", F.lit(None).cast("double")), gold, ("probability", "other"), ids).collect()}
    assert b["probability"].overall_hit_at_1 == b["other"].mrr == 0.5 and b["other"].conditional_hit_at_1 == 1.0
    with pytest.raises(Exception, match="no duplicate group"):
        ranking.listing_predictions(found, gold, spark.createDataFrame([("g1", "d1")], "google_id string, duplicate_group_id string"), 0.1, 0.9).collect()


def test_listings_need_a_split(spark):
    made = splits.entity_splits(listings(spark, 6), pairs(spark, []))
    assert sum(splits.pick(listings(spark, 6), made, s).count() for s in splits.SPLITS) == 6
    with pytest.raises(Exception, match="no split for listing g5"):
        splits.pick(listings(spark, 6), made.filter("google_id <> 'g5'"), "test").collect()


def test_digest_is_that_of_the_sorted_csv(spark):
    rows = [("b", "component_00000", "Train ", "d,1", 2.0, "1"), ("a", "component_00000", "train", 'd"2', 1.0, "false"), ("é", "component_00001", "test", "d3", 1.0, "True")]
    made = spark.createDataFrame(rows, "google_id string, component_id string, split string, duplicate_group_id string, duplicate_group_size double, ambiguous_label string").repartition(3)
    text = 'google_id,component_id,split,duplicate_group_id,duplicate_group_size,ambiguous_label\na,component_00000,train,"d""2",1,False\nb,component_00000,train,"d,1",2,True\né,component_00001,test,d3,1,True\n'
    assert splits.digest(made).first() == (3, hashlib.sha256(text.encode()).hexdigest())


def test_an_action_needs_support(spark):
    schema = "score double, group_id string, correct_match boolean, correct_no_match boolean"
    for n in (1, 20):
        rows = [(0.99, f"m{i}", True, False) for i in range(n)] + [(0.01, f"n{i}", False, True) for i in range(20)]
        made = policy.threshold_diagnostics(spark.createDataFrame(rows, schema), 0.01, {"auto_match": 0.95, "auto_no_match": 0.95}, {"auto_match": 20, "auto_no_match": 20})
        got = policy.select_thresholds(made).first()
        assert got.no_match_threshold is not None and (got.match_threshold is None) == (n == 1)
    with pytest.raises(ValueError):
        policy.threshold_grid(spark, 0)


def test_unknown_actions_raise(spark):
    df = spark.createDataFrame([("shrug", None, False, False)], "action string, action_correct boolean, is_gold_pair boolean, has_gold_listing boolean")
    with pytest.raises(Exception, match="unknown action"):
        policy.listing_report(df).collect()


def test_score_metrics(spark):
    rng = np.random.default_rng(5)
    s, y = np.round(rng.random(200), 1), rng.integers(0, 2, 200)
    rows = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "score double, label int")
    order = sorted(set(s), reverse=True)
    tp = {t: int(y[s >= t].sum()) for t in order}
    ap = sum((tp[t] - (tp[order[i - 1]] if i else 0)) / y.sum() * tp[t] / (s >= t).sum() for i, t in enumerate(order))
    assert metrics.average_precision(rows).first()[0] == pytest.approx(ap)
    pos, neg = s[y == 1], s[y == 0]
    assert metrics.roc_auc(rows).first()[0] == pytest.approx((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean())
    assert metrics.roc_auc(rows.filter("label = 1")).first()[0] == 0.0 and metrics.average_precision(rows.filter("label = 0")).first()[0] == 0.0
    bins = {r.bin: r.n for r in metrics.reliability_bins(spark.createDataFrame([(0.3, 1), (0.30000000000000004, 1), (0.0, 0), (1.0, 1)], "score double, label int")).collect()}
    assert bins == {2: 1, 3: 1, 0: 1, 9: 1} or bins == {2: 2, 0: 1, 9: 1}
    with pytest.raises(ValueError):
        metrics.pair_metrics(rows, 1.5)


def test_recall_arguments(spark):
    pool = fusion.union_pool(*(spark.createDataFrame([("q", "a", 0.9, 1)], "google_id string, amazon_id string, score double, rank int"),) * 2)
    with pytest.raises(ValueError):
        metrics.recall_at_k(pool, pairs(spark, [("q", "a")]), (2,), 1)
    assert {r.recall for r in metrics.recall_at_k(pool, pairs(spark, [("q", "a"), ("r", "a")]), (1,), 1).collect()} == {0.5}


def test_errors_are_capped(spark):
    df = spark.createDataFrame([(f"g{i:02}", "auto_match", False, False, "assumed_no_match") for i in range(9)], "google_id string, action string, is_gold_pair boolean, has_gold_listing boolean, ranking_outcome string")
    assert [r.google_id for r in errors.listing_errors(df, 3).orderBy("google_id").collect()] == ["g00", "g01", "g02"]
    with pytest.raises(ValueError):
        errors.listing_errors(df, 0)


def test_title_collisions(spark):
    left = spark.createDataFrame([("g1", "Red Chair!"), ("g2", "red-chair"), ("g3", "!!"), ("g4", "none")], "google_id string, title string")
    right = spark.createDataFrame([("a", "RED chair"), ("b", "??")], "amazon_id string, title string")
    assert [r.google_id for r in errors.title_collisions(left, right, pairs(spark, [("g2", "a")])).collect()] == ["g1"]


def test_containment(spark, monkeypatch):
    from matchlode.operators import containment

    monkeypatch.setattr(containment, "PASS_CHARACTERS", 4)
    docs = spark.createDataFrame([("d1", "The Red  chair is here"), ("d2", None), ("d3", "chair")], "d string, text string")
    items = spark.createDataFrame([("p1", "red chair"), ("p2", "chair"), ("p3", " "), ("p4", "CHAIR")], "p string, text string")
    assert sorted(map(tuple, contained(docs, items, "d", "p").collect())) == [("d1", "p1"), ("d1", "p2"), ("d1", "p4"), ("d3", "p2"), ("d3", "p4")]


def test_matcher_matches_a_direct_fit(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 2))
    y = (x @ [1.5, -1] + rng.normal(size=240) > 0).astype(int)
    rows = spark.createDataFrame([(f"g{i // 2}", int(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(240)], "group_id string, label int, u double, v double")
    made = matcher.fit(rows, ("u", "v"))
    folds = {r.group_id: r.fold for r in matcher.group_folds(rows, 3).collect()}
    fold = np.array([folds[f"g{i // 2}"] for i in range(240)])
    for k in range(3):
        a = np.c_[np.ones((fold != k).sum()), x[fold != k]]
        w = np.zeros(3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-a @ w))
            w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.eye(3), a.T @ (p - y[fold != k]) + w)
        assert np.allclose(made.weights[k], w, atol=1e-6)
    got = matcher.predict(rows, matcher.Matcher.from_json(made.to_json())).toPandas()
    assert got.probability.between(0, 1).all() and ((got.probability > 0.5) == (got.label == 1)).mean() > 0.8
    with pytest.raises(ValueError, match="both classes"):
        matcher.group_folds(rows.withColumn("label", F.lit(1)), 3)
    with pytest.raises(ValueError, match="finite"):
        matcher.check_finite(rows.withColumn("u", F.lit(float("nan"))), ("u",))
    with pytest.raises(ValueError, match="missing"):
        matcher.predict(rows.drop("u"), made)
