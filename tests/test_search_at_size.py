"""Searches keep to bounded memory and look at few of the pairs."""

import os
from urllib.parse import urlparse

import numpy as np
import pytest

from matchlode.operators import search
from matchlode.storage import shared_dir


def _written(spark) -> int:
    return sum(os.path.getsize(os.path.join(d, n)) for d, _, names in os.walk(urlparse(shared_dir(spark)).path) for n in names)


def test_long_queries_are_not_written_as_vectors(spark):
    """vectors of documents are larger than their texts; they exist a slice at a time."""
    rng = np.random.default_rng(1)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 7)) for _ in range(n))
    catalog = spark.createDataFrame([(f"c{i}", i, text(5)) for i in range(5)], "amazon_id string, ordinal long, text string")
    queries = spark.createDataFrame([(f"q{i}", text(400)) for i in range(60)], "google_id string, text string")
    before = _written(spark)
    assert search.lexical_top_k(queries, catalog, 2).count() == 120
    assert _written(spark) - before < 1 << 20  # the vocabulary and five items


def _vectors(rng, n, words, grams):
    """Items of a few common words, whose grams go together, and one word of their own."""
    out = []
    for i in range(n):
        own = {g: 1.0 + w % 3 for w in rng.choice(words, 3, replace=False) for g in range(w * 10, w * 10 + 10)}
        own |= {words * 10 + int(g): 4.0 for g in rng.choice(grams, 8, replace=False)}
        at = np.array(sorted(own), np.int64)
        x = np.array([own[g] for g in at])
        out.append((at, x / np.sqrt((x * x).sum())))
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_postings_search_is_exact_and_looks_at_few(seed, monkeypatch):
    """the k best of a query without a product for each posting of its grams."""
    monkeypatch.setattr(search, "SMALL", -1 << 40)
    rng, k = np.random.default_rng(seed), 5
    items, asked = _vectors(rng, 6000, 30, 3000), _vectors(rng, 40, 30, 3000)
    arrays = search._Postings.arrays(*map(list, zip(*items))) | {"ordinal": rng.permutation(len(items))}
    shard = search._Postings(arrays, k, 6)
    assert len(shard.item) < 0.4 * sum(len(a) for a, _ in items)  # a word's grams share a list
    full = np.zeros((len(items), 30 * 10 + 3000))
    for i, (at, w) in enumerate(items):
        full[i, at] = w
    for at, w in asked:
        s = np.round(full[:, at] @ w, 6)
        want = np.lexsort((arrays["ordinal"], -s))[:k]
        for least in (-np.inf, s[want[-1]]):
            found, score = shard.search(at, w, least)
            best = np.lexsort((arrays["ordinal"][found], -score))[:k]
            assert found[best].tolist() == want.tolist() and score[best] == pytest.approx(s[want], abs=2e-6)
        assert not len(shard.search(at, w, 1.1)[0])
    looked = []
    summed = shard._summed
    shard._summed = lambda g, w: looked.append(int((shard.first[g + 1] - shard.first[g]).sum())) or summed(g, w)
    for at, w in asked:
        shard.search(at, w, 0.7)
    assert sum(looked) < 0.2 * sum(sum(int((full[:, g] > 0).sum()) for g in at) for at, _ in asked)


def test_dense_search_makes_no_pairs_of_blocks(spark):
    """tasks map the catalog; Spark gives them no product of blocks to hold."""
    rng = np.random.default_rng(3)
    q, c = rng.normal(size=(9, 6)), rng.normal(size=(500, 6))
    c[10:20] = c[10]  # ties go by ordinal
    qs = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(q)], "google_id string, embedding array<double>")
    cs = spark.createDataFrame([(f"c{i}", 499 - i, v.tolist()) for i, v in enumerate(c)], "amazon_id string, ordinal long, embedding array<double>")
    found = search.dense_top_k(qs, cs, 12, block=2000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(unit(q) @ unit(c).T, 6)
    got = {(r.google_id, r["rank"]): r.amazon_id for r in found.collect()}
    assert got == {(f"q{i}", n + 1): f"c{j}" for i in range(9) for n, j in enumerate(np.lexsort((499 - np.arange(500), -s[i]))[:12])}
