"""The matcher reads long texts once, and deals groups without a step a group."""

import time

import numpy as np

from matchlode.operators import matcher
from matchlode.plans import queries


def test_folds_are_dealt_by_kinds_of_groups():
    """the same folds as a step a group gives, and a million groups in seconds."""
    rng = np.random.default_rng(0)
    n = rng.integers(1, 5, 700)
    p = np.minimum(n, rng.integers(0, 4, 700))
    order = np.lexsort((-n, -p))
    p, n = p[order], n[order]
    for k in (2, 3, 5):
        have, place = np.zeros((k, 2), np.int64), []
        for a, b in zip(p, n):
            place.append(np.lexsort((have[:, 1], have[:, 0]) if a else (have[:, 1],))[0])
            have[place[-1]] += (a, b)
        got = matcher.deal(p, n, k)
        assert got[1].tolist() == place and got[0].tolist() == have.tolist()
    began = time.process_time()
    matcher.deal(np.repeat([1, 0], 500_000), np.ones(1_000_000, np.int64), 3)
    assert time.process_time() - began < 4


def test_texts_are_read_once(spark, sf_dir):
    """what is fitted and predicted from is a narrow table."""
    files = queries.QUERIES["logistic_scores"](spark, sf_dir).inputFiles()
    assert files and not any("documents.parquet" in f for f in files)
