"""Near copies of the pipeline against brute force."""

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from matchlode.llm import near_copies
from matchlode.llm.scan import blocks
from matchlode.llm.simhash import shingles
from tests.llm.test_groups_and_mixing import brute_targets, roots


def copy_rows():
    rnd, rows = random.Random(7), []
    for i in range(60):
        w = [f"w{rnd.randrange(400)}" for _ in range(rnd.randrange(0, 120))]
        if i % 3 == 0:
            w = [f"common{j}" for j in range(30)] + w
        rows.append((len(rows), " ".join(w)))
        for _ in range(rnd.randrange(4)):
            w = list(w)
            for _ in range(rnd.randrange(1, 4)):
                if w:
                    w[rnd.randrange(len(w))] = f"z{rnd.randrange(9)}"
            rows.append((len(rows), " ".join(w).upper() if rnd.random() < 0.3 else " ".join(w)))
    return rows + [(900, None), (901, " "), (902, "one"), (903, "one two"), (904, "One")]


def linked(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def test_every_pair_at_the_bound_is_linked(frame, spark):
    rows = copy_rows()
    sets = [frozenset(shingles(t.encode() if t else None, 5)) for _, t in rows]
    root = roots(sets, linked)
    assert len(set(root)) < len(rows) - 20
    got = sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, frame(rows), "").collect())
    assert got == sorted({rows[r][0] for r in root})


def test_copies_that_differ_in_many_bits_go(frame, spark):
    rnd = random.Random(3)
    w = [f"w{rnd.randrange(1000)}" for _ in range(100)]
    other = [*w[:48], "x", *w[49:]]  # 5 of 96 shingles differ: 91 / 101
    assert [r.doc_id for r in corpus_pipeline.near_copies(spark, frame([(5, " ".join(w)), (4, " ".join(other)), (6, "else")]), "").orderBy("doc_id").collect()] == [4, 6]


def test_one_row_of_a_component_stays(frame, spark):
    rows = [(1, "a b c d e f g")] * 3 + [(1, "other words of the same id")] * 2 + [(None, "a b c d e f g"), (None, "q r s"), (None, "q r s")]
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, frame(rows), "").collect()), key=str)
    assert got == sorted([(1, "a b c d e f g"), (1, "other words of the same id"), (None, "q r s")], key=str)


def test_links_of_one_large_group():
    rnd = random.Random(1)
    texts = [" ".join([f"common{j}" for j in range(40)] + [f"w{rnd.randrange(6)}" for _ in range(rnd.randrange(12))]) for _ in range(120)]
    (b,) = blocks(pa.array(texts))
    h, n = near_copies.shingle_sets(b, 5)
    sig, at = near_copies.signature(h, n), np.r_[0, np.cumsum(n)]
    members = {int(s): h[at[i] : at[i + 1]] for i, s in enumerate(sig)}
    links = near_copies.Links()
    near_copies.link(members, links)
    names = sorted(members)
    root = roots([frozenset(members[s].tolist()) for s in names], linked)
    assert len(set(zip(root, map(links.find, names)))) == len(set(root)) == len(set(map(links.find, names)))
    assert len(links.edges) == len(names) - len(set(root))


def test_repeated_rows_are_mixed_one_by_one(frame, spark):
    rows = [(1, "a b", None, "s1")] * 40 + [(2, "c " * 20, None, "s2"), (None, "d", None, "s1"), (None, "d", None, "s1")]
    sizes = {"s1": 82, "s2": 20}
    taken = {"s1": 0, "s2": 0}
    for r in corpus_pipeline.mixture(spark, frame(rows), "").collect():
        taken[r.source] += len(r.text.split())
    for s, want in brute_targets(sizes).items():
        assert abs(taken[s] - want) <= (2 if s == "s1" else 20)
