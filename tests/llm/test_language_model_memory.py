"""Workers of the language model hold one block's arrays at a time."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from matchlode.llm import language_model as lm

BYTES = 1 << 20


@pytest.fixture(scope="module")
def trained(tmp_path_factory):
    """Rows of some 4 MB, and the key of a model of them."""
    folder, rnd = f"file://{tmp_path_factory.mktemp('trie')}", random.Random(5)
    words = [f"word{i}" for i in range(9000)]
    texts = pa.array([" ".join(rnd.choices(words, k=900)) for _ in range(600)])
    rows = pa.RecordBatch.from_arrays([pa.array(range(600)), texts, pa.array([False] * 600)], names=["key", "text", "held_out"])

    def one(made):
        return sorted((r for b in made for r in b.to_pylist()), key=lambda r: (r["bucket"], r["kind"]))

    def table(found):
        return pa.RecordBatch.from_pylist(found, pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), *((f"c{i}", pa.binary()) for i in range(3))]))

    words = list(lm._write_words(folder, 2)([table(one(lm._count_words(2)([rows])))]))
    sizes = [b.to_pylist()[0] for b in words]
    key = (folder, np.cumsum([0, *(s["words"] for s in sizes)]).tolist(), sum(s["tokens"] for s in sizes), 1 << 30)
    seen = next(lm._write_grams(key, 2)([table(one(lm._count_grams(key, 3)([rows])))])).to_pylist()[0]
    smooth = lm._smooth(key, lm.discount(seen["one2"], seen["two2"]), lm.discount(seen["one3"], seen["two3"]))
    assert len(list(smooth([pa.RecordBatch.from_arrays([pa.array([-2, -1, 0])], names=["id"])]))) == 1
    return key, rows


@pytest.mark.parametrize("work, most", [(lm._count_grams, 18), (lm._score, 37)])
def test_blocks_are_let_go(trained, monkeypatch, work, most):
    """The most held, as a multiple of a block's bytes."""
    key, rows = trained
    monkeypatch.setattr(lm, "AT_ONCE", BYTES)
    tracemalloc.start()
    try:
        for _ in work(key, 3)([rows]):
            pass
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < most * BYTES


def test_scores_do_not_depend_on_blocks(trained, monkeypatch):
    key, rows = trained
    whole = [r for b in lm._score(key, 3)([rows]) for r in b.to_pylist()]
    monkeypatch.setattr(lm, "AT_ONCE", BYTES)
    cut = [r for b in lm._score(key, 3)([rows]) for r in b.to_pylist()]
    assert [r["key"] for r in cut] == list(range(600))
    for name in ("n_tokens", "n_known", "base_score", "score"):
        np.testing.assert_allclose([r[name] for r in cut], [r[name] for r in whole])
