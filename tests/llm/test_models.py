"""Language model, classifiers and BPE."""

import base64
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchlode.llm import language_id, toxicity
from matchlode.llm.bpe import Tokenizer, encode
from matchlode.llm.elias_fano import EliasFano, map_arrays, write_arrays
from matchlode.llm.language_model import score_documents


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**62), max_size=300), st.lists(st.integers(0, 2**62), max_size=50))
def test_elias_fano(values, asked):
    v = np.sort(np.array(values, np.uint64))
    e = EliasFano(EliasFano.build(v, 2**62 + 1, "x"), "x")
    assert (e.get(np.arange(len(v))) == v).all()
    ask = np.array(values + asked, np.uint64)
    found = e.find(ask)
    assert all((int(x) in values) == (i >= 0) and (i < 0 or v[i] == x) for x, i in zip(ask, found))


def test_elias_fano_with_a_dense_run():
    v = np.r_[np.arange(5), 10**9 + np.arange(5000), 2 * 10**12].astype(np.uint64)
    e = EliasFano(EliasFano.build(v, 2**41, "x"), "x")
    assert (e.find(v) == np.arange(len(v))).all() and (e.get(np.arange(len(v))) == v).all()


def test_arrays_are_mapped_as_written(tmp_path):
    arrays = {"a": np.arange(7, dtype=np.uint16), "b": np.zeros(0), "c": np.array([1.5])}
    write_arrays(f"file://{tmp_path}/x", "f", arrays)
    got = map_arrays(f"file://{tmp_path}/x", "f")
    assert all((got[k] == v).all() and got[k].dtype == v.dtype for k, v in arrays.items())
    assert map_arrays(f"file://{tmp_path}/x", "absent") is None


def model_rows(n=120):
    rnd = random.Random(3)
    words = [f"w{int(rnd.expovariate(0.05))}" for _ in range(4000)]
    rows = [(i, " ".join(words[k] for k in (rnd.randrange(len(words)) for _ in range(rnd.randrange(0, 40))))) for i in range(n)]
    return rows + [(500, None), (501, "A a \n b"), (502, "é É"), (None, "w1 w2"), (7, "w1")]


def brute_model(rows, order, least):
    """Exact (n_tokens, n_known, N, base_score, score) of each row by counting tuples of words."""
    tokens = [(t or "").encode().lower().split() + [None] for _, t in rows]
    learned = [x for (d, _), x in zip(rows, tokens) if d is not None and zlib.crc32(str(d).encode()) % 10]
    one, two = Counter(w for x in learned for w in x), Counter(p for x in learned for p in zip([None, *x], x))
    three = Counter(p for x in learned for p in zip([None, *x], x, x[1:]))
    n, v = sum(one.values()), len(one)
    p1 = lambda w: (one[w] + 0.1) / (n + 0.1 * (v + 1))

    def rate(c):
        ones, twos = (sum(x == k for x in c.values()) for k in (1, 2))
        return min(0.99, max(0.1, ones / (ones + 2 * twos) if ones else 0.5))

    d2, d3, kinds = rate(two), rate(three), Counter(u for u, _ in two)
    kept, taken = {k: c for k, c in three.items() if c >= least}, Counter()
    for k, c in kept.items():
        taken[k[:2]] += c - d3

    def p2(u, w):
        return p1(w) if u not in one else (max(0, two[u, w] - d2) + d2 * kinds[u] * p1(w)) / one[u]

    def p3(u, v, w):
        if order < 3 or (u, v) not in taken:
            return p2(v, w)
        return (kept.get((u, v, w), d3) - d3) / two[u, v] + (1 - taken[u, v] / two[u, v]) * p2(v, w)

    out = []
    for x in tokens:
        p = [p2(None, x[0]), *(p3(*t) for t in zip([None, *x], x, x[1:]))]
        out.append((len(x), sum(w in one for w in x), n, sum(math.log10(p1(w)) for w in x), sum(map(math.log10, p))))
    return out


def scored(df, *columns, **more):
    return sorted((tuple(r[c] for c in columns) for r in score_documents(df, **more).collect()), key=str)


@pytest.mark.parametrize(("order", "least", "cell_tokens"), [(3, 2, 1 << 21), (3, 1, 90), (2, 1, 200)])
def test_language_model(frame, order, least, cell_tokens):
    rows = model_rows()
    got = {(r.doc_id, r.n_tokens, round(r.base_score, 6)): r for r in score_documents(frame(rows), order, least, cell_tokens).collect()}
    for (d, _), (n, known, total, base, score) in zip(rows, brute_model(rows, order, least)):
        r = got[d, n, round(base, 6)]
        assert (r.n_known, r.train_tokens) == (known, total) and r.base_score == pytest.approx(base, abs=1e-9)
        assert r.score == pytest.approx(score, abs=3e-4 * n)  # quantisation
        assert r.held_out == (d is not None and zlib.crc32(str(d).encode()) % 10 == 0)


def test_scores_do_not_depend_on_partitions(frame, spark):
    rows, found = model_rows(), []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts, cell_tokens in ((2, 1 << 21), (64, 100)):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            found.append(scored(frame(rows).repartition(parts), "doc_id", "n_tokens", "n_known", "base_score", "score", cell_tokens=cell_tokens))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def thue_morse(first, second, n=1024):
    """A word whose polynomial hash modulo 2**64 equals that of the word with both letters changed over."""
    return "".join((first, second)[i.bit_count() % 2] for i in range(n))


def test_words_are_told_apart_by_more_than_a_polynomial(frame):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    learned = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10)
    got = {r.doc_id: r.n_known for r in score_documents(frame([(learned, thue_morse("a", "b")), (held, thue_morse("b", "a"))])).collect()}
    assert got == {learned: 2, held: 1}  # the end token alone


def test_words_of_equal_upper_halves_are_told_apart(tmp_path):
    from matchlode.llm import language_model as lm

    a, b = np.array([5, 5, 5, 9, 9, 1 << 40], np.uint64), np.array([1, 4, 7, 2, 3, 8], np.uint64)
    parts = EliasFano.build(a, lm._start(1, 2), "hash")
    write_arrays(f"file://{tmp_path}", "words-0", parts | {"check": b, "count": np.arange(1, 7, dtype=np.uint8)})
    trie = lm.Trie(f"file://{tmp_path}", [0, 6, 6], 21)
    ask_a, ask_b = np.array([5, 5, 5, 5, 7, 9, 9, 9, 1 << 40], np.uint64), np.array([1, 4, 6, 7, 1, 2, 3, 9, 8], np.uint64)
    assert trie.find(ask_a, ask_b)[0].tolist() == [0, 1, -1, 2, -1, 3, 4, -1, 5]
    words, more, own = lm.vocabulary(np.array([9, 5, 9, 5], np.uint64), np.array([2, 7, 1, 7], np.uint64))
    assert (words.tolist(), more.tolist(), own.tolist()) == ([5, 9, 9], [7, 1, 2], [2, 0, 1, 0])


def test_model_probabilities_sum_to_one(frame, spark, monkeypatch):
    from matchlode.llm import language_model as lm

    kept = {}
    real = lm._score
    monkeypatch.setattr(lm, "_score", lambda *a: kept.update(a=a) or real(*a))
    lm.score_documents(frame(model_rows()), 3, 2, 300).count()
    key, order = kept["a"]
    trie = lm.Trie(*key)
    scorer, size = lm.Scorer(trie, order), trie.size
    end = int(trie.find(*(np.array([x]) for x in lm.END))[0][0])
    ids = np.r_[-1, np.arange(size)]
    count = trie.of_words("words", "count", 0, size, np.int64)
    for context in (np.r_[end], np.argsort(-count)[[1, 2]], np.argsort(-count)[[3, 1]], np.r_[0]):
        rows = np.stack([np.r_[context + 1, x] for x in (0, *range(1, size + 1))])
        rows = np.c_[rows, np.full(len(rows), end + 1)]
        p = scorer.probabilities(ids, rows.ravel(), np.arange(len(rows) + 1) * rows.shape[1])
        assert p.reshape(rows.shape)[:, len(context)].sum() == pytest.approx(1, abs=2e-3)  # quantisation


def test_files_that_cannot_be_mapped_are_let_go(tmp_path):
    from matchlode.llm.elias_fano import Shelf

    for i in range(5):
        write_arrays(f"file://{tmp_path}", f"f{i}", {"a": np.full(1000, i)})
    shelf = Shelf(f"file://{tmp_path}", 20_000)
    shelf.near = False
    assert [int(shelf.get(f"f{i}")["a"][0]) for i in (0, 1, 0, 2, 3, 4, 0)] == [0, 1, 0, 2, 3, 4, 0]
    assert shelf.held <= 20_000 and sum(size for _, size in shelf.open.values()) == shelf.held and shelf.get("none") is None


def test_language_model_of_nothing(frame):
    empty = frame([(1, "a")]).filter("false")
    assert score_documents(empty).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = score_documents(frame([(held, "a b")])).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (3, 0, 0, True) and r.score == r.base_score == 0.0


def language_rows():
    rnd = random.Random(6)
    kinds = {"aa": "abc", "bb": "xyz", "cc": "éèà"}
    return [(i, " ".join("".join(rnd.choice(kinds[k]) for _ in range(4)) for _ in range(12)), k) for i in range(240) for k in [rnd.choice(list(kinds))]]


def test_language_identification(frame):
    rows = language_rows()
    got = {r.doc_id: r for r in language_id.identify(frame(rows + [(900, None, "aa"), (901, " 123 !", "aa"), (902, "", "aa"), (903, "abc", None)]), "doc_id").collect()}
    assert sum(got[d].lang_pred == k for d, _, k in rows) >= 0.99 * len(rows)
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d in (900, 901, 902))
    assert got[903].lang_pred == "aa"
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())


def test_language_identification_of_nothing(frame):
    assert language_id.identify(frame([(1, "a", "en")]).filter("false"), "doc_id").count() == 0
    assert [r.lang_pred for r in language_id.identify(frame([(1, "abc", None), (None, "abc", "en")]), "doc_id").collect()] == ["und", "und"]


def test_language_identification_keeps_clashing_columns(frame):
    df = frame(language_rows()).withColumn("text_to_scan", F.lit(1)).withColumn("_held_out", F.lit("x")).withColumn("row", F.lit(2))
    r = language_id.identify(df, "doc_id", "text_to_scan", "_held_out", "row").first()
    assert (r.text_to_scan, r["_held_out"], r["row"]) == (1, "x", 2) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_rare_languages_are_learned(frame):
    rnd = random.Random(8)
    word = lambda letters: "".join(rnd.choice(letters) for _ in range(4))
    rows = [(i, " ".join(word("abc") for _ in range(9)), "aa") for i in range(900)] + [(900 + i, " ".join(word("xyz") for _ in range(9)), "bb") for i in range(12)]
    known = [(i, t, k) for i, t, k in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    model = language_id.fit(frame(known).selectExpr("doc_id AS id", "text", "lang AS label"), sample_rows=40)
    assert model.languages == ["aa", "bb"] and model.predict("xyzz zyxx yyxz zzyx")[0] == "bb" and model.predict("abcc cabb aabc")[0] == "aa"


def test_language_scores_by_their_definition(frame):
    """Predictions of the fitted model again, with dictionaries of n-grams hashed one by one."""
    rows = language_rows()
    model = language_id.fit(frame([r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]).selectExpr("doc_id AS id", "text", "lang AS label"))
    texts = ["abca cab ÉÈ", rows[0][1], rows[1][1].upper()]
    got = {r.text: r for r in language_id.predict(frame([(i, t) for i, t in enumerate(texts)]), model, "text").collect()}
    mask = (1 << 64) - 1

    def mixed(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    for t in texts:
        cells = Counter()
        points = [ord(c) for c in t.lower()]
        for n in (1, 2, 3):
            for i in range(len(points) - n + 1):
                h = 0
                for c in points[i : i + n]:
                    h = (h * 0x9E3779B97F4A7C15 + c) & mask
                cells[mixed((h + n) & mask) % language_id.DIMENSIONS] += 1
        x = {c: (1 + math.log(n)) * model.idf[c] for c, n in cells.items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        z = [(sum(v / size * model.weights[c, k] for c, v in x.items()) + model.weights[-1, k]) / model.temperature for k in range(len(model.languages))]
        e = [math.exp(v - max(z)) for v in z]
        assert got[t].lang_pred == model.languages[int(np.argmax(e))] and got[t].score == pytest.approx(max(e) / sum(e), abs=1e-4)


def test_weights_follow_the_regularised_leader():
    """One pass over three examples, coordinate by coordinate."""
    rng = np.random.default_rng(0)
    idf = rng.uniform(1, 2, language_id.DIMENSIONS)
    rows = [(np.array([1, 5, 9]), np.array([1.0, 2.0, 1.0]), 0), (np.array([5, 7]), np.array([3.0, 1.0]), 1), (np.array([1, 7]), np.array([1.0, 1.0]), 0)]
    z, s, w = {}, {}, {}
    for at, n, label in rows:
        x = dict(zip(at.tolist(), language_id.vector(at, n, idf))) | {language_id.DIMENSIONS: 1.0}
        weight = lambda i, k: 0.0 if abs(z.get((i, k), 0)) <= language_id.L1 else -(z[i, k] - math.copysign(language_id.L1, z[i, k])) / ((language_id.BETA + math.sqrt(s[i, k])) / language_id.ALPHA + language_id.L2)
        margins = np.array([sum(v * weight(i, k) for i, v in x.items()) for k in (0, 1)])
        p = np.exp(margins) / np.exp(margins).sum()
        for i, v in x.items():
            for k in (0, 1):
                w[i, k] = weight(i, k)
        for i, v in x.items():
            for k in (0, 1):
                g = v * (p[k] - (k == label))
                step = (math.sqrt(s.get((i, k), 0) + g * g) - math.sqrt(s.get((i, k), 0))) / language_id.ALPHA
                z[i, k] = z.get((i, k), 0) + g - step * w[i, k]
                s[i, k] = s.get((i, k), 0) + g * g
    got = language_id.fit_weights(rows, idf, 2, epochs=1)
    assert all(got[i, k] == pytest.approx(weight(i, k)) for i, k in z)


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 400)
    z = rng.normal(0, 1, (400, 3))
    z[np.arange(400), y] += 1
    loss = lambda t: -np.log(language_id.softmax(z * 9 / t)[np.arange(400), y]).mean()
    t = language_id.fit_temperature(z * 9, y)
    assert loss(t) <= min(loss(1.0), loss(5.0), loss(20.0)) + 1e-3


def toxic_rows():
    rnd = random.Random(9)
    out = []
    for i in range(600):
        w = [f"w{rnd.randrange(400)}" for _ in range(rnd.randrange(5, 60))]
        bad = rnd.random() < 0.3
        if bad:
            w.insert(rnd.randrange(len(w)), rnd.choice(["vilestone", "vilestx", "grumbad"]))
        out.append((i, " ".join(w), "en" if i % 2 else "fr", None, int(bad)))
    return out


def test_toxicity(frame, spark):
    rows = toxic_rows()
    docs = frame([r[:4] for r in rows] + [(9000, None), (9001, ""), (0, rows[0][1])])
    labels = spark.createDataFrame([(r[0], 1, r[4]) for r in rows] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model, "doc_id").collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert sum((got[r[0]] >= 0.5) == bool(r[4]) for r in held) >= 0.97 * len(held)
    assert all(0 <= s <= 1 for s in got.values()) and got[9000] == got[9001] < 0.5


def test_toxicity_without_both_labels(frame, spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    docs = frame([(1, "a"), (2, None)])
    assert [r.score for r in toxicity.score(docs, toxicity.fit(docs, labels), "doc_id").collect()] == [0.0, 0.0]


def test_toxicity_of_empty_tables_and_clashing_columns(frame, spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 1, 1)], "doc_id long, quality int, toxic int")
    docs = frame([(1, "a"), (2, "b b"), (None, "c")]).withColumn("text_to_scan", F.lit(7)).withColumn("draw", F.lit("x")).withColumn("toxic", F.lit(0))
    model = toxicity.fit(docs, labels)
    assert {r.text_to_scan for r in toxicity.score(docs, model, "doc_id", "text_to_scan").collect()} == {7}
    empty = docs.filter("false")
    assert toxicity.fit(empty, labels) is None and toxicity.fit(docs, labels.filter("false")) is None
    assert toxicity.score(empty, model, "doc_id").count() == 0


def test_long_texts_do_not_crowd_out_the_sample(frame, spark):
    rows = toxic_rows()[:60]
    labels = spark.createDataFrame([(r[0], 1, r[4]) for r in rows], "doc_id long, quality int, toxic int")
    docs = frame([r[:4] for r in rows])
    short = sorted(r.text for r in toxicity.sample(docs, labels, size=1 << 20, text=4000).collect())
    assert len(short) == sum(zlib.crc32(str(r[0]).encode()) % 5 != 0 for r in rows)
    long = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.repeat("text", F.lit(4000))).otherwise(F.col("text")))
    left = sorted(r.text for r in toxicity.sample(long, labels, size=1 << 20, text=4000).collect())
    assert left == sorted(r[1] for r in rows if zlib.crc32(str(r[0]).encode()) % 5 and r[0] % 3)
    few = toxicity.sample(docs, labels, size=1000, text=4000).collect()
    assert 0 < len(few) < len(short) and sum(len(r.text) for r in few) <= 1000


def test_toxicity_scores_by_their_definition():
    """Maxima over all windows of all filters, word by word."""
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, toxicity.BUCKETS, (n, 4)).astype(np.int32) for n in (0, 1, 2, 5, 30)]
    m = toxicity.train(docs * 4, np.array([0, 1, 0, 1, 0] * 4, float))
    m.thresholds, m.slope = np.array([0.3]), 1.7
    for f, got in zip(docs, m.score(np.concatenate(docs), np.cumsum([0, *map(len, docs)]))):
        words = [sum(m.embedding[b].astype(float) for b in w) for w in f]
        margin = m.out_bias
        for w, width in enumerate(toxicity.WIDTHS):
            for c in range(toxicity.FILTERS):
                best = max([0.0, *(sum(words[i + j] @ m.filters[w][j][:, c] for j in range(width)) + m.bias[w, c] for i in range(len(words) - width + 1))])
                margin += best * m.out[w * toxicity.FILTERS + c]
        assert got == pytest.approx(1 / (1 + math.exp(-1.7 * (margin - 0.3))), abs=1e-4)


def test_convolutions_learn_what_single_words_cannot():
    """Toxic is a pair of words side by side, each of which is as frequent elsewhere; frozen filters see words alone."""
    rnd = np.random.default_rng(7)
    words = rnd.integers(0, toxicity.BUCKETS, (40, 4)).astype(np.int32)
    docs, labels = [], []
    for i in range(1600):
        x = rnd.integers(4, 40, 12)
        a, b = (0, 1) if i % 2 else (1, 0)
        at = rnd.integers(0, 11)
        x[at : at + 2] = a, b
        docs.append(words[x])
        labels.append(i % 2)
    y = np.array(labels, float)
    m = toxicity.train(docs[:1200], y[:1200], epochs=12)
    first = np.cumsum([0, *map(len, docs[1200:])])
    flat = np.concatenate(docs[1200:])
    share = lambda m: ((m.pooled(flat, first) @ m.out + m.out_bias > 0) == (y[1200:] == 1)).mean()
    frozen = toxicity.train(docs[:1200], y[:1200], epochs=0)
    assert share(m) > 0.9 and share(frozen) < 0.6


def test_pieces_do_not_change_maxima(monkeypatch):
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, toxicity.BUCKETS, (n, 4)).astype(np.int32) for n in (0, 1, 2, 3, 40, 7)]
    m = toxicity.train(docs + docs, np.array([0, 1, 0, 1, 0, 1] * 2, float))
    first = np.cumsum([0, *map(len, docs)])
    whole = m.pooled(np.concatenate(docs), first)
    monkeypatch.setattr(toxicity, "PIECE", 3)
    assert np.allclose(whole, m.pooled(np.concatenate(docs), first), atol=1e-5)


PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(PATH, "rb"))}
    return Tokenizer(PATH, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(text=st.one_of(st.text(max_size=80), st.text("ab \n'stéλ1!", max_size=120)))
def test_bpe_matches_tiktoken(both, text):
    own, other = both
    ids = own.encode(text)
    assert ids.tolist() == other.encode_ordinary(text) and own.decode(ids) == text.encode()


def test_bpe_of_long_runs(both):
    for text in ("a" * 3000, "日本" * 500, "\u0000 \t" * 400, "<|endoftext|>"):
        assert both[0].encode(text).tolist() == both[1].encode_ordinary(text)


def test_perfect_hash_is_one_to_one(both):
    keys = both[0].whole.keys
    assert [both[0].whole.find(k) for k in keys] == list(range(len(keys)))
    assert both[0].whole.find(b"no such pre-token") is None


def test_bpe_column(frame):
    rows = [(1, "Hello, wörld"), (2, None), (3, ""), (3, "")]
    got = sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in encode(frame(rows), PATH, public_tokenizers.PATTERN, "doc_id").collect()), key=str)
    assert [(d, x) for d, _, x in got] == [(1, "Hello, wörld".encode()), (2, b""), (3, b""), (3, b"")]
    assert encode(frame(rows).filter("false"), PATH, public_tokenizers.PATTERN, "doc_id").count() == 0
