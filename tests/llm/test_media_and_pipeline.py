"""Media columns, the registered queries and the corpus pipeline."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from matchlode.llm import media, queries
from matchlode.llm.bpe import tokenizer
from matchlode.llm.simhash import shingles
from pyspark.sql import functions as F
from tests.llm.test_groups_and_mixing import brute_targets, roots
from tests.llm.test_line_runs import brute_runs


def test_resampling_is_the_direct_convolution():
    x = np.random.default_rng(1).normal(size=501).astype(np.float32)
    y, h = media.resample(x), media._filter()
    assert len(y) == 501 * media.UP // media.DOWN
    for n in (0, 1, 2, 3, 50, len(y) - 1):
        phase, at = n * media.DOWN % media.UP, n * media.DOWN // media.UP
        want = sum(h[phase, k] * x[at - k] for k in range(media.TAPS) if 0 <= at - k)
        assert y[n] == pytest.approx(want, abs=1e-5)


def test_segments_have_hysteresis():
    e = np.array([0, 0, 0.05, 0.2, 0.05, 0, 0.05, 0.05, 0, 0.3, 0, 0, 0, 0], float)
    level = np.median(e)
    assert media.segments(e + 1 - level).tolist() == [[2, 4], [9, 9]]


def brute_features(payload):
    """Mel tensor and spans by direct sums: convolution, Fourier sums and a state machine."""
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    n = media.UP * media.TAPS
    h = np.sinc((np.arange(n) - (n - 1) / 2) / media.DOWN) * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / (n - 1)))
    h *= media.UP / h.sum()
    up = np.zeros(len(x) * media.UP)
    up[:: media.UP] = x
    y = np.convolve(up, h)[:: media.DOWN][: len(x) * media.UP // media.DOWN]
    y = np.pad(y, (0, max(0, media.WINDOW - len(y))))
    rate = media.RATE * media.UP / media.DOWN
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(1, media.WINDOW + 1) / (media.WINDOW + 1))
    bins = np.arange(media.POINTS // 2 + 1)
    fourier = np.exp(-2j * np.pi * np.outer(np.arange(media.WINDOW), bins) / media.POINTS)
    to_mel, to_hz = lambda f: 2595 * np.log10(1 + f / 700), lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = [to_hz(to_mel(60) + (to_mel(rate / 2) - to_mel(60)) * i / (media.BANDS + 1)) for i in range(media.BANDS + 2)]
    frames = []
    for lo in range(0, len(y) - media.WINDOW + 1, media.HOP):
        power = abs((y[lo : lo + media.WINDOW] * window) @ fourier) ** 2
        frames.append([np.log10(sum(power * np.clip(np.minimum((bins * rate / media.POINTS - a) / (b - a), (c - bins * rate / media.POINTS) / (c - b)), 0, None)) + 1e-6) for a, b, c in zip(edges, edges[1:], edges[2:])])
    mel = np.array(frames)
    cuts = [int(len(mel) * i / media.TIMES) for i in range(media.TIMES + 1)]
    tensor = [mel[a:b].mean(0) if b > a else np.zeros(media.BANDS) for a, b in zip(cuts, cuts[1:])]
    energy, found, start, high = mel.mean(1), [], None, False
    for i, e in enumerate([*(energy - np.median(energy)), -9]):
        if e > media.LOWER:
            start, high = (i, e > media.UPPER) if start is None else (start, high or e > media.UPPER)
        elif start is not None:
            found += [(start * media.HOP / rate, ((i - 1) * media.HOP + media.WINDOW) / rate)] if high else []
            start = None
    return np.array(tensor), np.array(found).reshape(-1, 2)


def test_media_of_an_empty_table_and_clashing_columns(frame):
    docs = frame([(1, "a b"), (1, "a b"), (None, "c")]).withColumn("key", F.lit(1)).withColumn("media", F.lit("x"))
    stored = media.store_audio(docs)
    assert media.read_audio(stored, "doc_id", "n_bytes").count() == 3
    assert media.read_audio(media.store_audio(docs.filter("false")), "doc_id").count() == 0


def test_media_round_trip(frame):
    rows = [(1, "Hello wörld"), (2, None), (3, ""), (4, "x" * 64), (5, "y" * 65), (6, "word " * 5000), (7, "Hello wörld")]
    got = {r.doc_id: r for r in media.read_audio(media.store_audio(frame(rows)), "doc_id", "n_bytes").collect()}
    for d, t in rows:
        raw = (t or "").encode()
        want = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert bytes(got[d].payload) == want == media.from_wav(bytes(got[d].media)) and got[d].n_bytes == len(raw)
        tensor = media.read_tensor(bytes(got[d].tensor))
        assert tensor.shape == (media.TIMES, media.BANDS) and list(tensor.dim_names) == ["time", "band"]
        mel, spans = brute_features(want)
        assert np.allclose(tensor.to_numpy(), mel, atol=2e-3)
        assert len(got[d].spans) == len(spans) and np.allclose(np.array([(s.begin, s.end) for s in got[d].spans]).reshape(-1, 2), spans, atol=1e-3)
        assert all(0 <= s.begin < s.end for s in got[d].spans)
    assert got[1].tensor == got[7].tensor and got[1].spans == got[7].spans and got[2].tensor == got[3].tensor


def test_tensors_have_a_fixed_shape(frame):
    table = media.read_audio(media.store_audio(frame([(1, "a"), (2, "b")])), "doc_id").toArrow()
    kind = media.tensor_table(table).schema.field("tensor").type
    assert isinstance(kind, pa.FixedShapeTensorType) and kind.shape == [media.TIMES, media.BANDS]
    assert media.tensor_table(table.slice(0, 0)).num_rows == 0


def test_media_query(spark, sf_dir):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op9_media(spark, sf_dir).collect():
        raw = docs[r.doc_id].ljust(max(64, -(-len(docs[r.doc_id]) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(docs[r.doc_id]), len(raw), zlib.crc32(raw[-64:]))
        assert r.payload_sha256 == hashlib.sha256(raw).hexdigest() and r.media_sha256 == hashlib.sha256(media.to_wav(raw)).hexdigest() and r.media_bytes == len(media.to_wav(raw))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_return_a_row_a_document(spark, sf_dir, name):
    got = [r.doc_id for r in queries.QUERIES[name](spark, sf_dir).select("doc_id").collect()]
    assert sorted(got) == sorted(r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect())


def pipeline_rows():
    rnd, rows = random.Random(12), []
    kinds = {"aa": "abcdef", "bb": "uvwxyz"}
    for i in range(160):
        k = rnd.choice(list(kinds))
        lines = [" ".join("".join(rnd.choice(kinds[k]) for _ in range(5)) for _ in range(6)) for _ in range(rnd.randrange(1, 9))]
        if rows and rnd.random() < 0.2:
            lines = rnd.choice(rows)[1].split("\n") + lines[:1]
        rows.append((i, "\n".join(lines), k, rnd.choice(["s1", "s1", "s2", None])))
    return rows + [(900, "123 456", "aa", "s1"), (901, None, "aa", "s2"), (902, "", None, None)]


def test_pipeline_stages_match_brute_force(frame, spark, tmp_path):
    rows = pipeline_rows()
    docs, stages = frame(rows), dict(corpus_pipeline.STAGES)
    columns = docs.columns

    def step(name, df):
        out = stages[name](spark, df, "")
        if name != "bpe":
            assert out.columns == columns and out.schema.simpleString() == df.schema.simpleString()
        out.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    one = step("language_id", docs)
    assert sorted(r.doc_id for r in one.collect()) == sorted(d for d, *_ in rows if d < 900)
    two = step("line_dedup", one)
    texts = {d: t for d, t, _ in brute_runs([r[:2] for r in rows if r[0] < 900])}
    assert {r.doc_id: r.text for r in two.collect()} == texts
    assert all(r.n_chars == len(r.text) for r in two.collect())
    three = step("simhash_near_dedup", two)
    ids = sorted(texts)
    sets = [frozenset(shingles(texts[d].encode(), 5)) for d in ids]
    root = roots(sets, lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
    stay = {ids[r] for r in root}
    assert {r.doc_id for r in three.collect()} == stay and three.count() == len(stay)
    four = step("mixing", three)
    sources = {d: s for d, _, _, s in rows}
    sizes, taken = {}, {}
    for d in stay:
        sizes[sources[d]] = sizes.get(sources[d], 0) + len(texts[d].split())
    got = four.collect()
    for r in got:
        assert r.text == texts[r.doc_id]
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    for s, want in brute_targets(sizes).items():
        assert abs(taken.get(s, 0) - want) <= max(len(texts[d].split()) for d in stay if sources[d] == s)
    five = stages["bpe"](spark, four, "").collect()
    assert sorted((r.doc_id, r.decoded_sha256) for r in five) == sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in got)
    assert all(r.n_tokens == len(r.ids) for r in five)


def test_pipeline_of_an_empty_table(frame, spark):
    docs = frame([(1, "a")]).filter("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0, name


def test_pipeline_keeps_other_columns(frame, spark):
    docs = frame(pipeline_rows()).withColumn("version", F.lit("v")).withColumn("score", F.lit(1)).withColumn("row", F.lit(2)).withColumn("copies", F.lit(3)).withColumn("lang_pred", F.lit("z"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        first = out.first()
        assert (first.version, first.score, first["row"], first.copies, first.lang_pred) == ("v", 1, 2, 3, "z"), name


def test_registered_pipeline(spark, sf_dir):
    """run() is the stages one after the other, each on what its predecessor kept."""
    out = sorted((r.doc_id, r.source, list(r.ids)) for r in corpus_pipeline.run(spark, sf_dir).collect())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r for r in corpus_pipeline.language(spark, docs, sf_dir).collect()}
    left = {d: t for d, t, _ in brute_runs([(d, r.text) for d, r in texts.items()])}
    ids = sorted(left)
    sets = [frozenset(shingles(left[d].encode(), 5)) for d in ids]
    stay = {ids[r] for r in roots(sets, lambda a, b: 5 * len(a & b) >= 4 * len(a | b))}
    own = tokenizer(public_tokenizers.path(corpus_pipeline.VOCABULARY), public_tokenizers.PATTERN)
    assert {d for d, *_ in out} <= stay and all(x == own.encode(left[d]).tolist() for d, _, x in out)
    sizes, taken = {}, {}
    for d in stay:
        sizes[texts[d].source] = sizes.get(texts[d].source, 0) + len(left[d].encode().split())
    for d, s, _ in out:
        taken[s] = taken.get(s, 0) + len(left[d].encode().split())
    for s, want in brute_targets(sizes).items():
        assert abs(taken.get(s, 0) - want) <= max(len(left[d].encode().split()) for d in stay if texts[d].source == s)
    assert corpus_pipeline.ORACLE_SQL is None
