"""One very long text beside short ones, through every operator."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from matchlode.llm import language_id, media, toxicity
from matchlode.llm.bpe import encode
from matchlode.llm.exact_dedup import exact_groups
from matchlode.llm.language_model import score_documents
from matchlode.llm.line_dedup import remove_repeated_lines
from matchlode.llm.mixing import mix_sources
from matchlode.llm.near_copies import similar_components
from matchlode.llm.simhash import near_duplicates
from matchlode.llm.substring_dedup import remove_repeated_spans

WORDS, LINE = 1_700_000, 20


@pytest.fixture(scope="module")
def text():
    rnd = np.random.default_rng(1)
    words = np.array([f"w{i:05}" for i in range(60000)])
    own = words[rnd.integers(0, len(words), WORDS)]
    return "\n".join(" ".join(own[i : i + LINE]) for i in range(0, WORDS, LINE))


@pytest.fixture(scope="module")
def docs(frame, text):
    """The text, its end as another document, and some short ones: 12 MB in one row."""
    assert len(text) > 11_000_000
    rnd = random.Random(2)
    short = [(i, " ".join(f"w{rnd.randrange(60000):05}" for _ in range(30)), "en") for i in range(10, 40)]
    return frame([(1, text, "en", "s"), (2, text[-WORDS // 10 * 7 :].split(" ", 1)[1], "en", "s"), *short]).cache()


def test_spans_and_lines(docs):
    got = {r.doc_id: r for r in remove_repeated_spans(docs).select("doc_id", "n_words", "n_removed").collect()}
    assert got[1].n_words == WORDS and got[1].n_removed == 0 and got[2].n_removed == got[2].n_words > WORDS // 20
    got = {r.doc_id: r for r in remove_repeated_lines(docs, runs=True).select("doc_id", "n_lines", "n_removed").collect()}
    assert got[1].n_lines == WORDS // LINE and got[1].n_removed == 0 and got[2].n_removed >= got[2].n_lines - 1


def test_groups_and_mixing(docs):
    assert {r.doc_id: r.group_size for r in exact_groups(docs).collect()}[1] == 1
    assert {r.doc_id: r["size"] for r in mix_sources(docs).collect()}[1] == WORDS
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}[1] == 1
    known, labels = similar_components(docs.select(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("version"), "text"))
    assert known.count() == docs.count() and labels.count() == 0


def test_models(docs, spark):
    got = {r.doc_id: r for r in score_documents(docs).collect()}
    assert got[1].n_tokens == WORDS + 1 and np.isfinite(got[1].score) and got[1].score < 0
    labels = spark.createDataFrame([(i, 1, int(i % 2)) for i in (1, *range(10, 40))], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels), "doc_id").count() == docs.count()
    assert {r.doc_id: r.lang_pred for r in language_id.identify(docs, "doc_id").collect()}[1] == "en"


def test_bytes(docs, text):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    sha = {r.doc_id: r.s for r in encode(docs, path, public_tokenizers.PATTERN, "doc_id").select("doc_id", F.sha2("decoded", 256).alias("s")).collect()}
    assert sha == {r.doc_id: r.s for r in docs.select("doc_id", F.sha2("text", 256).alias("s")).collect()}
    got = {r.doc_id: r for r in media.read_audio(media.store_audio(docs), "doc_id", "n_bytes").select("doc_id", "n_bytes", F.length("payload").alias("size")).collect()}
    assert got[1].n_bytes == len(text) and got[1]["size"] == -(-len(text) // 64) * 64
