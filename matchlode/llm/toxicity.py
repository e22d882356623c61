"""A convolutional text classifier, trained in numpy, with thresholds by language.

A word's embedding is the sum of hashed embeddings of the word and of its first 4, 6 and 8 bytes, so
that compounds of one stem share weights. Filters of 1, 2 and 3 words run over all words of a text;
the maximum of each filter enters a logistic layer. The first embedding dimension starts from
shrunken log-odds in the sample and everything is then trained by Adagrad through the maxima.

Thresholds are set by language, as guessed from the text's own words: scores are shifted so that 0.5
is the threshold of the guessed language, and scaled by a slope fitted on the held part of the
sample. The sample is bounded by SAMPLE_ROWS and SAMPLE_BYTES.

Defined results: null and empty texts have no words, and get the score of maxima 0; without labels of
both classes every score is 0. Repeated rows get equal results. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .language_id import held_out
from .scan import LOWER, Block, blocks, mix, range_hashes

#: The most labelled rows, and bytes of their texts, that are learned from: the first by a hash of
#: doc_id, without texts of more than SAMPLE_TEXT bytes, which would crowd out others.
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_TEXT = 8000, 24 << 20, 256 << 10
BUCKETS = 1 << 19
PREFIXES = (4, 6, 8)
DIMENSIONS, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
EPOCHS, RATE, SHRINK = 2, 0.03, 4.0
#: Words are convolved in pieces of so many, which overlap by the widest filter.
PIECE = 1 << 17


def word_features(b: Block) -> np.ndarray:
    """Buckets of each word: its own and those of its prefixes, (words, 1 + len(PREFIXES))."""
    data = LOWER[b.data]
    ends = [b.end, *(np.minimum(b.start + n, b.end) for n in PREFIXES)]
    found = [range_hashes(data, b.start, e)[0] for e in ends]
    return np.stack([(mix(h + np.uint64(k)) % np.uint64(BUCKETS)).astype(np.int32) for k, h in enumerate(found)], 1)


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]  # for each width: (width, DIMENSIONS, FILTERS)
    bias: np.ndarray  # (widths, FILTERS)
    out: np.ndarray
    out_bias: float
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(1))
    slope: float = 1.0
    tongues: np.ndarray | None = None  # (LANGUAGE_BUCKETS, languages): log-probabilities

    def pooled(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The maxima of all filters for each row; 0 at least."""
        rows = len(first) - 1
        best = np.zeros((rows, len(WIDTHS), FILTERS), np.float32)
        row = np.repeat(np.arange(rows), np.diff(first))
        for lo in range(0, len(features), PIECE):
            hi = min(len(features), lo + PIECE + max(WIDTHS) - 1)
            x = self.embedding[features[lo:hi, 0]].astype(np.float32)
            for k in range(1, features.shape[1]):
                x += self.embedding[features[lo:hi, k]]
            for w, width in enumerate(WIDTHS):
                n = min(PIECE, hi - lo - width + 1)
                if n <= 0:
                    continue
                y = x[:n] @ self.filters[w][0]
                for j in range(1, width):
                    y += x[j : j + n] @ self.filters[w][j]
                own = row[lo : lo + n]
                whole = own == row[lo + width - 1 : lo + width - 1 + n]
                y, own = y[whole], own[whole]
                if len(own):
                    at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                    best[own[at], w] = np.maximum(best[own[at], w], np.maximum.reduceat(y, at, axis=0) + self.bias[w])
        return best.reshape(rows, -1)

    def tongue(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The likeliest language of each row, by its words; 0 without words."""
        rows = len(first) - 1
        guess = np.zeros(rows, np.int64)
        if self.tongues is not None and self.tongues.shape[1] > 1:
            full = np.flatnonzero(np.diff(first))
            if len(full):
                sums = np.add.reduceat(self.tongues[features[:, 0] % len(self.tongues)], first[full], axis=0)
                guess[full] = sums.argmax(1)
        return guess

    def score(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        margin = self.pooled(features, first) @ self.out + self.out_bias
        z = self.slope * (margin - self.thresholds[self.tongue(features, first)])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


LANGUAGE_BUCKETS = 1 << 15


def _log_odds(docs: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    seen = np.zeros((2, BUCKETS))
    for x, y in zip(docs, labels):
        seen[int(y), np.unique(x)] += 1
    n = np.bincount(labels.astype(int), minlength=2)
    rate = labels.mean()
    both = seen.sum(0)
    odds = np.log((seen[1] + SHRINK * rate) / (n[1] + SHRINK * rate)) - np.log((seen[0] + SHRINK * (1 - rate)) / (n[0] + SHRINK * (1 - rate)))
    return np.where(both > 1, odds * both / (both + SHRINK), 0).astype(np.float32)


def train(docs: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> Model:
    """docs: word features of each text."""
    rng = np.random.default_rng(seed)
    e = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    e[:, 1:] = rng.normal(0, 0.05, (BUCKETS, DIMENSIONS - 1))
    e[:, 0] = _log_odds(docs, labels)
    filters = [rng.normal(0, 0.1, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, 0] = 1 / len(f)
    m = Model(e, filters, np.zeros((len(WIDTHS), FILTERS), np.float32), rng.normal(0, 0.05, len(WIDTHS) * FILTERS).astype(np.float32), float(np.log(labels.mean() / (1 - labels.mean()))) - 2.0)
    m.out[0] = 1.0
    grown_e, grown_f = np.full(BUCKETS, 1e-2, np.float32), [np.full_like(f, 1e-2) for f in filters]
    grown_o, grown_b = np.full(len(m.out) + 1, 1e-2), np.full_like(m.bias, 1e-2)
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            f = docs[i]
            if not len(f):
                continue
            x = e[f].sum(1)
            top, at = np.zeros((len(WIDTHS), FILTERS), np.float32), np.zeros((len(WIDTHS), FILTERS), np.int64)
            for w, width in enumerate(WIDTHS):
                n = len(x) - width + 1
                if n > 0:
                    y = sum(x[j : j + n] @ filters[w][j] for j in range(width))
                    at[w] = y.argmax(0)
                    top[w] = np.maximum(0, y[at[w], np.arange(FILTERS)] + m.bias[w])
            p = 1 / (1 + np.exp(-np.clip(top.ravel() @ m.out + m.out_bias, -30, 30)))
            g = p - labels[i]
            if abs(g) < 1e-3:
                continue
            down = (g * m.out).reshape(top.shape) * (top > 0)
            step = np.r_[g * top.ravel(), g]
            grown_o += step * step
            step = RATE * step / np.sqrt(grown_o)
            m.out -= step[:-1].astype(np.float32)
            m.out_bias -= float(step[-1])
            grown_b += down * down
            m.bias -= RATE * down / np.sqrt(grown_b)
            for w, width in enumerate(WIDTHS):
                for c in np.flatnonzero(down[w]):
                    words = slice(at[w, c], at[w, c] + width)
                    own = x[words] * down[w, c]
                    back = filters[w][:, :, c] * down[w, c]
                    grown_f[w][:, :, c] += own * own
                    filters[w][:, :, c] -= RATE * own / np.sqrt(grown_f[w][:, :, c])
                    for j in range(width):
                        b = f[at[w, c] + j]
                        grown_e[b] += (back[j] ** 2).mean()
                        e[b] -= RATE * back[j] / np.sqrt(grown_e[b])[:, None]
    return m


def _threshold(margin: np.ndarray, y: np.ndarray) -> float:
    """The cut of highest F1, in the middle of the gap around it."""
    order = np.argsort(-margin, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(f1.argmax())
    below = margin[order[k + 1]] if k + 1 < len(y) else margin[order[k]] - 1
    return float((margin[order[k]] + below) / 2)


def calibrate(m: Model, docs: list[np.ndarray], labels: np.ndarray, langs: list[str | None], known: list[np.ndarray], known_langs: list[str | None], least: int = 15) -> None:
    """Thresholds by guessed language from held texts; tongues from the known ones."""
    names = sorted({x for x in known_langs if x is not None})
    if len(names) > 1:
        seen = np.full((LANGUAGE_BUCKETS, len(names)), 0.1)
        for f, x in zip(known, known_langs):
            if x is not None:
                np.add.at(seen[:, names.index(x)], f[:, 0] % LANGUAGE_BUCKETS, 1)
        m.tongues = np.log(seen / seen.sum(0)).astype(np.float32)
    first = np.cumsum([0, *map(len, docs)])
    flat = np.concatenate(docs)
    margin = m.pooled(flat, first) @ m.out + m.out_bias
    guess = m.tongue(flat, first)
    shared = _threshold(margin, labels) if labels.any() else 0.0
    m.thresholds = np.full(max(1, len(names)), shared)
    for k in range(len(names)):
        own = guess == k
        if least <= labels[own].sum() < own.sum():
            m.thresholds[k] = _threshold(margin[own], labels[own])
    z = margin - m.thresholds[guess]
    m.slope = 1.0
    for _ in range(50):  # Newton steps on the log-likelihood of one slope, with some weight on 1
        p = 1 / (1 + np.exp(-np.clip(m.slope * z, -30, 30)))
        m.slope = float(np.clip(m.slope - ((z * (p - labels)).sum() + (m.slope - 1)) / ((z * z * p * (1 - p)).sum() + 1), 0.2, 5))


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES, text: int = SAMPLE_TEXT) -> DataFrame:
    """text, lang, toxic of labelled rows outside the held-out fifth: the first by draw, up to `rows` rows and `size` bytes.

    Texts of more than `text` bytes are left out before both bounds; contradictory labels of one
    doc_id are all learned.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
    own = own.filter(~held_out(F.col("doc_id"), 5, 0)).distinct()
    short = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    short = short.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= text)
    draw = F.xxhash64(F.col("doc_id"), F.lit(11))
    # Numbers alone first: ids of short texts that have a label; then the texts of the first of them.
    chosen = own.join(short.select("doc_id"), "doc_id", "left_semi").withColumn("draw", draw).orderBy("draw", "doc_id", "toxic").limit(rows)
    found = short.join(F.broadcast(chosen), "doc_id")  # at most `rows` rows of numbers
    so_far = Window.orderBy("draw", "doc_id", "toxic", F.xxhash64("text"))
    return found.orderBy("draw", "doc_id", "toxic").limit(rows).withColumn("bytes", F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(so_far)).filter(F.col("bytes") <= size).select("text", "lang", "toxic")


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    found = sample(docs, labels).toArrow()
    y = found["toxic"].to_numpy().astype(float)
    if len(set(y)) < 2:
        return None
    features = []
    for chunk in found["text"].chunks:
        for b in blocks(chunk):
            own = word_features(b)
            features += [own[i:j] for i, j in zip(b.first, b.first[1:])]
    langs = found["lang"].to_pylist()
    del found
    cut = max(1, len(y) * 7 // 10)
    m = train(features[:cut], y[:cut]) if len(set(y[:cut])) == 2 and len(y) > 20 else train(features, y)
    calibrate(m, features[cut:], y[cut:], langs[cut:], features[:cut], langs[:cut])
    return m


def score(docs: DataFrame, model: Model | None, *keep: str) -> DataFrame:
    """The columns `keep` and score (0 to 1; 0.5 is the threshold): one row per row of docs."""
    names = [f"keep_{i}" for i in range(len(keep))]
    kinds = [docs.schema[c].dataType.simpleString() for c in keep]
    if model is not None:
        model.embedding = model.embedding.astype(np.float16)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS * DIMENSIONS numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            parts = [np.zeros(0)]
            for b in blocks(batch.column("text_to_scan")):
                parts.append(m.score(word_features(b), b.first) if m else np.zeros(b.hi - b.lo))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(np.concatenate(parts).astype(float))], names=[*names, "score"])

    rows = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names)), F.col("text").cast("string").alias("text_to_scan"))
    out = rows.mapInArrow(run, ", ".join([*(f"{n} {k}" for n, k in zip(names, kinds)), "score double"]))
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, keep)), "score")
