"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

N-grams of 1 to 3 code points of the lower-cased text are hashed to DIMENSIONS features, weighted
(1 + ln count) * idf and scaled to length 1. Document frequencies cover all rows to learn from; the
weights are fitted on a bounded sample of them (SAMPLE_ROWS) by follow-the-regularised-leader with
an elastic net, and a temperature, fitted on the sample's last fifth, calibrates the scores.

Defined results: a null text or one without a letter is `und` with score 0; without any row to learn
from everything is `und`. Repeated rows get equal results. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import mix

UNKNOWN = "und"
ORDERS = (1, 2, 3)
DIMENSIONS = 1 << 14
#: The most rows that weights are fitted on: the first of each label by a hash of doc_id. Half of them are
#: shared out by the labels' frequencies, half evenly, so that rare languages are learned too.
SAMPLE_ROWS = 4000
#: The most languages that are learned: the most frequent labels.
LANGUAGES = 256
#: FTRL-proximal: step, its softening, and the elastic net's two penalties.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.05, 2
_LETTER = regex.compile(r"\p{L}")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and how often each occurs."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    total, gram = np.zeros(DIMENSIONS, np.int64), np.zeros(len(points), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(points) < n:
            break
        gram = gram[: len(points) - n + 1] * _BASE + points[n - 1 :]
        if n in ORDERS:
            total += np.bincount((mix(gram + np.uint64(n)) % np.uint64(DIMENSIONS)).astype(np.int64), minlength=DIMENSIONS)
    at = np.flatnonzero(total)
    return at, total[at]


def vector(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(n)) * idf[at]
    return x / max(np.sqrt((x * x).sum()), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features, and a constant last, by languages
    temperature: float = 1.0

    def margins(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return vector(at, n, self.idf) @ self.weights[at] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not _LETTER.search(text):
            return UNKNOWN, 0.0
        p = softmax(self.margins(*counts(text)) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def fit_weights(rows: list[tuple[np.ndarray, np.ndarray, int]], idf: np.ndarray, k: int, epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-proximal; each example touches only its own features."""
    z, s = np.zeros((DIMENSIONS + 1, k)), np.zeros((DIMENSIONS + 1, k))

    def weights(at):
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(s[at])) / ALPHA + L2)

    for _ in range(epochs):
        for at, n, label in rows:
            own, x = np.r_[at, DIMENSIONS], np.r_[vector(at, n, idf), 1.0]
            w = weights(own)
            p = softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p
            s_new = s[own] + g * g
            z[own] += g - (np.sqrt(s_new) - np.sqrt(s[own])) / ALPHA * w
            s[own] = s_new
    return weights(slice(None))


def fit_temperature(margins: np.ndarray, labels: np.ndarray) -> float:
    """The scale that makes held margins likeliest, by golden-section search over its logarithm."""
    if not len(labels):
        return 1.0
    loss = lambda u: -np.log(softmax(margins / np.exp(u))[np.arange(len(labels)), labels] + 1e-12).mean()
    a, b, g = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))



def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's document frequencies; feature -1 has the number of texts."""
    df, n = np.zeros(DIMENSIONS, np.int64), 0
    for batch in batches:
        for text in batch.column("text").to_pylist():
            df[counts(text)[0]] += 1
            n += 1
    if n:
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at].astype(np.int32)), pa.array(np.r_[n, df[at]])], names=["feature", "n"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [counts(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("draw", "id", "label")), pa.array([a.astype(np.int16).tobytes() for a, _ in found], pa.binary()), pa.array([n.astype(np.uint32).tobytes() for _, n in found], pa.binary())],
            names=["draw", "id", "label", "at", "n"],
        )


def fit(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """rows: id, text, label. Collects DIMENSIONS sums and the features of at most sample_rows rows."""
    rows = rows.filter("text <> '' AND label IS NOT NULL").select(F.col("id"), F.col("text").cast("string").alias("text"), F.col("label").cast("string").alias("label"))
    df = np.zeros(DIMENSIONS)
    sums = rows.select("text").mapInArrow(_frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    texts = int(sums.n[sums.feature == -1].sum())
    sums = sums[sums.feature >= 0]
    df[sums.feature] = sums.n
    idf = np.log((1 + texts) / (1 + df)) + 1
    labels = rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(LANGUAGES).collect()  # LANGUAGES rows at most
    whole = sum(r["count"] for r in labels)
    quota = [(r.label, -(-sample_rows * (len(labels) * r["count"] + whole) // (2 * whole * len(labels))), r["count"]) for r in labels]
    share = rows.sparkSession.createDataFrame([(label, n, min(1.0, 1.5 * n / count + 64 / count)) for label, n, count in quota], "label string, most long, share double")
    draw = F.xxhash64(F.col("id"), F.lit(7))
    # Numbers alone first: a little more than each label's part by the draw's value, then its first rows.
    near = rows.select("id", "label", draw.alias("draw")).join(F.broadcast(share), "label").filter(F.pmod("draw", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    first = F.row_number().over(Window.partitionBy("label").orderBy("draw", "id"))
    chosen = near.withColumn("n", first).filter("n <= most").select("id", "draw", "label").distinct()
    texts = rows.join(F.broadcast(chosen), ["id", "label"]).select("draw", "id", "text", "label")
    sample = texts.mapInArrow(_features, "draw long, id long, label string, at binary, n binary").orderBy("draw", "id", "label", F.xxhash64("at", "n")).limit(sample_rows + LANGUAGES).toPandas()
    languages = sorted(sample.label.unique())
    examples = [(np.frombuffer(a, np.int16).astype(np.int64), np.frombuffer(n, np.uint32).astype(np.float64), languages.index(y)) for a, n, y in zip(sample["at"], sample.n, sample.label)]
    examples = [examples[i] for i in np.random.default_rng(5).permutation(len(examples))]
    held = examples[len(examples) * 4 // 5 :]
    model = Model(languages, idf, fit_weights(examples[: len(examples) * 4 // 5] or examples, idf, max(1, len(languages))))
    if held and len(languages) > 1:
        model.temperature = fit_temperature(np.stack([model.margins(a, n) for a, n, _ in held]), np.array([y for *_, y in held]))
    return model


def predict(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns `keep`, lang_pred, score: one row per row of docs."""
    names = [f"keep_{i}" for i in range(len(keep))]
    kinds = [docs.schema[c].dataType.simpleString() for c in keep]
    model = Model(model.languages, model.idf.astype(np.float32), model.weights.astype(np.float32), model.temperature)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in batch.column("text_to_scan").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], names=[*names, "lang_pred", "score"]
            )

    rows = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names)), F.col("text").cast("string").alias("text_to_scan"))
    out = rows.mapInArrow(run, ", ".join([*(f"{n} {k}" for n, k in zip(names, kinds)), "lang_pred string, score double"]))
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, keep)), "lang_pred", "score")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of doc_id as text leaves the remainder `fold`; never for a null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def identify(docs: DataFrame, *keep: str) -> DataFrame:
    """predict with a model of the rows of docs whose crc32(doc_id) modulo 3 is not 1; held_out marks the others."""
    known = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 3, 1))
    model = fit(known.select(F.col("doc_id").cast("long").alias("id"), "text", F.col("lang").alias("label")))
    rows = docs.select(F.struct(*keep).alias("row"), held_out(F.col("doc_id"), 3, 1).alias("held_out"), "text")
    return predict(rows, model, "row", "held_out").select("row.*", "held_out", "lang_pred", "score")
