"""Which of a set of phrases each text contains: one automaton over all phrases, one pass over each text."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalized

#: Characters of phrases in one automaton; more phrases take more passes.
PASS_CHARACTERS = 32 << 20


def contained(docs: DataFrame, phrases: DataFrame, doc_key: str, phrase_key: str, text: str = "text") -> DataFrame:
    """doc_key, phrase_key for each phrase (normalised, not empty) inside a normalised text."""
    spark = docs.sparkSession
    kinds = docs.schema[doc_key].dataType.simpleString(), phrases.schema[phrase_key].dataType.simpleString()
    rows = docs.select(F.col(doc_key).alias("d"), normalized(F.col(text)).alias("t"))
    out, held, size = None, {}, 0

    def one_pass(held: dict[str, list]) -> DataFrame:
        shared = spark.sparkContext.broadcast(held)  # PASS_CHARACTERS and one phrase at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not shared.value:
                return
            own = ahocorasick.Automaton()
            for phrase, keys in shared.value.items():
                own.add_word(phrase, keys)
            own.make_automaton()
            for batch in batches:
                ds, ps = [], []
                for d, t in zip(batch.column("d").to_pylist(), batch.column("t").to_pylist()):
                    for key in sorted({k for _, keys in own.iter(t) for k in keys}):
                        ds.append(d)
                        ps.append(key)
                if ds:
                    yield pa.RecordBatch.from_arrays([pa.array(ds, batch.schema.field("d").type), pa.array(ps)], names=["d", "p"])

        return rows.mapInArrow(run, f"d {kinds[0]}, p {kinds[1]}")

    def add(part):
        nonlocal out
        out = part if out is None else out.unionByName(part)

    for r in phrases.select(F.col(phrase_key).alias("k"), normalized(F.col(text)).alias("t")).filter("t <> ''").toLocalIterator():
        held.setdefault(r.t, []).append(r.k)
        size += len(r.t)
        if size > PASS_CHARACTERS:
            add(one_pass(held))
            held, size = {}, 0
    if held or out is None:
        add(one_pass(held))
    return out.select(F.col("d").alias(doc_key), F.col("p").alias(phrase_key))
