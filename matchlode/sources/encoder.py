"""Sentence encoders: a pinned model that every Python worker loads once and feeds with Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_loaded: dict[SentenceEncoder, Any] = {}


def sentence_transformer(encoder: SentenceEncoder) -> Any:
    """The pinned revision from the local cache; from its source only if that is allowed and the cache lacks it."""
    from sentence_transformers import SentenceTransformer  # optional: only this loader needs it

    options = {"revision": encoder.revision, "cache_folder": encoder.cache, "device": encoder.device}
    failed = None
    for local in [True] if encoder.local_only else [True, False]:
        try:
            return SentenceTransformer(encoder.model, local_files_only=local, **options)
        except (OSError, ValueError) as error:
            failed = error
    raise RuntimeError(f"{encoder.model} at {encoder.revision} is not at hand{' locally' if encoder.local_only else ''}") from failed


@dataclass(frozen=True)
class SentenceEncoder:
    """An encoder for plans.pipeline: key, text to key, embedding (unit vectors of float).

    local_only: never fetch; evaluations of a frozen run use it. load: makes the model, which has
    encode(list of texts, batch_size, normalize_embeddings, ...) as sentence-transformers have it.
    """

    model: str
    revision: str
    local_only: bool = False
    batch_size: int = 64
    cache: str | None = None
    device: str | None = None
    load: Callable[[SentenceEncoder], Any] = sentence_transformer

    def __post_init__(self):
        if not str(self.model).strip() or not str(self.revision).strip():
            raise ValueError("an encoder needs a model and a revision")
        if self.batch_size < 1:
            raise ValueError("batches hold one text at least")

    def identity(self) -> dict[str, str]:
        return {"model": self.model, "revision": self.revision}

    def __call__(self, texts: DataFrame) -> DataFrame:
        kind = texts.schema["key"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if self not in _loaded:
                _loaded[self] = self.load(self)
            for batch in batches:
                for lo in range(0, batch.num_rows, self.batch_size):
                    part = batch.slice(lo, self.batch_size)
                    own = [t or "" for t in part.column("text").to_pylist()]
                    found = np.asarray(_loaded[self].encode(own, batch_size=self.batch_size, show_progress_bar=False, convert_to_numpy=True, normalize_embeddings=True), np.float32)
                    if found.ndim != 2 or len(found) != len(own):
                        raise ValueError("the encoder did not give a vector a text")
                    offsets = pa.array(np.arange(len(own) + 1) * found.shape[1], pa.int32())
                    yield pa.RecordBatch.from_arrays([part.column("key"), pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))], names=["key", "embedding"])

        return texts.select("key", "text").mapInArrow(run, f"key {kind}, embedding array<float>")


def identity(encoder: Any) -> dict[str, str]:
    """What a frozen run keeps of its encoder."""
    own = getattr(encoder, "identity", None)
    return own() if callable(own) else {"model": f"{encoder.__module__}.{encoder.__qualname__}", "revision": ""}
