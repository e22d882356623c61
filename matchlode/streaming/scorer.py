"""Decisions for a stream of listings: each micro-batch is scored against the frozen run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.pipeline import Encoder, hashing_encoder, score_listings


def score_stream(listings: DataFrame, folder: str, output: str, checkpoint: str, encoder: Encoder = hashing_encoder, **trigger) -> StreamingQuery:
    """Writes score_listings of every micro-batch below output, by batch id: a batch that is run again replaces its own rows."""

    def one(batch: DataFrame, number: int) -> None:
        score_listings(batch, folder, encoder).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return listings.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
