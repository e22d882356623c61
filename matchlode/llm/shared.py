"""Tables of the registered queries, and the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..storage import cut, freeing, new_folder, shared_dir, spread

__all__ = ["cut", "documents", "freeing", "new_folder", "shared_dir"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
