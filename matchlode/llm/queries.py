"""One registered query for each operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, language_id, mixing, oracles, toxicity
from .bpe import encode
from .exact_dedup import exact_groups
from .language_model import score_documents
from .line_dedup import remove_repeated_lines
from .media import read_audio, store_audio
from .mixing import mix_sources
from .shared import documents
from .simhash import near_duplicates
from .substring_dedup import remove_repeated_spans


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_spans(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.size("spans").cast("long").alias("n_spans"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated_lines(documents(spark, sf_dir), runs=True)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = toxicity.score(docs.withColumn("held_out", language_id.held_out(F.col("doc_id"), 5, 0)), model, "doc_id", "held_out")
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))


def language_model_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op7_language_model that SQL can express."""
    return score_documents(documents(spark, sf_dir)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def op8_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    found = encode(documents(spark, sf_dir), public_tokenizers.path(vocabulary), public_tokenizers.PATTERN, "doc_id")
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_audio(store_audio(documents(spark, sf_dir)), "doc_id", "n_bytes")
    return found.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            ";",
            F.concat(F.lit("mel16x20="), F.sha2("tensor", 256)),
            F.concat(F.lit("segments="), F.size("spans")),
            F.concat(F.lit("spans="), F.sha2(F.to_json(F.struct("spans")), 256)),
        ).alias("feature"),
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir), "doc_id")


_ALL = (
    op1_substring_dedup,
    op2_line_dedup,
    op3_toxicity,
    op4_exact_dedup,
    op5_mixing,
    op6_simhash,
    op7_language_model,
    op8_bpe,
    op9_media,
    op10_language_id,
    language_model_base,
)
QUERIES = {q.__name__: q for q in _ALL}
ORACLES: dict[str, str] = {
    "op1_substring_dedup": oracles.SUBSTRINGS,
    "op2_line_dedup": oracles.LINES,
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op5_mixing": mixing.ORACLE,
    "language_model_base": oracles.BASE_MODEL,
}
