"""The driver's tables in the roles of an entity-resolution run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalized
from ..operators.containment import contained
from ..storage import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows  # long texts: work on them is worth a shuffle


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as products; the title is the first line."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("product_id"), F.col("doc_id").alias("ordinal"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("lang").alias("manufacturer"), F.col("text").alias("description"), F.lit(None).cast("double").alias("price"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(
        F.concat(F.lit("b"), F.col("item_id")).alias("product_id"), F.col("item_id").alias("ordinal"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.lit("").alias("manufacturer"), F.col("text").alias("description"), F.lit(None).cast("double").alias("price"),
    )


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """google_id, amazon_id: a document that contains a benchmark item."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("google_id"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id")).alias("amazon_id"), "text")
    return contained(docs, items, "google_id", "amazon_id")


def queries_and_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The stated queries (ids divisible by 100) and all rows."""
    e = table(spark, sf_dir, "embeddings")
    return (
        e.filter("vec_id % 100 = 0").select(F.col("vec_id").cast("string").alias("google_id"), "embedding", "label"),
        e.select(F.col("vec_id").cast("string").alias("amazon_id"), F.col("vec_id").alias("ordinal"), "embedding", "label"),
    )


def vector_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query and another vector of the same label at most 40 ids away."""
    q, c = queries_and_vectors(spark, sf_dir)
    near = c.select("amazon_id", F.col("label").alias("other"), F.explode(F.sequence(F.col("ordinal") - 40, F.col("ordinal") + 40)).alias("google_id"))
    return near.withColumn("google_id", F.col("google_id").cast("string")).join(q.select("google_id", "label"), "google_id").filter("label = other AND google_id <> amazon_id").select("google_id", "amazon_id")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as listings with a score."""
    d, y = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    pair = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return d.join(y, "doc_id").select(
        "doc_id", ((F.col("n_chars") * 7919 + F.col("doc_id") * 104729) % 1001 / 1000.0).alias("score"), F.col("quality").alias("label"), F.md5(normalized(F.col("text"))).alias("group_id"),
        (F.col("quality") == 1).alias("has_gold_listing"), pair.alias("is_gold_pair"), (pair | (F.col("doc_id") % 7 != 0)).alias("gold_retrieved"),
    )


def shop_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as products with makers and prices, some of them missing."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    return p.select(
        F.concat(F.lit("p"), k).alias("product_id"), k.cast("long").alias("ordinal"), F.concat_ws(" ", "p_name", F.lower("p_type"), F.concat(F.lit("m"), k, F.lit("-"), "p_size")).alias("title"),
        F.when(k % 7 == 0, "").otherwise(F.col("p_brand")).alias("manufacturer"), F.when(k % 11 == 0, "").otherwise(F.concat_ws(" ", "p_type", "p_name", F.lit("of size"), "p_size")).alias("description"),
        F.when(k % 13 != 0, F.col("p_retailprice")).alias("price"),
    )


def shop_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same parts as another shop writes them."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    tail = F.when(k % 3 == 0, F.lit(" new")).otherwise(F.concat(F.lit("-"), "p_size"))
    return p.select(
        F.concat(F.lit("g"), k).alias("product_id"), k.cast("long").alias("ordinal"), F.concat(F.upper("p_name"), F.lit("  m"), k, tail).alias("title"),
        F.when(k % 4 != 0, F.lower("p_brand")).alias("manufacturer"), F.when(k % 5 != 0, F.col("p_name")).alias("description"), F.when(k % 6 != 0, F.col("p_retailprice") * 1.05).alias("price"),
    )


def shop_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each listing with its own part and the next one, with scores and ranks as a search would give them."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(k, "p_size", F.explode(F.array(F.lit(0), F.lit(1))).alias("step"))
    last = table(spark, sf_dir, "part").agg(F.max("p_partkey").alias("last"))
    item = F.least(k + F.col("step"), F.col("last"))
    return p.crossJoin(F.broadcast(last)).select(  # one row
        F.concat(F.lit("g"), k).alias("google_id"), F.concat(F.lit("p"), item).alias("amazon_id"), "step",
        F.when(k % 9 != 0, F.col("p_size") / 64).alias("lexical_score"), F.when(k % 8 != 0, F.col("p_size") / 50 - 0.25).alias("dense_score"),
        F.when(k % 3 != 0, k % 5 + 1).cast("int").alias("lexical_rank"), F.when(k % 4 != 0, k % 7 + 1).cast("int").alias("dense_rank"),
    )
