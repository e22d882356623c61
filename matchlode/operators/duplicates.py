"""Exact duplicate groups of listings, and labels that contradict each other inside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_id, duplicate_group_id, duplicate_signature
from ..storage import cut
from .components import connected_components


def first_rows(frame: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The row of lowest ordinal for each key."""
    others = [c for c in frame.columns if c != key]
    picked = frame.groupBy(key).agg(F.min_by(F.struct(*others), F.col(ordinal)).alias("_row"))
    return picked.select(*(F.col(key) if c == key else F.col("_row").getField(c).alias(c) for c in frame.columns))


def signatures(listings: DataFrame) -> DataFrame:
    """google_id, duplicate_group_id: one row for each id, from its first row."""
    own = listings.select(
        clean_id(F.col("product_id")).alias("google_id"),
        duplicate_group_id(duplicate_signature(F.col("title"), F.col("manufacturer"), F.col("description"), F.col("price"))).alias("duplicate_group_id"),
        "ordinal",
    )
    return first_rows(own, "google_id", "ordinal").drop("ordinal")


def duplicate_groups(listings: DataFrame, gold: DataFrame) -> DataFrame:
    """google_id, duplicate_group_id, duplicate_group_size, mapped, ambiguous_label.

    An unmapped member of a group that also has a mapped member is ambiguous. Sizes come from a
    grouped count and a join, so that one huge group is counted in parts.
    """
    mapped = gold.select(clean_id(F.col("google_id")).alias("google_id")).distinct().withColumn("mapped", F.lit(True))
    own = signatures(listings).join(mapped, "google_id", "left").withColumn("mapped", F.coalesce("mapped", F.lit(False)))
    groups = own.groupBy("duplicate_group_id").agg(F.count(F.lit(1)).alias("duplicate_group_size"), F.bool_or("mapped").alias("any_mapped"))
    return own.join(groups, "duplicate_group_id").select(
        "google_id", "duplicate_group_id", "duplicate_group_size", "mapped", (F.col("any_mapped") & ~F.col("mapped")).alias("ambiguous_label")
    )


def entity_edges(groups: DataFrame, gold: DataFrame) -> DataFrame:
    """Stars from each group's least id to its members, and links of known listings to catalog ids."""
    least = groups.groupBy("duplicate_group_id").agg(F.min("google_id").alias("least"))
    stars = groups.join(least, "duplicate_group_id").filter("google_id <> least").select(F.concat(F.lit("g:"), "least").alias("a"), F.concat(F.lit("g:"), "google_id").alias("b"))
    pairs = gold.select(clean_id(F.col("google_id")).alias("google_id"), clean_id(F.col("amazon_id")).alias("amazon_id")).filter("amazon_id <> ''")
    links = pairs.join(groups.select("google_id"), "google_id", "left_semi").select(F.concat(F.lit("g:"), "google_id").alias("a"), F.concat(F.lit("a:"), "amazon_id").alias("b"))
    return stars.unionByName(links)


def entity_components(groups: DataFrame, gold: DataFrame) -> DataFrame:
    """google_id, root: the least listing id of each listing's component."""
    found = connected_components(entity_edges(groups, gold))
    tagged = groups.select("google_id", F.concat(F.lit("g:"), "google_id").alias("node"))
    own = tagged.join(found, "node", "left").select("google_id", F.coalesce("component", "node").alias("component"))
    roots = own.groupBy("component").agg(F.min("google_id").alias("root"))
    return own.join(roots, "component").select("google_id", "root")


def component_labels(components: DataFrame) -> DataFrame:
    """google_id, root, component_id: components numbered by their least member from 0.

    Numbers come from ranks inside ranges of roots plus the sizes of the ranges before, so no task
    sorts all roots.
    """
    roots = components.select("root").distinct().repartitionByRange("root").withColumn("part", F.spark_partition_id())
    roots = cut(roots, "roots")
    own = roots.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy("root")))
    sizes = own.groupBy("part").agg(F.max("n").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = sizes.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0))).select("part", "start")
    numbered = own.join(F.broadcast(starts), "part").select("root", F.format_string("component_%05d", F.col("start") + F.col("n") - 1).alias("component_id"))
    return components.join(numbered, "root").select("google_id", "root", "component_id")
