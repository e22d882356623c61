"""Mixing of sources to target weights by capped water-filling, in DataFrame operations only.

The level that fills all sources is found in closed form: sources in order of cap / weight, running
sums of caps and weights, and the first source whose cap lies above the level of those that are
left. Each source then takes every document a whole number of times, and the fraction that is left
in seeded random order. That order is dealt into buckets, so that no source is sorted in one task.

Defined results: null text has size 0; a null source is a source of its own, ordered last; a source
of size 0 has target 0; rows with null doc_id are drawn by their text; documents without words take 0 words; rows of equal doc_id and size are
interchangeable; without any words all targets are 0. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

WORDS = r"[^\x20\x09-\x0D]+"
#: Buckets of a source's random order: hexadecimal digits of the draw.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sources: DataFrame, max_epochs: float = 3.0) -> DataFrame:
    """source, source_size, target of each row (source, source_size); weights 1, 2, 3, repeating."""
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_level = Window.orderBy("level", "place")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    placed = sources.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weighed = placed.withColumn("weight", (F.col("place") - 1) % 3 + 1).withColumn("cap", F.col("source_size") * F.lit(max_epochs))
    levelled = weighed.withColumn("level", F.col("cap") / F.col("weight"))
    filled = levelled.withColumn(
        "fill",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after),
    ).withColumn("open", F.col("level") > F.col("fill"))
    reached = filled.withColumn("fill", F.first(F.when(F.col("open"), F.col("fill")), ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    full = F.col("fill").isNull() | (F.col("level") <= F.col("fill"))
    return reached.select("source", "source_size", F.when(full, F.col("cap")).otherwise(F.col("fill") * F.col("weight")).cast("double").alias("target"))


def mix_sources(docs: DataFrame, max_epochs: float = 3.0, seed: int = 42, key: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row per row of docs.

    copies is how often the mix takes the document, taken its words with repeats. A source's taken
    words differ from its target by at most half of one of its documents. A column named as key tells rows
    of equal doc_id and size apart and comes last.
    """
    own = [] if key is None else ["row_key"]
    rows = cut(
        docs.select(
            *(F.col(key).alias(n) for n in own), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
            F.when(F.col("doc_id").isNull(), F.xxhash64(F.col("text").cast("string"), *(F.col(key) for _ in own))).alias("salt"),
        ),
        "sizes",
    )
    rows = rows.withColumn("draw", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), "salt")))))
    rows = rows.withColumn("bucket", F.substring("draw", 1, BUCKET_DIGITS))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    totals = targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), max_epochs)
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("ahead", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)))
    plan = buckets.alias("b").join(totals.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.source", "b.bucket", "ahead", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("draw", "doc_id", "size", *own).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.bucket") == F.col("p.bucket")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    left = F.col("target") - F.col("whole") * F.col("source_size")
    return (
        joined.select(*own, "doc_id", F.col("r.source").alias("source"), "size", "source_size", "target", "ahead", "before", whole.cast("long").alias("whole"))
        .withColumn("copies", F.col("whole") + (F.col("ahead") + F.col("before") + F.col("size") / 2 < left).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), *(F.col(n).alias(key) for n in own))
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('42:' || doc_id) AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
l AS (SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / weight AS level FROM w),
f AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY level, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(weight) OVER (ORDER BY level, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS fill FROM l),
v AS (SELECT min_by(fill, level) AS fill FROM f WHERE level > fill),
t AS (SELECT source, source_size, CASE WHEN v.fill IS NULL OR level <= v.fill THEN cap ELSE v.fill * weight END AS target FROM f, v),
r AS (SELECT d.doc_id, d.source, size, source_size, target, floor(target / nullif(source_size, 0)) AS whole,
  sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, coalesce(whole, 0)::BIGINT + (ahead + size / 2.0::DOUBLE < target - coalesce(whole, 0) * source_size)::INT AS copies FROM r)
SELECT doc_id, source, size, source_size, target, copies::BIGINT AS copies, (size * copies)::BIGINT AS taken FROM c
"""
