"""Exact dedup with a split for heavy hitters, in DataFrame operations only.

Frequent digests come from a Misra-Gries sketch (Spark's approx_top_k keeps such counters and merges
them across tasks). Their exact sizes and winners are counted, at most `hot` rows, and broadcast:
rows of huge groups are resolved where they are read. All other digests are shuffled.

Defined results: null text counts as empty, and all empty texts are one group; a null doc_id loses
to any other, and a group of null ids has a null keep_id and keeps its rows; rows that share the
largest doc_id of a group are the same row, and all are marked kept. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text) -> F.Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


def exact_groups(docs: DataFrame, hot: int = 1024, counters: int = 4096) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of docs.

    `counters` bounds the sketch; every digest of more than about 1/counters of the rows is in it,
    and the `hot` most frequent are broadcast.
    """
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(normalised(F.col("text")), 256).alias("text_sha256")), "digests")
    frequent = (
        rows.agg(F.expr(f"approx_top_k(text_sha256, {hot}, {counters})").alias("top"))
        .select(F.explode("top").alias("t"))
        .filter("t.count > 1 AND t.item IS NOT NULL")
        .select(F.col("t.item").alias("text_sha256"))
    )
    winners = (
        rows.join(F.broadcast(frequent), "text_sha256")
        .groupBy("text_sha256")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    marked = rows.join(F.broadcast(winners), "text_sha256", "left")
    left = marked.filter("group_size IS NULL").select("doc_id", "text_sha256")
    # Map-side aggregation first; a join with one row a digest can be split where a digest is frequent.
    groups = left.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    rest = left.join(groups, "text_sha256").select("doc_id", "text_sha256", "keep_id", "group_size")
    return (
        marked.filter("group_size IS NOT NULL")
        .select("doc_id", "text_sha256", "keep_id", "group_size")
        .unionByName(rest)
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    )


ORACLE = f"""
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""
