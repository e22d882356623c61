"""Leakage-safe splits: whole components go to train, validation or test."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import parse_boolean
from ..storage import cut
from .duplicates import component_labels, duplicate_groups, entity_components

SPLITS = ("train", "validation", "test")
COLUMNS = ("google_id", "component_id", "split", "duplicate_group_id", "duplicate_group_size", "ambiguous_label")


def target_counts(total: int, ratios: tuple[float, ...]) -> list[int]:
    """Whole shares of total; what rounding leaves goes to the largest fractions, the first on ties."""
    exact = [r * total for r in ratios]
    whole = [math.floor(x) for x in exact]
    by_fraction = sorted(range(len(exact)), key=lambda i: whole[i] - exact[i])
    for i in by_fraction[: total - sum(whole)]:
        whole[i] += 1
    return whole


def check_ratios(ratios: tuple[float, ...]) -> None:
    if len(ratios) != len(SPLITS) or min(ratios) < 0:
        raise ValueError("three ratios are needed, none below zero")
    if abs(sum(ratios) - 1) > 1e-9:
        raise ValueError("the ratios of all splits together must be 1")


def deal_components(sizes: DataFrame, seed: int, ratios: tuple[float, ...]) -> DataFrame:
    """component_id, split. sizes: component_id, n.

    Each component in seeded order goes where most is missing. The order is sequential by
    definition and needs the sizes alone: one number a component, streamed to the driver.
    """
    rows = sizes.orderBy("component_id").select("component_id", "n").toPandas()
    missing = np.array(target_counts(int(rows.n.sum()), ratios))
    place = np.empty(len(rows), int)
    n = rows.n.to_numpy()
    for i in np.random.default_rng(seed).permutation(len(rows)):
        place[i] = missing.argmax()
        missing[place[i]] -= n[i]
    rows["split"] = [SPLITS[p] for p in place]
    return sizes.sparkSession.createDataFrame(rows[["component_id", "split"]], "component_id string, split string")


def entity_splits(listings: DataFrame, gold: DataFrame, seed: int = 42, ratios: tuple[float, ...] = (0.70, 0.15, 0.15)) -> DataFrame:
    """The split assignment of every listing id: COLUMNS."""
    check_ratios(ratios)
    groups = cut(duplicate_groups(listings, gold), "groups")
    labelled = cut(component_labels(entity_components(groups, gold)), "components")
    dealt = deal_components(labelled.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")), seed, ratios)
    return labelled.join(dealt, "component_id").join(groups, "google_id").select(*COLUMNS)


def canonical(assignments: DataFrame) -> DataFrame:
    """Typed, checked and without nulls or blanks; raises on what cannot be repaired."""
    gone = [c for c in COLUMNS if c not in assignments.columns]
    if gone:
        raise ValueError(f"assignments lack columns: {gone}")

    def filled(c: str):
        text = F.trim(F.col(c).cast("string"))
        return F.when(F.coalesce(text, F.lit("")) == "", F.raise_error(F.lit(f"{c} must not be missing or blank"))).otherwise(text)

    split = F.lower(filled("split"))
    size = F.col("duplicate_group_size").cast("double")
    whole = (size >= 1) & (size == F.floor(size))
    return assignments.select(
        filled("google_id").alias("google_id"),
        filled("component_id").alias("component_id"),
        F.when(split.isin(*SPLITS), split).otherwise(F.raise_error(F.concat(F.lit("unknown split: "), split))).alias("split"),
        filled("duplicate_group_id").alias("duplicate_group_id"),
        F.when(F.coalesce(whole, F.lit(False)), size.cast("long")).otherwise(F.raise_error(F.lit("duplicate_group_size must be a positive whole number")).cast("long")).alias("duplicate_group_size"),
        parse_boolean(F.col("ambiguous_label")).alias("ambiguous_label"),
    )


def isolation_violations(assignments: DataFrame) -> DataFrame:
    """kind, key, splits: components and duplicate groups that lie in more than one split."""
    out = None
    for kind, key in (("component", "component_id"), ("duplicate_group", "duplicate_group_id")):
        bad = assignments.groupBy(F.col(key).alias("key")).agg(F.countDistinct("split").alias("splits")).filter("splits > 1").select(F.lit(kind).alias("kind"), "key", "splits")
        out = bad if out is None else out.unionByName(bad)
    return out


def validate_ids(frame: DataFrame, ids: DataFrame, column: str = "google_id") -> None:
    """Raises unless column is unique, trimmed and holds exactly the values of ids' first column."""
    own, other = frame.select(F.col(column).alias("id")), ids.select(F.col(ids.columns[0]).alias("id"))
    for part in (own, other):
        if not part.groupBy("id").count().filter("count > 1").isEmpty():
            raise ValueError(f"{column} must be unique")
        if not part.filter("id IS NULL OR id <> trim(id) OR id = ''").isEmpty():
            raise ValueError(f"{column} must be normalized")
    missing, extra = other.exceptAll(own).count(), own.exceptAll(other).count()
    if missing or extra:
        raise ValueError(f"{column} does not match: missing={missing}, extra={extra}")


def validate(assignments: DataFrame, ids: DataFrame) -> None:
    validate_ids(assignments, ids)
    if not isolation_violations(assignments).isEmpty():
        raise ValueError("a component or duplicate group lies in more than one split")


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    columns = sorted(left.columns)
    if columns != sorted(right.columns):
        return False
    left, right = left.select(*columns), right.select(*columns)
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def rows_by_split(assignments: DataFrame) -> DataFrame:
    """split, n for all three splits, 0 where one is empty."""
    names = assignments.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    return names.join(assignments.groupBy("split").agg(F.count(F.lit(1)).alias("n")), "split", "left").select("split", F.coalesce("n", F.lit(0)).alias("n"))


def csv_lines(assignments: DataFrame) -> DataFrame:
    """google_id, line: the canonical rows as CSV lines, quoted only where needed; Booleans are True and False."""

    def cell(c: str):
        text = F.when(F.col(c), "True").otherwise("False") if c == "ambiguous_label" else F.col(c).cast("string")
        return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return canonical(assignments).select("google_id", F.concat_ws(",", *map(cell, COLUMNS)).alias("line"))


def digest(assignments: DataFrame) -> DataFrame:
    """rows, digest: SHA-256 of the canonical CSV (header, then rows by google_id), which is sequential.

    Spark sorts by range; the driver then reads one partition after the other and keeps a hash state
    alone.
    """
    whole, rows = hashlib.sha256((",".join(COLUMNS) + "\n").encode()), 0
    for r in csv_lines(assignments).orderBy("google_id").select("line").toLocalIterator():
        whole.update(r.line.encode() + b"\n")
        rows += 1
    return assignments.sparkSession.createDataFrame([(rows, whole.hexdigest())], "rows long, digest string")


def pick(listings: DataFrame, assignments: DataFrame, split: str, key: str = "product_id") -> DataFrame:
    """The listings of one split; one without any split raises when rows are computed."""
    if split not in SPLITS:
        raise ValueError(f"unknown split: {split}")
    lost = F.raise_error(F.concat(F.lit("no split for listing "), F.col(key))).cast("string")
    own = listings.join(assignments.select(F.col("google_id").alias(key), F.col("split").alias("_split")), key, "left")
    return own.filter(F.coalesce("_split", lost) == split).select(*listings.columns)


def training_summary(assignments: DataFrame, gold: DataFrame, training: DataFrame) -> DataFrame:
    """split, listings, gold_pairs, ambiguous_rows, training_pairs, training_positives of each split.

    training: google_id, label of the pairs a matcher learns from; other splits than train have none.
    """
    of = assignments.select("google_id", "split", "ambiguous_label")
    parts = [
        of.select("split", F.lit(1).alias("listings"), F.col("ambiguous_label").cast("int").alias("ambiguous_rows")),
        gold.distinct().join(of, "google_id").select("split", F.lit(1).alias("gold_pairs")),
        training.join(of, "google_id").select("split", F.lit(1).alias("training_pairs"), F.col("label").cast("int").alias("training_positives")),
    ]
    rows = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    names = assignments.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    counts = ("listings", "gold_pairs", "ambiguous_rows", "training_pairs", "training_positives")
    sums = rows.groupBy("split").agg(*(F.sum(c).alias(c) for c in counts))
    return names.join(sums, "split", "left").select("split", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts))
