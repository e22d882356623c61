"""Frozen runs: tables as Parquet, settings and matcher as JSON, and the checks before they are used."""

from __future__ import annotations

import json
import math
from decimal import Decimal
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import splits
from ..operators.matcher import Matcher
from ..sources.config import Config, from_mapping

TABLES = ("catalog", "vocabulary", "catalog_vectors", "assignments")


def canonical_json(value: Any) -> str:
    """Sorted keys; missing and not-a-number values as null; numbers and arrays of other libraries as plain ones."""

    def fix(v):
        if isinstance(v, dict):
            return {str(k): fix(x) for k, x in v.items()}
        if isinstance(v, np.generic) or isinstance(v, np.ndarray):
            return fix(v.item() if v.ndim == 0 else v.tolist())
        if isinstance(v, (list, tuple, set, frozenset)):
            return [fix(x) for x in (sorted(v) if isinstance(v, (set, frozenset)) else v)]
        if v is None or isinstance(v, (bool, int, str)):
            return v
        if isinstance(v, float):
            return v if math.isfinite(v) else None
        return fix(float(v)) if isinstance(v, Decimal) else str(v)

    return json.dumps(fix(value), sort_keys=True, indent=2)


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").option("lineSep", "\0").text(path)


def read_text(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path, wholetext=True).collect()
    if not rows or not rows[0].value.strip("\0"):
        raise ValueError(f"{path} is empty")
    return rows[0].value.rstrip("\0")


def split_metadata(assignments: DataFrame) -> dict[str, Any]:
    whole = splits.digest(assignments).first()
    return {"sha256": whole.digest, "row_count": whole.rows or 0, "rows_by_split": {r.split: r.n for r in splits.rows_by_split(assignments).collect()}}


def freeze(folder: str, tables: dict[str, DataFrame], matcher: Matcher, model: str, policy: dict[str, Any], config: Config, inputs: dict[str, Any]) -> None:
    """Refuses to overwrite."""
    spark = tables["catalog"].sparkSession
    for name in TABLES:
        tables[name].write.mode("errorifexists").parquet(f"{folder}/{name}")
    sizes = {"catalog_rows": spark.read.parquet(f"{folder}/catalog").count(), "vocabulary": spark.read.parquet(f"{folder}/vocabulary").count()}
    run = {"config": config.plain(), "model": model, "policy": policy, "inputs": inputs | sizes, "split_assignments": split_metadata(spark.read.parquet(f"{folder}/assignments"))}
    write_text(spark, f"{folder}/matcher.json", matcher.to_json())
    write_text(spark, f"{folder}/run.json", canonical_json(run))


def write_assignments(assignments: DataFrame, path: str) -> None:
    """Canonical assignments as CSV files in order of google_id; refuses to overwrite."""
    own = splits.canonical(assignments).withColumn("ambiguous_label", F.when(F.col("ambiguous_label"), "True").otherwise("False"))
    own.orderBy("google_id").write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def read_assignments(spark: SparkSession, path: str) -> DataFrame:
    """Assignments as write_assignments or other tools write them: ids stay text, whatever they look like."""
    cells = spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("inferSchema", False).csv(path)
    return splits.canonical(cells)


def load(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], Matcher, dict[str, Any]]:
    tables = {name: spark.read.parquet(f"{folder}/{name}") for name in TABLES}
    empty = [name for name, table in tables.items() if table.isEmpty()]
    if empty:
        raise ValueError(f"frozen tables are empty: {empty}")
    return tables, Matcher.from_json(read_text(spark, f"{folder}/matcher.json")), json.loads(read_text(spark, f"{folder}/run.json"))


def check_metadata(value: Any) -> None:
    if not isinstance(value, dict):
        raise ValueError("the frozen run has no split metadata")
    digest, rows, by = str(value.get("sha256", "")), value.get("row_count"), value.get("rows_by_split")
    if len(digest) != 64 or set(digest) - set("0123456789abcdef"):
        raise ValueError("the frozen digest is invalid")
    whole = lambda n: isinstance(n, int) and not isinstance(n, bool) and n >= 0
    if not whole(rows) or not isinstance(by, dict) or set(by) != set(splits.SPLITS) or not all(map(whole, by.values())):
        raise ValueError("the frozen split counts are invalid")
    if sum(by.values()) != rows:
        raise ValueError("the frozen split counts do not sum to the row count")


def preflight(tables: dict[str, DataFrame], matcher: Matcher, run: dict[str, Any], config: Config, features: tuple[str, ...], raw_digests: dict[str, str] | None = None, encoder: dict[str, str] | None = None) -> None:
    """Raises where a frozen run disagrees with the settings, the matcher, its tables, the raw files or the encoder."""
    check_metadata(run.get("split_assignments"))
    changed = [k for k, v in config.plain().items() if run["config"].get(k) != v]
    if changed:
        raise ValueError(f"settings differ from the frozen run: {changed}")
    if tuple(matcher.features) != tuple(features):
        raise ValueError("the matcher's features or their order differ from the frozen run")
    if tables["catalog"].count() != run["inputs"]["catalog_rows"] or tables["vocabulary"].count() != run["inputs"]["vocabulary"]:
        raise ValueError("the frozen catalog or vocabulary has another size")
    width = tables["catalog_vectors"].agg(F.min(F.size("embedding")).alias("a"), F.max(F.size("embedding")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    if width.a != width.b or width.n != run["inputs"]["catalog_rows"]:
        raise ValueError("the frozen vectors do not fit the catalog")
    if split_metadata(tables["assignments"]) != run["split_assignments"]:
        raise ValueError("the assignments differ from the frozen digest")
    if raw_digests != run["inputs"].get("raw_csv_sha256"):
        raise ValueError("raw files differ from the frozen run, or their digests are missing")
    if encoder is not None and encoder != run["inputs"].get("encoder"):
        raise ValueError("the encoder differs from that of the frozen run")


def load_config(run: dict[str, Any]) -> Config:
    return from_mapping(run["config"])
