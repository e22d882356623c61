"""A calibrated logistic matcher, fitted by distributed Newton steps for all folds at once.

Every step is one grouped aggregation of gradient and curvature sums, so the driver sees numbers per
fold and feature pair, never rows. The objective is 0.5 |w|^2 (constant included) + C * log-loss.
Folds keep groups whole. Each fold's margins on its held rows are calibrated by a sigmoid with soft
targets, and a prediction is the mean over folds.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Matcher:
    features: list[str]
    weights: list[list[float]]  # a fold: constant, then features
    slopes: list[tuple[float, float]]  # a fold: A, B of 1 / (1 + exp(A f + B))

    def margin(self, fold: int) -> Column:
        w = self.weights[fold]
        return sum((F.lit(float(x)) * F.col(c) for x, c in zip(w[1:], self.features)), F.lit(float(w[0])))

    def probability(self) -> Column:
        """The mean of the folds' calibrated probabilities, as one expression."""
        parts = [1 / (1 + F.exp(F.lit(float(a)) * self.margin(k) + F.lit(float(b)))) for k, (a, b) in enumerate(self.slopes)]
        return sum(parts, F.lit(0.0)) / len(parts)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(raw: str) -> Matcher:
        return Matcher(**json.loads(raw))


def group_folds(rows: DataFrame, folds: int, seed: int = 42) -> DataFrame:
    """group_id, fold. rows: group_id, label.

    Groups go, by positives, size and a seeded digest, to the fold with fewest positives, then fewest
    rows; those without positives to the fold with fewest rows. The order is sequential by definition; the driver sees one row a group.
    """
    groups = rows.groupBy("group_id").agg(F.sum(F.col("label").cast("long")).alias("p"), F.count(F.lit(1)).alias("n"))
    own = groups.orderBy(F.desc("p"), F.desc("n"), F.sha2(F.concat(F.lit(str(seed)), F.col("group_id").cast("string")), 256)).toArrow()
    p, n = (own.column(c).to_numpy() for c in "pn")
    if not 0 < p.sum() < n.sum():
        raise ValueError("labels must hold both classes")
    for k in range(folds, 1, -1):
        have, place = deal(p, n, k)
        both = (have[:, 0] > 0) & (have[:, 0] < have[:, 1])
        rest = have.sum(0) - have
        if both.all() and ((rest[:, 0] > 0) & (rest[:, 0] < rest[:, 1])).all():
            kind = groups.schema["group_id"].dataType.simpleString()
            return rows.sparkSession.createDataFrame(pa.table({"group_id": own.column("group_id"), "fold": place}), f"group_id {kind}, fold long")
    raise ValueError("fewer than two folds have both classes")


def deal(p: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positives and rows of each of k folds, and the fold of each group, in the groups' order (p, n: their positives and rows).

    Groups of one kind add the same each time, so the folds' turns are the merged order of what they would hold.
    """
    have, place = np.zeros((k, 2), np.int64), np.empty(len(p), np.int64)
    edges = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (n[1:] != n[:-1]), True]) if len(p) else np.zeros(1, np.int64)
    for lo, hi in zip(edges, edges[1:]):
        turn, fold = (x.ravel() for x in np.indices((hi - lo, k)))
        after = have[fold, 1] + turn * n[lo]
        place[lo:hi] = fold[np.lexsort((fold, after, have[fold, 0] + turn * p[lo]) if p[lo] else (fold, after))[: hi - lo]]
        have += np.bincount(place[lo:hi], minlength=k)[:, None] * np.array([p[lo], n[lo]])
    return have, place


def check_finite(rows: DataFrame, features: Sequence[str]) -> None:
    bad = [F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")) for c in features]
    if not rows.filter(F.greatest(*(b.cast("int") for b in bad), F.lit(0)) == 1).isEmpty():
        raise ValueError("features must be finite")


def _newton(rows: DataFrame, fold: str, x: list[Column], weight: list[tuple[Column, Column]], start: np.ndarray, penalty: float, steps: int) -> np.ndarray:
    """Minimises penalty / 2 |w|^2 + sum of weight * log-loss for each fold. weight: (target, weight) pairs of a row."""
    k, d = start.shape
    w = start.copy()
    total = sum((q for _, q in weight), F.lit(0.0))
    pull = sum((t * q for t, q in weight), F.lit(0.0))
    for _ in range(steps):
        table = F.array(*(F.array(*(F.lit(float(v)) for v in row)) for row in w))
        own = F.get(table, F.col(fold).cast("int"))
        base = rows.select(fold, total.alias("_q"), pull.alias("_t"), *(c.cast("double").alias(f"_x{i}") for i, c in enumerate(x)), own.alias("_w"))
        margin = sum((F.get("_w", F.lit(i)) * F.col(f"_x{i}") for i in range(d)), F.lit(0.0))
        base = base.withColumn("_p", 1 / (1 + F.exp(-margin)))
        g = [F.sum((F.col("_q") * F.col("_p") - F.col("_t")) * F.col(f"_x{i}")).alias(f"g{i}") for i in range(d)]
        h = [F.sum(F.col("_q") * F.col("_p") * (1 - F.col("_p")) * F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"h{i}_{j}") for i in range(d) for j in range(i, d)]
        moved = 0.0
        for r in base.groupBy(fold).agg(*g, *h).collect():  # a row a fold
            f = int(r[fold])
            hess = np.zeros((d, d))
            for i in range(d):
                for j in range(i, d):
                    hess[i, j] = hess[j, i] = r[f"h{i}_{j}"]
            step = np.linalg.solve(hess + (penalty + 1e-9) * np.eye(d), np.array([r[f"g{i}"] for i in range(d)]) + penalty * w[f])
            step *= min(1.0, 8.0 / max(1e-12, np.abs(step).max()))
            w[f] -= step
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-8:
            break
    return w


def fit(rows: DataFrame, features: Sequence[str], folds: int = 3, seed: int = 42, c: float = 1.0, steps: int = 25) -> Matcher:
    """rows: group_id, label (0 or 1) and features."""
    check_finite(rows, features)
    dealt = rows.join(group_folds(rows, folds, seed), "group_id").select("fold", "label", *features).persist()
    try:
        k = dealt.select(F.max("fold")).first()[0] + 1
        x = [F.lit(1.0), *(F.col(f) for f in features)]
        train = dealt.withColumn("held", F.col("fold")).withColumn("fold", F.explode(F.array(*(F.lit(i) for i in range(k))))).filter("fold <> held")
        w = _newton(train, "fold", x, [(F.col("label"), F.lit(float(c)))], np.zeros((k, len(x))), 1.0, steps)
        made = Matcher(list(features), w.tolist(), [(-1.0, 0.0)] * k)
        margin = F.coalesce(*(F.when(F.col("fold") == i, made.margin(i)) for i in range(k)))
        held = dealt.select("fold", "label", margin.alias("f"))
        sizes = held.groupBy("fold").agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("n"))
        soft = held.join(F.broadcast(sizes), "fold")  # a row a fold
        target = F.when(F.col("label") == 1, (F.col("p") + 1) / (F.col("p") + 2)).otherwise(1 / (F.col("n") - F.col("p") + 2))
        ab = _newton(soft, "fold", [F.col("f"), F.lit(1.0)], [(target, F.lit(1.0))], np.tile([1.0, 0.0], (k, 1)), 0.0, steps)
        return Matcher(list(features), w.tolist(), [(-float(a), -float(b)) for a, b in ab])
    finally:
        dealt.unpersist()


def predict(rows: DataFrame, matcher: Matcher, column: str = "probability") -> DataFrame:
    gone = [f for f in matcher.features if f not in rows.columns]
    if gone:
        raise ValueError(f"features are missing: {gone}")
    return rows.withColumn(column, matcher.probability())


def select_model(metrics: list[dict]) -> str:
    """The model of best Hit@1, then MRR, then fewest features, then first in order."""
    if not metrics:
        raise ValueError("no models to choose from")
    return min(enumerate(metrics), key=lambda m: (-m[1]["overall_hit_at_1"], -m[1]["mrr"], m[1]["feature_count"], m[0]))[1]["model"]
