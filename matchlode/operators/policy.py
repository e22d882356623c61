"""Three-way decisions: evidence by listings and duplicate groups, and choice of thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import safe_rate, wilson

ACTIONS = ("auto_match", "auto_no_match", "manual_review")


def statistics(support, correct, total, prefix: str) -> list:
    """Columns of one kind of evidence; precision and interval are null without support, and all but support and coverage for a null `correct`."""
    low, high = wilson(correct, support)
    return [
        support.cast("long").alias(f"{prefix}_support"),
        correct.cast("long").alias(f"{prefix}_correct_count"),
        (support - correct).cast("long").alias(f"{prefix}_error_count"),
        F.when(support > 0, correct / support).alias(f"{prefix}_empirical_precision"),
        F.when(correct.isNotNull(), low).alias(f"{prefix}_precision_wilson_95_low"),
        F.when(correct.isNotNull(), high).alias(f"{prefix}_precision_wilson_95_high"),
        safe_rate(support, total).alias(f"{prefix}_coverage"),
    ]


def action_statistics(decisions: DataFrame, group: str = "duplicate_group_id") -> DataFrame:
    """A row for each action: evidence by listings and by groups. decisions: action, is_gold_pair, has_gold_listing and a group.

    A group counts as selected if a member is, and as correct only if all members are, selected or not.
    Manual review abstains: it has support and coverage, and all that depends on correctness is null.
    """
    right = {"auto_match": F.col("is_gold_pair"), "auto_no_match": ~F.col("has_gold_listing"), "manual_review": F.lit(True)}
    chosen = lambda a: F.col("action") == a
    by = decisions.groupBy(group).agg(
        F.count(F.lit(1)).alias("rows"),
        *(F.count(F.when(chosen(a), 1)).alias(f"{a}_support") for a in ACTIONS),
        *(F.count(F.when(chosen(a) & right[a], 1)).alias(f"{a}_correct") for a in ACTIONS),
        *(F.bool_and(right[a]).alias(f"{a}_all") for a in ACTIONS),
    )
    count = lambda c: F.count(F.when(c, 1))
    own = [
        F.struct(
            F.lit(a).alias("action"), F.sum(f"{a}_support").alias("support"), F.sum(f"{a}_correct").alias("correct"),
            count(F.col(f"{a}_support") > 0).alias("groups"), count((F.col(f"{a}_support") > 0) & F.col(f"{a}_all")).alias("right_groups"),
        )
        for a in ACTIONS
    ]
    sums = by.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("listings"), F.count(F.lit(1)).alias("all_groups"), F.array(*own).alias("own"))
    rows = sums.select("listings", "all_groups", F.explode("own").alias("o")).select("listings", "all_groups", "o.*")
    judged = lambda c: F.when(F.col("action") != "manual_review", F.coalesce(F.col(c), F.lit(0)))
    support = F.coalesce(F.col("support"), F.lit(0))
    return rows.select(
        "action", *statistics(support, judged("correct"), F.col("listings"), "listing"), *statistics(F.col("groups"), judged("right_groups"), F.col("all_groups"), "group")
    )


def group_evidence(rows: DataFrame) -> DataFrame:
    """One row of group statistics. rows: group_id, selected, correct.

    A group counts as selected if a member is, and as correct only if all members are, selected or not.
    """
    groups = rows.groupBy("group_id").agg(F.bool_or("selected").alias("selected"), F.bool_and("correct").alias("correct"))
    counts = groups.agg(F.count(F.when(F.col("selected"), 1)).alias("support"), F.count(F.when(F.col("selected") & F.col("correct"), 1)).alias("hits"), F.count(F.lit(1)).alias("total"))
    return counts.select(*statistics(F.col("support"), F.col("hits"), F.col("total"), "group"))


def threshold_grid(spark, step: float) -> DataFrame:
    """threshold: multiples of step up to 1, and 1."""
    if not 0 < step <= 1:
        raise ValueError("the grid step must be in (0, 1]")
    values = sorted({round(i * step, 12) for i in range(int(1 / step) + 1) if round(i * step, 12) <= 1} | {1.0})
    return spark.createDataFrame([(v,) for v in values], "threshold double")


def threshold_diagnostics(rows: DataFrame, step: float, precision_targets: dict[str, float], min_support: dict[str, int]) -> DataFrame:
    """A row for each action and threshold. rows: score, group_id, correct_match, correct_no_match.

    Scores are snapped to grid cells and counted a cell, once; sums along the grid then give every
    threshold, whatever the number of rows. A group is selected from its least score on
    (auto_no_match), or up to its greatest (auto_match).
    """
    for t in precision_targets.values():
        if not 0 <= t <= 1:
            raise ValueError("precision targets must be in [0, 1]")
    if min(min_support.values()) < 1:
        raise ValueError("minimum supports must be positive")
    grid = threshold_grid(rows.sparkSession, step)
    cells = [r.threshold for r in grid.collect()]
    literal = F.array(*map(F.lit, cells))

    def cell(value, action):
        inside = (lambda t: t < value) if action == "auto_no_match" else (lambda t: t <= value)
        n = F.size(F.filter(literal, inside))
        return n if action == "auto_no_match" else n - 1

    out = None
    for action, correct, edge in (("auto_match", "correct_match", F.max), ("auto_no_match", "correct_no_match", F.min)):
        groups = rows.groupBy("group_id").agg(edge("score").alias("score"), F.bool_and(correct).alias("correct"))
        one = None
        for prefix, part in (("group", groups), ("listing", rows.select("score", F.col(correct).alias("correct")))):
            # listings need an all-pass null for scores beyond the grid's end: none, as scores lie in [0, 1]
            own = part.groupBy(cell(F.col("score"), action).alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("correct"), 1)).alias("hits"))
            frame = rows.sparkSession.createDataFrame([(i, c) for i, c in enumerate(cells)], "cell int, threshold double")
            w = Window.orderBy("cell")  # len(cells) rows
            w = w.rowsBetween(Window.unboundedPreceding, 0) if action == "auto_no_match" else w.rowsBetween(0, Window.unboundedFollowing)
            full = frame.join(F.broadcast(own), "cell", "left").select("cell", "threshold", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("hits", F.lit(0)).alias("hits"))
            total = F.sum("n").over(Window.partitionBy())
            summed = full.select("cell", "threshold", F.sum("n").over(w).alias("support"), F.sum("hits").over(w).alias("hits"), total.alias("total"))
            summed = summed.select("cell", "threshold", *statistics(F.col("support"), F.col("hits"), F.col("total"), prefix))
            one = summed if one is None else one.join(summed.drop("threshold"), "cell")
        target, least = precision_targets[action], min_support[action]
        one = one.withColumns({"action": F.lit(action), "precision_target": F.lit(float(target)), "min_group_support": F.lit(int(least))})
        one = one.withColumn("support_met", F.col("group_support") >= least).withColumn("precision_target_met", F.coalesce(F.col("group_empirical_precision") >= target, F.lit(False)))
        one = one.withColumn("feasible", F.col("support_met") & F.col("precision_target_met")).drop("cell")
        out = one if out is None else out.unionByName(one)
    return out


def select_thresholds(diagnostics: DataFrame) -> DataFrame:
    """One row: no_match_threshold, match_threshold; null where an action stays disabled.

    Of feasible pairs with the no-match threshold below the match threshold, the one of greatest summed
    group coverage, then lower no-match, then higher match threshold. Without one, the best single
    action: coverage, precision, no-match first, then the cautious threshold. The grid bounds all sizes.
    """
    ok = diagnostics.filter("feasible").select("action", "threshold", "group_coverage", "group_empirical_precision")
    no = ok.filter("action = 'auto_no_match'").select(F.col("threshold").alias("n"), F.col("group_coverage").alias("nc"))
    yes = ok.filter("action = 'auto_match'").select(F.col("threshold").alias("m"), F.col("group_coverage").alias("mc"))
    pair = no.join(F.broadcast(yes), F.col("n") < F.col("m")).agg(F.max_by(F.struct("n", "m"), F.struct(F.round(F.col("nc") + F.col("mc"), 12), -F.col("n"), F.col("m"))).alias("p"))
    first = (F.col("action") == "auto_no_match").cast("int")
    cautious = F.when(F.col("action") == "auto_no_match", -F.col("threshold")).otherwise(F.col("threshold"))
    single = ok.agg(F.max_by(F.struct("action", "threshold"), F.struct("group_coverage", "group_empirical_precision", first, cautious)).alias("s"))
    alone = lambda a: F.when(F.col("p").isNull() & (F.col("s.action") == a), F.col("s.threshold"))
    return pair.crossJoin(single).select(  # one row each
        F.coalesce(F.col("p.n"), alone("auto_no_match")).alias("no_match_threshold"), F.coalesce(F.col("p.m"), alone("auto_match")).alias("match_threshold")
    )


EVIDENCE = ("support", "correct_count", "error_count", "empirical_precision", "precision_wilson_95_low", "precision_wilson_95_high", "coverage")


def selected_evidence(diagnostics: DataFrame, chosen: dict[str, float | None]) -> DataFrame:
    """A row for each automatic action: feasible, enabled, threshold, and what the chosen threshold rests on, by groups and listings.

    A disabled action selects nothing: support, counts and coverage 0, the rest null.
    """
    names = {"auto_no_match": chosen["no_match_threshold"], "auto_match": chosen["match_threshold"]}
    plan = diagnostics.sparkSession.createDataFrame([(a, t) for a, t in names.items()], "action string, chosen double")
    feasible = diagnostics.groupBy("action").agg(F.bool_or("feasible").alias("feasible"))
    rows = plan.join(feasible, "action", "left").join(diagnostics.drop("feasible").withColumnRenamed("threshold", "chosen"), ["action", "chosen"], "left")  # a grid of rows
    empty = {"support": 0, "correct_count": 0, "error_count": 0, "coverage": 0.0}
    view = lambda p: F.struct(*((F.coalesce(F.col(f"{p}_{k}"), F.lit(empty[k])) if k in empty else F.col(f"{p}_{k}")).alias(k) for k in EVIDENCE)).alias
    return rows.select(
        "action", F.coalesce("feasible", F.lit(False)).alias("feasible"), F.col("chosen").isNotNull().alias("enabled"), F.col("chosen").alias("threshold"), view("group")("group_evidence"), view("listing")("listing_operation")
    )


def listing_report(decisions: DataFrame) -> DataFrame:
    """One row over all decisions: action, action_correct, is_gold_pair, has_gold_listing."""
    action = F.when(F.col("action").isin(*ACTIONS), F.col("action")).otherwise(F.raise_error(F.concat(F.lit("unknown action: "), F.col("action"))))
    own = decisions.withColumn("action", action)
    n = F.count(F.lit(1))
    count = lambda c: F.count(F.when(c, 1))
    auto = count(F.col("action") != "manual_review")
    right = count(F.col("action_correct"))
    review = F.col("action") == "manual_review"
    return own.agg(
        n.alias("listings"),
        *(count(F.col("action") == a).alias(f"{a}_count") for a in ACTIONS),
        *(safe_rate(count(F.col("action") == a), n).alias(f"{a}_rate") for a in ACTIONS),
        right.alias("correct_automatic"),
        safe_rate(right, auto).alias("automatic_accuracy"),
        safe_rate(auto, n).alias("automatic_coverage"),
        count(review & F.col("has_gold_listing")).alias("review_matched"),
        count(review & ~F.col("has_gold_listing")).alias("review_no_match"),
        safe_rate(right, n).alias("end_to_end_rate"),
    )
