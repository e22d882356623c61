"""Intervals, scores, decisions and outcomes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def safe_rate(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part / whole).otherwise(F.lit(0.0))


def wilson(correct: Column, support: Column) -> tuple[Column, Column]:
    """Lower and upper end of the 95% interval; null without support; correct above support raises."""
    n, p = support.cast("double"), correct / support
    scale, z2 = 1 + Z95 * Z95 / n, Z95 * Z95
    middle = (p + z2 / (2 * n)) / scale
    reach = Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / scale
    bad = F.raise_error(F.lit("correct count exceeds support")).cast("double")
    ends = (F.greatest(F.lit(0.0), middle - reach), F.least(F.lit(1.0), middle + reach))
    return tuple(F.when(correct > support, bad).when(support > 0, e) for e in ends)


def rrf_score(constant: float, *ranks: Column) -> Column:
    """Sum of 1 / (constant + rank) over the ranks that are there."""
    if not (constant >= 0 and constant < float("inf")):
        raise ValueError("the RRF constant must be finite and not negative")
    return sum((F.coalesce(1 / (F.lit(constant) + r), F.lit(0.0)) for r in ranks), F.lit(0.0))


def source_label(lexical_rank: Column, dense_rank: Column, injected: Column | None = None) -> Column:
    parts = [F.when(lexical_rank.isNotNull(), F.lit("lexical")), F.when(dense_rank.isNotNull(), F.lit("dense"))]
    if injected is not None:
        parts.append(F.when(injected, F.lit("gold_injected")))
    return F.concat_ws("+", *parts)


def reciprocal_rank(rank: Column) -> Column:
    return F.when(rank > 0, 1 / rank).otherwise(F.lit(0.0))


def check_thresholds(no_match: float | None, match: float | None) -> None:
    for t in (no_match, match):
        if t is not None and not 0 <= t <= 1:
            raise ValueError("thresholds must be finite and in [0, 1]")
    if no_match is not None and match is not None and no_match >= match:
        raise ValueError("the no-match threshold must be below the match threshold")


def policy_action(score: Column, no_match: float | None, match: float | None) -> Column:
    """auto_match at or above, auto_no_match at or below, else manual_review; null thresholds disable."""
    check_thresholds(no_match, match)
    ok = (score >= 0) & (score <= 1) & ~F.isnan(score)
    out = F.when(~F.coalesce(ok, F.lit(False)), F.raise_error(F.lit("scores must be finite and in [0, 1]")))
    if match is not None:
        out = out.when(score >= match, F.lit("auto_match"))
    if no_match is not None:
        out = out.when(score <= no_match, F.lit("auto_no_match"))
    return out.otherwise(F.lit("manual_review"))


def ranking_outcome(has_gold: Column, gold_retrieved: Column, is_gold_pair: Column) -> Column:
    return (
        F.when(~has_gold, F.lit("assumed_no_match"))
        .when(~gold_retrieved, F.lit("retrieval_miss"))
        .when(~is_gold_pair, F.lit("reranking_miss"))
        .otherwise(F.lit("top_gold_match"))
    )


def action_correct(action: Column, is_gold_pair: Column, has_gold: Column) -> Column:
    return F.when(action == "auto_match", is_gold_pair).when(action == "auto_no_match", ~has_gold)


def parse_boolean(value: Column) -> Column:
    text = F.lower(F.trim(value.cast("string")))
    return (
        F.when(text.isin("true", "1", "1.0"), F.lit(True))
        .when(text.isin("false", "0", "0.0"), F.lit(False))
        .otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(text, F.lit("null")))).cast("boolean"))
    )
