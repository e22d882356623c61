"""Indel and token-set ratios: a bit-parallel longest common subsequence behind Arrow-fed functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence; one machine-independent integer is a whole DP row."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """2 * LCS / (length of both), from 0 to 1; two empty texts give 1."""
    total = len(a) + len(b)
    return 2 * common_subsequence(a, b) / total if total else 1.0


def token_set_ratio(a: str, b: str) -> float:
    """Compares what is common and what differs between both sets of words, from 0 to 1."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    common, only_a, only_b = left & right, left - right, right - left
    if common and not (only_a and only_b):
        return 1.0
    rest_a, rest_b = " ".join(sorted(only_a)), " ".join(sorted(only_b))
    shared = len(" ".join(sorted(common)))
    gap = 1 if shared else 0
    long_a, long_b = shared + gap + len(rest_a), shared + gap + len(rest_b)
    distance = len(rest_a) + len(rest_b) - 2 * common_subsequence(rest_a, rest_b)
    best = 1 - distance / (long_a + long_b)
    if shared:
        best = max(best, 1 - (gap + len(rest_a)) / (shared + long_a), 1 - (gap + len(rest_b)) / (shared + long_b))
    return best


def _distinct(ratio, a: pd.Series, b: pd.Series) -> pd.Series:
    """ratio of each pair, computed once for each distinct pair of a batch."""
    pairs = pd.MultiIndex.from_arrays([a, b])
    codes, once = pairs.factorize()
    return pd.Series(np.array([ratio(x, y) for x, y in once], float)[codes] if len(codes) else [], dtype=float)


@F.pandas_udf(DoubleType())
def _indel(a: pd.Series, b: pd.Series) -> pd.Series:
    return _distinct(indel_ratio, a, b)


@F.pandas_udf(DoubleType())
def _token_set(a: pd.Series, b: pd.Series) -> pd.Series:
    return _distinct(token_set_ratio, a, b)


def _unless_empty(f, a: Column, b: Column) -> Column:
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(f(a, b))


def indel_similarity(a: Column, b: Column) -> Column:
    return _unless_empty(_indel, a, b)


def token_set_similarity(a: Column, b: Column) -> Column:
    return _unless_empty(_token_set, a, b)
