"""Text, price, interval and fuzzy expressions."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchlode.functions import stats, text
from matchlode.functions.fuzzy import common_subsequence, indel_ratio, token_set_ratio


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


def test_white_space_is_unicode(spark):
    assert one(spark, text.clean_text(F.col("a")), a="  Hello  \x1c w\x85orld\t\n") == "Hello w orld"
    assert one(spark, text.clean_id(F.col("a")), a=" id 1\x1f") == "id 1"
    assert one(spark, text.clean_text(F.col("a")), a=None) == ""


@pytest.mark.parametrize(
    ("raw", "price"),
    [("$1,234.50", 1234.5), ("usd 5", 5.0), ("7 USD", 7.0), ("US$ .5", 0.5), ("GBP 5", None), ("-3", None), ("+4", 4.0), ("0", None), ("", None), (None, None), ("1,23", None), ("12abc", None), ("1234,567", 1234567.0), (" 3.25 ", 3.25)],
)
def test_prices(spark, raw, price):
    assert one(spark, text.parse_price(F.col("a")), a=raw) == price


def test_token_sets(spark):
    got = one(spark, F.array_sort(text.model_tokens(F.col("a"))), a="Canon EOS-5D mk.2 kit eos-5d WX")
    assert got == ["eos-5d", "mk.2"]
    assert one(spark, text.jaccard(text.tokens(F.col("a")), text.tokens(F.col("b"))), a="a b c", b="B c d") == 0.5
    assert one(spark, text.jaccard(text.tokens(F.col("a")), text.tokens(F.col("b"))), a="", b="!") == 0.0
    assert one(spark, text.sets_conflict(text.model_tokens(F.col("a")), text.model_tokens(F.col("b"))), a="x1 y2", b="y2 x1") is False


def test_price_signatures_are_exact(spark):
    for v in (25.0, 0.1, 1234.5, 1e-5, 3.0000000000000004, 1.0):
        assert one(spark, text.price_signature(F.col("a")), a=v) == v.hex()
    assert one(spark, text.price_signature(F.col("a")), a=float("nan")) == "<missing-price>"
    assert one(spark, text.relative_difference(F.col("a"), F.col("b")), a=5.0, b=10.0) == 0.5


@settings(max_examples=60, deadline=None)
@given(st.text("abc é", max_size=14), st.text("abc é", max_size=14))
def test_common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    assert common_subsequence(a, b) == row[-1]
    assert indel_ratio(a, b) == indel_ratio(b, a) and 0 <= token_set_ratio(a, b) <= 1


def test_token_set_ratio():
    assert token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 1.0
    assert token_set_ratio("adobe photoshop cs3", "adobe photoshop elements") == pytest.approx(max(1 - (3 + 8 - 2 * common_subsequence("cs3", "elements")) / (19 + 24), 1 - 4 / (15 + 19), 1 - 9 / (15 + 24)))
    assert token_set_ratio("", "a") == 0.0


def test_wilson_matches_published_intervals(spark):
    for correct, support, low, high in ((193.0, 201.0, 0.9234, 0.9797), (163.0, 167.0, 0.9400, 0.9906)):
        a, b = (one(spark, c, a=correct, b=support) for c in stats.wilson(F.col("a"), F.col("b")))
        assert (round(a, 4), round(b, 4)) == (low, high)
    assert one(spark, stats.wilson(F.col("a"), F.col("b"))[0], a=0.0, b=0.0) is None
    with pytest.raises(Exception, match="exceeds"):
        one(spark, stats.wilson(F.col("a"), F.col("b"))[0], a=2.0, b=1.0)


def test_policy_boundaries_are_inclusive(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.2, 0.2001, 0.7999, 0.8, 1.0)], "s double")
    got = [r.a for r in df.select(stats.policy_action(F.col("s"), 0.2, 0.8).alias("a")).collect()]
    assert got == ["auto_no_match"] * 2 + ["manual_review"] * 2 + ["auto_match"] * 2
    for bad in ((0.8, 0.2), (-0.1, None), (None, math.nan)):
        with pytest.raises(ValueError):
            stats.policy_action(F.col("s"), *bad)


def test_booleans(spark):
    assert [one(spark, stats.parse_boolean(F.col("a")), a=x) for x in ("True", "0", " false ", "1")] == [True, False, False, True]
    with pytest.raises(Exception, match="boolean"):
        one(spark, stats.parse_boolean(F.col("a")), a="maybe")
