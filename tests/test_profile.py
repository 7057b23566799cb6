import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import fingerprint as fp
from tablewright.operators import profile, quantiles


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    data = np.column_stack([rng.normal(size=3000), rng.integers(0, 4, 3000), rng.exponential(size=3000)])
    rows = [(float(a), int(b), None if i % 5 == 0 else float(c)) for i, (a, b, c) in enumerate(data)]
    df = spark.createDataFrame(rows, "a double, b int, c double").repartition(7)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    got = quantiles.exact_quantiles(df, ["a", "b", "c"], probs)
    for name, values in zip("abc", ([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows if r[2] is not None])):
        assert got[name] == pytest.approx(np.quantile(values, probs), abs=1e-12)


def test_quantiles_by_many_rounds(spark, monkeypatch):
    """Coarse sketches and tiny final ranges: ties, infinities and bad brackets still give the exact values."""
    monkeypatch.setattr(quantiles, "FINISH_ROWS", 3)
    monkeypatch.setattr(quantiles, "SKETCH_ACCURACY", 20)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(0, 30, 500), rng.normal(10, 3, 500), [5.0] * 200, [-np.inf] * 20, [np.inf] * 20])
    df = spark.createDataFrame([(float(v),) for v in rng.permutation(x)], "x double").repartition(5)
    probs = [0.0, 0.3, 0.5, 0.77, 1.0]
    want = [float(v) for v in np.quantile(x, probs, method="lower")]
    low = quantiles._order_statistics(df, {("x", int(np.floor(q * (len(x) - 1)))): (7.0, 7.0) for q in probs}, {"x": len(x)})
    assert [low["x", int(np.floor(q * (len(x) - 1)))] for q in probs] == want


def test_a_missed_bracket_is_widened(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("x"))
    wrong = {"x": (100, [0.0, 1.0])}
    assert quantiles.exact_quantiles(df, ["x"], [0.5], wrong) == {"x": [49.5]}


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert quantiles.exact_quantiles(df, ["x"], [0.5]) == {"x": [None]}
    assert profile.numeric_describe(df).first().n == 0


def test_quick_check_and_preview(spark):
    df = spark.createDataFrame([(i, float(i % 5), "" if i == 3 else "v") for i in range(40)] + [(40, 1000.0, None)],
                               "row_id bigint, x double, s string")
    found = {(r.column, r.issue_type): r.affected_rows for r in profile.quick_check(df).collect()}
    assert found[("x", "outliers")] == 1 and found[("s", "null_values")] == 1 and found[("s", "empty_strings")] == 1
    assert found[("*", "duplicates")] == 41 - 7
    seen = profile.preview(df, 3)
    assert seen["shape"] == (41, 2) and seen["null_counts"] == {"x": 0, "s": 1} and len(seen["preview"]) == 3
    assert profile.summary_lines(df, "f").endswith("  - s: string (1 nulls)")


def chosen(spark, column):
    return spark.range(1).select(column.alias("t")).first().t


@pytest.mark.parametrize("ratio,null_word,card_word", [
    (0.0, "NO_NULLS", "CONSTANT"), (0.0099, "FEW_NULLS", "CONSTANT"), (0.01, "FEW_NULLS", "LOW_CARD"),
    (0.0999, "FEW_NULLS", "LOW_CARD"), (0.1, "SOME_NULLS", "MED_CARD"), (0.4999, "SOME_NULLS", "MED_CARD"),
    (0.5, "MANY_NULLS", "HIGH_CARD"), (0.9499, "MANY_NULLS", "HIGH_CARD"), (0.95, "MANY_NULLS", "UNIQUE")])
def test_ratio_thresholds(spark, ratio, null_word, card_word):
    assert chosen(spark, fp.null_token(F.lit(ratio))) == null_word
    assert chosen(spark, fp.cardinality_token(F.lit(ratio))) == card_word


@pytest.mark.parametrize("low,high,sign,spread", [
    (0.0, 1.0, "RANGE_0_1", None), (0.0, 1.01, "POSITIVE", None), (-2.0, 0.0, "NEGATIVE", None),
    (-1.0, 2.0, "MIXED_SIGN", None), (0.0, 1_000_000.0, "POSITIVE", None), (0.0, 1_000_000.1, "POSITIVE", "LARGE_RANGE"),
    (0.1, 1.0, "RANGE_0_1", "SMALL_RANGE")])
def test_range_thresholds(spark, low, high, sign, spread):
    assert chosen(spark, fp.sign_token(F.lit(low), F.lit(high))) == sign
    assert chosen(spark, fp.spread_token(F.lit(low), F.lit(high))) == spread


@pytest.mark.parametrize("skew,word", [(0.49, "SYMMETRIC"), (0.5, "RIGHT_SKEW"), (-0.5, "LEFT_SKEW"), (None, "LEFT_SKEW")])
def test_skew_thresholds(spark, skew, word):
    assert chosen(spark, fp.skew_token(F.lit(1.0), F.lit(skew).cast("double"))) == word
    assert chosen(spark, fp.skew_token(F.lit(0.0), F.lit(skew).cast("double"))) is None


@pytest.mark.parametrize("value,length,case", [
    (4.99, "SHORT_STR", None), (5.0, "MED_STR", None), (20.0, "LONG_STR", None), (0.19, None, "LOWERCASE"),
    (0.2, None, "MIXEDCASE"), (0.8, None, "MIXEDCASE"), (0.81, None, "UPPERCASE")])
def test_text_thresholds(spark, value, length, case):
    if length:
        assert chosen(spark, fp.length_token(F.lit(value))) == length
    if case:
        assert chosen(spark, fp.case_token(F.lit(value))) == case


def test_whole_fingerprint(spark):
    rows = [(i, f"GENE{i}", i / 200.0, i if i % 3 else None) for i in range(50)]
    df = spark.createDataFrame(rows, "row_id bigint, gene_symbol string, p_val double, n bigint")
    assert fp.fingerprint(df).first().tokens == [
        "COL_0_STRING", "COL_0_NO_NULLS", "COL_0_UNIQUE", "COL_0_MED_STR", "COL_0_UPPERCASE", "COL_0_HAS_NUMBERS",
        "COL_0_GENE_PATTERN", "COL_0_NAME_GENE",
        "COL_1_FLOAT", "COL_1_NO_NULLS", "COL_1_UNIQUE", "COL_1_RANGE_0_1", "COL_1_SMALL_RANGE", "COL_1_SYMMETRIC",
        "COL_1_PVALUE_PATTERN", "COL_1_NAME_PVALUE",
        "COL_2_FLOAT", "COL_2_SOME_NULLS", "COL_2_UNIQUE", "COL_2_POSITIVE", "COL_2_SYMMETRIC",
        "DF_SMALL_ROWS", "DF_FEW_COLS", "DF_MIXED_TYPES", "DF_MANY_MISSING"]


def test_string_shares_use_all_rows_or_the_first(spark):
    rows = [(i, "UP" if i < 100 else "down") for i in range(1000)]
    df = spark.createDataFrame(rows, "row_id bigint, s string").repartition(6)
    assert fp.column_facts(df).first().upper_share == 0.1
    assert fp.column_facts(df, sample_rows=100).first().upper_share == 1.0
