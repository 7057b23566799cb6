import pytest
from pyspark.sql import functions as F, types as T

from tablewright.functions import lenient, numbers, text, vectors
from tablewright.operators.profile import significant

S, D = T.StringType(), T.DoubleType()


def values(spark, raw, schema, make):
    rows = [(i, v) for i, v in enumerate(raw)]
    df = spark.createDataFrame(rows, f"i int, v {schema}")
    return [r.x for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_numbers_from_text(spark):
    raw = ["1", " 2.5 ", "-.5", "1e3", "1d", "2.0f", "0x10", "nan", "", "abc", None, "1,5", "inf", "3."]
    want = [1.0, 2.5, -0.5, 1000.0, None, None, None, None, None, None, None, None, float("inf"), 3.0]
    assert values(spark, raw, "string", lambda c: lenient.to_number(c, S)) == want


def test_nan_is_missing(spark):
    assert values(spark, [float("nan"), 1.0], "double", lambda c: lenient.to_number(c, D)) == [None, 1.0]


def test_whole_numbers_round_half_to_even(spark):
    raw = ["2.5", "3.5", "-0.5", "x"]
    assert values(spark, raw, "string", lambda c: lenient.to_whole_number(c, S)) == [2, 4, 0, None]


def test_booleans(spark):
    raw = ["Yes", "n", "TRUE", "0", "maybe", None, "f", "1"]
    assert values(spark, raw, "string", lambda c: lenient.to_boolean(c, S)) == [
        True, False, True, False, None, None, False, True]


def test_dates(spark):
    raw = ["2024-02-29", "2023-02-29", "31/02/2024", " 2024-01-02 03:04:05 ", "x", None]
    got = values(spark, raw, "string", lambda c: lenient.to_date(c, S).cast("string"))
    assert got == ["2024-02-29", None, None, "2024-01-02", None, None]


def test_missing_literals(spark):
    assert values(spark, ["NA", "", "None", "na", " NA"], "string", lenient.na_to_null) == [None, None, None, "na", " NA"]


def test_logs_have_a_floor_and_keep_null(spark):
    assert values(spark, [0.0, -1.0, 8.0, None], "double", numbers.log2) == pytest.approx(
        [-33.219280948873624, -33.219280948873624, 3.0, None], abs=1e-12)


def test_clamp_keeps_null_and_open_ends(spark):
    assert values(spark, [-1.0, 0.5, 2.0, None], "double", lambda c: numbers.clamp(c, 0, 1)) == [0.0, 0.5, 1.0, None]
    assert values(spark, [-1.0, 2.0], "double", lambda c: numbers.clamp(c, None, 1)) == [-1.0, 1.0]


def test_strip_takes_all_whitespace(spark):
    assert values(spark, ["\t a  ", "　x\x1c", "  "], "string", text.strip) == ["a", "x", ""]


def test_repair_symbol(spark):
    raw = ["_BRCA1", "TP53!!", " 12-MYC-", "123", "a b"]
    assert values(spark, raw, "string", text.repair_symbol) == ["BRCA1", "TP53", "MYC-", "", "a b"]


def test_clean_text(spark):
    raw = ["é", "a\x07b\tc", "x�", "y\x7f", None]
    assert values(spark, raw, "string", text.clean_text) == ["é", "ab\tc", "x?", "y", None]


def test_patterns_anchor_at_the_start_and_bad_ones_are_refused(spark):
    assert values(spark, ["abc", "xabc", None], "string", lambda c: text.matches_from_start(c, "a|b")) == [True, False, None]
    with pytest.raises(ValueError):
        text.java_pattern("(?P<n>a)")


def test_sizes_as_people_read_them(spark):
    raw = [0, 1023, 1024, 255232, 1024 ** 5 * 3]
    assert values(spark, raw, "bigint", text.human_size) == ["0.0 B", "1023.0 B", "1.0 KB", "249.2 KB", "3.0 PB"]


def test_four_significant_digits_match_c(spark):
    raw = [0.0, 1.0, 123456.0, 0.00001234, -12.3456, 99999.0, 0.1, 1234.6]
    assert values(spark, raw, "double", lambda c: significant(c, 4)) == ["%.4g" % v for v in raw]


def test_code_and_json_in_answers(spark):
    raw = ["```python\nx = 1\n```", "```\ny\n```", " plain "]
    assert values(spark, raw, "string", text.code_block) == ["x = 1", "y", "plain"]
    raw = ["say ```json\n{\"a\": 1}\n``` ok", "see {\"b\": {}} end", "none"]
    assert values(spark, raw, "string", text.json_object) == ['{"a": 1}', '{"b": {}}', "none"]


def test_vectors_are_padded_and_cut(spark):
    assert values(spark, [[1.0], [1.0, 2.0, 3.0], None], "array<double>", lambda c: vectors.fit_length(c, 2, cut=True)) == [
        [1.0, 0.0], [1.0, 2.0], [0.0, 0.0]]
    with pytest.raises(Exception, match="does not fit 2"):
        values(spark, [[1.0, 2.0, 3.0]], "array<double>", lambda c: vectors.fit_length(c, 2))


def test_more_dates(spark):
    raw = ["2024-3-7", "3/7/2024", "7.3.2024", "2024-03-07 09:05", "2024-03-07T09:05:06+02:00", "2024-03-07T09:05:06.250000Z", "7 Mar 2024",
           "March 7, 2024", "20240307", "25/12/2023", "2024-13-01", "7", "soon"]
    got = values(spark, raw, "string", lambda c: lenient.to_timestamp(c, S).cast("string"))
    day = "2024-03-07 00:00:00"
    assert got == [day, day, day, "2024-03-07 09:05:00", "2024-03-07 07:05:06", "2024-03-07 09:05:06.25", day, day, day, "2023-12-25 00:00:00", None, None, None]


def test_composed_only_where_it_matters(spark):
    import unicodedata

    raw = [chr(c) + "x" + chr(c) for c in range(0x80, 0x3400) if not unicodedata.category(chr(c)).startswith("C")]
    raw += ["e\u0301", "\uf900", "\U0002f800", "\u1100\u1161", "\ufb1d", "plain"]
    assert values(spark, raw, "string", text.compose_nfc) == [unicodedata.normalize("NFC", v) for v in raw]
