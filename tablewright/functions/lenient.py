"""Lenient conversions: values that do not parse become NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from tablewright.functions.text import strip

# Missing-value literals of the common delimited-text readers.
NA_LITERALS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Accepted spellings of booleans, compared in lower case.
TRUE_WORDS = ["true", "yes", "1", "t", "y"]
FALSE_WORDS = ["false", "no", "0", "f", "n"]

# Java's double parser also takes '1d', '2.0f' and hex floats; this keeps them out.
NUMBER_PATTERN = r"^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf(?:inity)?))\s*$"

TIMESTAMP_FORMATS = [
    "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy/MM/dd", "MM/dd/yyyy", "dd.MM.yyyy", "dd-MMM-yyyy",
    # parts of one digit, times without seconds, month names, days first where the month comes second
    "yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "d.M.yyyy", "d-MMM-yyyy", "yyyy-M-d H:mm", "yyyy-M-d'T'H:mm", "yyyy-M-d H:mm:ss",
    "yyyy/M/d H:mm", "yyyy/M/d H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "d.M.yyyy H:mm", "d.M.yyyy H:mm:ss",
    "d MMM yyyy", "MMM d, yyyy", "d MMMM yyyy", "MMMM d, yyyy", "d/M/yyyy", "yyyyMMdd",
]
#: with an offset; the instant is told in the session's time zone
ZONED_FORMATS = ["yyyy-M-d'T'H:mm[:ss[.SSSSSS]]XXX", "yyyy-M-d H:mm[:ss[.SSSSSS]]XXX", "yyyy-M-d'T'H:mm[:ss[.SSSSSS]]X", "yyyy-M-d H:mm[:ss[.SSSSSS]] XXX"]

NUMERIC_TYPES = (T.NumericType,)


def na_to_null(c: Column, literals: list[str] | None = None) -> Column:
    """Missing-value literals become NULL."""
    return F.when(~c.isin(literals or NA_LITERALS), c)


def to_number(c: Column, dtype: T.DataType) -> Column:
    """Any column to DOUBLE; NaN and unparsable text become NULL."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        d = c.cast("double")
        return F.when(~F.isnan(d), d)
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    if isinstance(dtype, T.StringType):
        return F.when(c.rlike(NUMBER_PATTERN), F.trim(c).try_cast("double"))
    return F.lit(None).cast("double")


def to_whole_number(c: Column, dtype: T.DataType) -> Column:
    """Any column to BIGINT, rounding halves to the even neighbour."""
    if isinstance(dtype, T.IntegralType):
        return c.cast("bigint")
    return F.rint(to_number(c, dtype)).try_cast("bigint")


def to_boolean(c: Column, dtype: T.DataType) -> Column:
    """Words for true and false (any case) to BOOLEAN, everything else NULL."""
    if isinstance(dtype, T.BooleanType):
        return c
    word = F.lower(c.cast("string"))
    return F.when(word.isin(TRUE_WORDS), F.lit(True)).when(word.isin(FALSE_WORDS), F.lit(False))


def to_timestamp(c: Column, dtype: T.DataType, formats: list[str] | None = None) -> Column:
    """Text in one of the listed formats to TIMESTAMP_NTZ; the first that fits counts."""
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp_ntz")
    if not isinstance(dtype, T.StringType):
        return F.lit(None).cast("timestamp_ntz")
    text = strip(c)
    if formats is None:
        formats = TIMESTAMP_FORMATS + ZONED_FORMATS
    if not formats:
        return F.lit(None).cast("timestamp_ntz")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats])


def to_date(c: Column, dtype: T.DataType, formats: list[str] | None = None) -> Column:
    return to_timestamp(c, dtype, formats).cast("date")


def to_text(c: Column) -> Column:
    """Cast to STRING; NULL stays NULL."""
    return c.cast("string")


def convert(c: Column, dtype: T.DataType, target: str, formats: list[str] | None = None) -> Column:
    """Lenient conversion to a schema type name; dates in one of ``formats``, or of all known ones."""
    if target == "float":
        return to_number(c, dtype)
    if target == "int":
        return to_whole_number(c, dtype)
    if target == "bool":
        return to_boolean(c, dtype)
    if target == "date":
        return to_date(c, dtype, formats)
    if target == "datetime":
        return to_timestamp(c, dtype, formats)
    return to_text(c)
