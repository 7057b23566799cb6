"""One date format per column, chosen from all of its values."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from tablewright.functions import lenient
from tablewright.functions.text import strip
from tablewright.operators.clean import quoted


def column_formats(df: DataFrame, columns: list[str], formats: list[str] | None = None) -> dict[str, str | None]:
    """The format that fits most values of each text column, or None where none fits; of equal ones the first listed.

    One pass counts every format over all columns. So a day beyond 12 anywhere in a column settles which of
    day and month comes first in all of it.
    """
    tried = formats or lenient.TIMESTAMP_FORMATS + lenient.ZONED_FORMATS
    names = [c for c in dict.fromkeys(columns) if isinstance(df.schema[c].dataType, T.StringType)]
    if not names:
        return {}
    counts = [F.count(F.try_to_timestamp(strip(quoted(c)), F.lit(f))).alias(f"c{i}_{k}") for i, c in enumerate(names) for k, f in enumerate(tried)]
    seen = df.agg(*counts).first()
    out = {}
    for i, c in enumerate(names):
        best = max(range(len(tried)), key=lambda k: (seen[f"c{i}_{k}"], -k))
        out[c] = tried[best] if seen[f"c{i}_{best}"] else None
    return out


def dates_by_column(df: DataFrame, columns: list[str], target: str = "date") -> tuple[DataFrame, DataFrame]:
    """``df`` with these text columns as DATE (or ``datetime``), and (column, format, values, unread), one row per column.

    Values that do not have their column's format become NULL and count as unread.
    """
    chosen = column_formats(df, columns)
    typed = {c: lenient.convert(quoted(c), T.StringType(), target, [f] if f else []) for c, f in chosen.items()}
    report = [F.struct(F.lit(c).alias("column"), F.lit(f).cast("string").alias("format"), F.count(quoted(c)).alias("values"),
                       (F.count(quoted(c)) - F.count(typed[c])).alias("unread")) for c, f in chosen.items()]
    table = df.agg(F.array(*report).alias("all")).select(F.inline("all")) if report else df.sparkSession.createDataFrame(
        [], "column string, format string, values bigint, unread bigint")
    return df.withColumns(typed), table
