"""Basic cleaning: empty columns, blanks around values, duplicate rows, column names."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewright.functions.lenient import na_to_null
from tablewright.functions.text import strip
from tablewright.plans.schema import ROW_ID


def quoted(name: str) -> Column:
    """Column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def data_columns(df: DataFrame) -> list[str]:
    """All columns but the row key."""
    return [c for c in df.columns if c != ROW_ID]


def column_census(df: DataFrame) -> DataFrame:
    """One pass: for every column its non-null, non-blank and trimmable values, and its rows."""
    texts = set(string_columns(df))
    per_column = []
    for i, name in enumerate(data_columns(df)):
        c = quoted(name)
        filled = F.count(c)
        if name in texts:
            solid = F.count_if(strip(c) != "")
            loose = F.count_if(strip(c) != c)
        else:
            solid, loose = filled, F.lit(0).cast("bigint")
        per_column.append(F.struct(
            F.lit(i).alias("position"), F.lit(name).alias("column"),
            filled.alias("non_null"), solid.alias("non_blank"), loose.alias("trimmable"),
            F.count(F.lit(1)).alias("rows")))
    return df.agg(F.array(*per_column).alias("census")).select(F.inline("census"))


def null_literals(df: DataFrame) -> DataFrame:
    """Missing-value literals become NULL in every text column."""
    texts = set(string_columns(df))
    return df.select(*[na_to_null(quoted(c)).alias(c) if c in texts else quoted(c) for c in df.columns])


def trim_strings(df: DataFrame) -> DataFrame:
    texts = set(string_columns(df))
    return df.select(*[strip(quoted(c)).alias(c) if c in texts else quoted(c) for c in df.columns])


def trim_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """One row per distinct content, keeping the lowest row key where there is one.

    Copies are merged before the shuffle, so a row repeated very often costs no hot task.
    """
    if ROW_ID not in df.columns:
        return df.dropDuplicates()
    keys = [quoted(c) for c in data_columns(df)]
    merged = df.groupBy(*keys).agg(F.min(ROW_ID).alias(ROW_ID))
    return merged.select(*[quoted(c) for c in df.columns])


@dataclass
class CleanResult:
    df: DataFrame
    all_null: list[str] = field(default_factory=list)
    blank: list[str] = field(default_factory=list)
    trimmed: list[str] = field(default_factory=list)
    renamed: list[str] = field(default_factory=list)
    rows_before: int = 0
    columns_before: int = 0


def drop_empty_columns(df: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    """Without columns that are all NULL, and without text columns that hold only blanks."""
    census = column_census(df).collect()  # one small row per column
    null = [r.column for r in census if r.non_null == 0]
    blank = [r.column for r in census if r.non_null > 0 and r.non_blank == 0]
    gone = set(null) | set(blank)
    return df.select(*[quoted(c) for c in df.columns if c not in gone]), null, blank


def clean_table(df: DataFrame) -> CleanResult:
    """Empty columns out, values trimmed, duplicates out, names trimmed; one pass decides."""
    census = {r.column: r for r in column_census(df).collect()}
    null = [c for c, r in census.items() if r.non_null == 0]
    blank = [c for c, r in census.items() if r.non_null > 0 and r.non_blank == 0]
    gone = set(null) | set(blank)
    kept = df.select(*[quoted(c) for c in df.columns if c not in gone])
    trimmed = [c for c, r in census.items() if c not in gone and r.trimmable > 0]
    renamed = [c for c in kept.columns if c != c.strip()]
    out = trim_column_names(drop_duplicate_rows(trim_strings(kept)))
    return CleanResult(out, null, blank, trimmed, renamed,
                       next(iter(census.values())).rows if census else 0, len(df.columns))
