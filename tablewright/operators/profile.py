"""Column profiles and the quick quality check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tablewright.operators import quantiles
from tablewright.operators.clean import data_columns, quoted, string_columns
from tablewright.operators.issues import explode_issues, issue
from tablewright.plans.schema import ROW_ID

QUARTILES = [0.25, 0.5, 0.75]


def _comparable(df: DataFrame, name: str) -> Column:
    """The value as text for counting: NaN is missing, as NULL is."""
    c = quoted(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        c = F.when(~F.isnan(c), c + F.lit(0.0))
    return c.cast("string")


def _missing(df: DataFrame, name: str) -> Column:
    c = quoted(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(position, column, value, n) over the non-null values of all columns, in one shuffle."""
    cells = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), _comparable(df, c).alias("value"))
        for i, c in enumerate(columns)])
    long = df.select(F.inline(F.filter(cells, lambda s: s["value"].isNotNull())))
    return long.groupBy("position", "column", "value").agg(F.count(F.lit(1)).alias("n"))


def column_profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """(column, position, dtype, rows, nulls, distinct_values), one row per column.

    Exact distinct counts group the values of all columns in one shuffle instead of expanding
    every row once per distinct aggregate. ``exact=False`` uses sketches and no shuffle of values.
    """
    names = data_columns(df)
    dtypes = dict(df.dtypes)
    rows = []
    for i, c in enumerate(names):
        parts = [F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(dtypes[c]).alias("dtype"),
                 F.count(F.lit(1)).alias("rows"), F.count_if(_missing(df, c)).alias("nulls")]
        if not exact:
            parts.append(F.approx_count_distinct(_comparable(df, c)).alias("distinct_values"))
        rows.append(F.struct(*parts))
    counts = df.agg(F.array(*rows).alias("all")).select(F.inline("all"))
    if exact:
        distinct = value_counts(df, names).groupBy("position").agg(F.count(F.lit(1)).alias("distinct_values"))
        counts = counts.join(F.broadcast(distinct), "position", "left")
    return counts.select("column", "position", "dtype", "rows", "nulls",
                         F.coalesce("distinct_values", F.lit(0).cast("bigint")).alias("distinct_values"))


def numeric_describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n, mean, std, min, q25, q50, q75, max), one row per numeric column; exact quartiles."""
    names = columns or [c for c in quantiles.numeric_columns(df) if c != ROW_ID]
    margin = 2.0 / quantiles.SKETCH_ACCURACY
    rows = []
    for i, c in enumerate(names):
        x = quantiles.clean_double(df, c)
        rows.append(F.struct(
            F.lit(c).alias("column"), F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
            F.min(x).alias("min"), F.max(x).alias("max"),
            quantiles.bracket_aggregates(x, QUARTILES, margin).alias("brackets")))
    # one row per column
    stats = df.agg(F.array(*rows).alias("all")).select(F.inline("all")).collect()
    sketch = {r.column: (r.n, r.brackets or []) for r in stats}
    q = quantiles.exact_quantiles(df, names, QUARTILES, sketch)
    out = [(r.column, r.n, r["mean"], r["std"], r["min"], *q[r.column], r["max"]) for r in stats]
    return df.sparkSession.createDataFrame(
        out, "column string, n bigint, mean double, std double, min double, q25 double, q50 double, "
             "q75 double, max double")


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = 3, max_columns: int | None = None) -> DataFrame:
    """(column, value, n, rank): the most frequent values of the non-numeric columns, or of the first ``max_columns``."""
    numeric = set(quantiles.numeric_columns(df))
    names = columns or [c for c in data_columns(df) if c not in numeric][:max_columns]
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value"))
    return (value_counts(df, names)
            .withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k)
            .select("column", "value", "n", "rank"))


def head_rows(df: DataFrame, n: int = 5, key: str = ROW_ID) -> DataFrame:
    """First rows in key order."""
    return df.orderBy(key).limit(n)


def null_columns(df: DataFrame) -> DataFrame:
    """(column, nulls) of the columns that hold NULLs."""
    return _counted(df, {c: F.count_if(_missing(df, c)) for c in data_columns(df)}, "nulls")


def empty_strings(df: DataFrame) -> DataFrame:
    """(column, empty) of the text columns that hold empty strings."""
    names = [c for c in string_columns(df) if c != ROW_ID]
    return _counted(df, {c: F.count_if(quoted(c) == "") for c in names}, "empty")


def _counted(df: DataFrame, counters: dict[str, Column], name: str) -> DataFrame:
    rows = [F.struct(F.lit(c).alias("column"), n.alias(name)) for c, n in counters.items()]
    if not rows:
        return df.sparkSession.createDataFrame([], f"column string, {name} bigint")
    return (df.agg(F.array(*rows).alias("all")).select(F.inline("all")).where(F.col(name) > 0))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row ``duplicates``: rows that repeat an earlier row (the row key is not compared)."""
    copies = df.groupBy(*[quoted(c) for c in data_columns(df)]).agg(F.count(F.lit(1)).alias("n"))
    return copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def outlier_bounds(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Quartiles widened by 1.5 times their distance, per column with any value."""
    q = quantiles.exact_quantiles(df, columns, [0.25, 0.75])
    return {c: (a - 1.5 * (b - a), b + 1.5 * (b - a)) for c, (a, b) in q.items() if a is not None}


def outliers(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, outliers) of the numeric columns with values beyond the bounds."""
    names = columns or [c for c in quantiles.numeric_columns(df) if c != ROW_ID]
    return _counted(df, _outlier_counters(df, names), "outliers")


def _outlier_counters(df: DataFrame, names: list[str]) -> dict[str, Column]:
    if not names:
        return {}
    counters = {}
    for c, (low, high) in outlier_bounds(df, names).items():
        x = quantiles.clean_double(df, c)
        counters[c] = F.count_if((x < F.lit(low)) | (x > F.lit(high)))
    return counters


def quick_check(df: DataFrame) -> DataFrame:
    """Issue rows for NULLs, empty strings, outliers (one pass for all) and duplicate rows."""
    texts = set(string_columns(df))
    found = []
    for c in data_columns(df):
        label = F.lit(c)
        nulls = F.count_if(_missing(df, c))
        found.append(issue(label, "null_values", "warning", F.format_string("%d null values", nulls), nulls,
                           "Fill or remove missing values"))
        if c in texts:
            blank = F.count_if(quoted(c) == "")
            found.append(issue(label, "empty_strings", "warning", F.format_string("%d empty strings", blank),
                               blank, "Treat empty strings as missing"))
    names = [c for c in quantiles.numeric_columns(df) if c != ROW_ID]
    for c, n in _outlier_counters(df, names).items():
        found.append(issue(F.lit(c), "outliers", "info", F.format_string("%d outliers", n), n,
                           "Review values far outside the quartiles"))
    counted = df.agg(F.array(*found).alias("all"))
    rows = counted.select(F.inline(F.filter("all", lambda s: s.isNotNull())))
    n = F.col("duplicates")
    copies = explode_issues(duplicate_rows(df), issue(
        F.lit("*"), "duplicates", "info", F.format_string("%d duplicate rows", n), n, "Remove repeated rows"))
    return rows.unionByName(copies)


def quick_summary(df: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: total_rows, total_columns, issues, has_issues. NULLs of all columns are one issue."""
    n = F.count_if(F.col("issue_type") != "null_values") + F.max(
        F.when(F.col("issue_type") == "null_values", 1).otherwise(0))
    found = issues.agg(F.coalesce(n, F.lit(0)).cast("bigint").alias("issues"))
    rows = df.agg(F.count(F.lit(1)).alias("total_rows"))
    both = rows.unionByName(found, allowMissingColumns=True).agg(
        F.max("total_rows").alias("total_rows"), F.max("issues").alias("issues"))
    return both.select("total_rows", F.lit(len(data_columns(df))).cast("bigint").alias("total_columns"),
                       "issues", (F.col("issues") > 0).alias("has_issues"))


def null_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: total NULL cells now and before, and whether they were reduced."""
    from tablewright.operators.compare import compare_tables

    return (compare_tables(before, after).where(F.col("measure") == "nulls")
            .select(F.col("after").alias("nulls"), F.col("before").alias("nulls_before"),
                    (F.col("change") < 0).alias("reduced")))


def preview(df: DataFrame, rows: int = 10, key: str | None = ROW_ID) -> dict:
    """Columns, types, shape, first rows and NULL counts; two small jobs."""
    stats = column_profile(df, exact=False).orderBy("position").collect()
    head = df.orderBy(key).limit(rows) if key and key in df.columns else df.limit(rows)
    return {
        "columns": [r.column for r in stats],
        "dtypes": {r.column: r.dtype for r in stats},
        "shape": (stats[0].rows if stats else df.count(), len(stats)),
        "preview": [r.asDict() for r in head.collect()],
        "null_counts": {r.column: r.nulls for r in stats},
    }


def summary_lines(df: DataFrame, name: str, shown: int = 8) -> str:
    """Rows, columns and the first columns with type and NULL count, as text."""
    stats = column_profile(df, exact=False).orderBy("position").collect()
    rows = stats[0].rows if stats else 0
    lines = [f"File: {name}", "", f"Rows: {rows:,}", f"Columns: {len(stats)}", "", "Columns:"]
    for r in stats[:shown]:
        lines.append(f"  - {r.column}: {r.dtype}" + (f" ({r.nulls} nulls)" if r.nulls else ""))
    if len(stats) > shown:
        lines.append(f"  ... and {len(stats) - shown} more")
    return "\n".join(lines)


def log_line(df: DataFrame, name: str) -> str:
    """Shape and first five columns in one line."""
    return f"{name}: {df.count()} rows x {len(df.columns)} columns [{', '.join(df.columns[:5])}]"


def shown_cells(df: DataFrame, rows: int = 100, key: str = ROW_ID) -> DataFrame:
    """Display form of the first rows: NULL spelled out, floats to 4 significant digits, long text cut."""
    from tablewright.functions.text import shorten

    cells = []
    for f in df.schema:
        c = quoted(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            shown = F.format_string("%s", significant(c, 4))
        else:
            shown = shorten(c.cast("string"), 50, 47)
        cells.append(F.coalesce(F.when(~_missing(df, f.name), shown), F.lit("NULL")).alias(f.name))
    return df.orderBy(key).limit(rows).select(*cells)


def significant(x: Column, digits: int) -> Column:
    """Text of a number with the given significant digits, as C's ``%g`` prints it."""
    exact = F.format_string(f"%.{digits - 1}e", x)
    exponent = F.regexp_extract(exact, r"e([+-]\d+)$", 1).try_cast("int")
    fixed = F.when(x == 0, F.lit("0"))
    for e in range(-4, digits):
        shown = F.format_string(f"%.{digits - 1 - e}f", x)
        if digits - 1 - e > 0:
            shown = F.regexp_replace(shown, r"\.?0+$", "")
        fixed = fixed.when(exponent == e, shown)
    science = F.regexp_replace(exact, r"\.?0+e", "e")
    return fixed.otherwise(science)
