"""Comparison of two versions of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.operators.clean import data_columns, quoted
from tablewright.plans.schema import ROW_ID

MISSING = "__NA__"


def null_total(df: DataFrame) -> Column:
    """Aggregate: NULL cells of the whole table (the row key is not counted)."""
    per_row = [F.isnull(quoted(c)).cast("bigint") for c in data_columns(df)]
    total = per_row[0]
    for c in per_row[1:]:
        total = total + c
    return F.coalesce(F.sum(total), F.lit(0))


def table_size(df: DataFrame) -> DataFrame:
    """One row: rows, columns, nulls."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(data_columns(df))).cast("bigint").alias("columns"),
                  null_total(df).alias("nulls"))


def compare_tables(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows (measure, before, after, change) for rows, columns and NULL cells."""
    sides = (table_size(before).withColumn("side", F.lit("before"))
             .unionByName(table_size(after).withColumn("side", F.lit("after"))))
    wide = sides.unpivot(["side"], ["rows", "columns", "nulls"], "measure", "value")
    return (wide.groupBy("measure")
            .agg(F.max(F.when(F.col("side") == "before", F.col("value"))).alias("before"),
                 F.max(F.when(F.col("side") == "after", F.col("value"))).alias("after"))
            .withColumn("change", F.col("after") - F.col("before")))


def _cell(name: str) -> Column:
    return F.coalesce(quoted(name).cast("string"), F.lit(MISSING))


def column_signatures(df: DataFrame, key: str = ROW_ID) -> DataFrame:
    """(column, rows, signature): equal columns have equal signatures, whatever the row order.

    The signature adds a hash of (key, value) over all rows, in DECIMAL so that it cannot overflow.
    """
    names = [c for c in df.columns if c != key]
    rows = [F.struct(
        F.lit(i).alias("position"), F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"),
        F.sum(F.xxhash64(quoted(key), _cell(c)).cast("decimal(20,0)")).alias("signature"))
        for i, c in enumerate(names)]
    return df.agg(F.array(*rows).alias("all")).select(F.inline("all"))


def match_columns(before: DataFrame, after: DataFrame, key: str = ROW_ID) -> DataFrame:
    """(original, rewritten): for each column of ``before`` the first equal column of ``after``."""
    a = column_signatures(before, key).select(
        F.col("column").alias("original"), "rows", "signature", F.col("position").alias("original_position"))
    b = column_signatures(after, key).select(
        F.col("column").alias("rewritten"), "rows", "signature", "position")
    return (a.join(b, ["rows", "signature"])
            .groupBy("original", "original_position")
            .agg(F.min_by("rewritten", "position").alias("rewritten"))
            .select("original", "rewritten"))


def confirm_matches(before: DataFrame, after: DataFrame, pairs: list[tuple[str, str]],
                    key: str = ROW_ID) -> DataFrame:
    """(original, rewritten, differing): exact recount of matched pairs by a join on the key."""
    a = before.select(F.col(key), *[quoted(o).alias(f"a{i}") for i, (o, _) in enumerate(pairs)])
    b = after.select(F.col(key), *[quoted(r).alias(f"b{i}") for i, (_, r) in enumerate(pairs)])
    joined = a.join(b, key, "full")
    rows = [F.struct(F.lit(o).alias("original"), F.lit(r).alias("rewritten"),
                     F.count_if(~F.col(f"a{i}").cast("string").eqNullSafe(F.col(f"b{i}").cast("string")))
                     .alias("differing"))
            for i, (o, r) in enumerate(pairs)]
    return joined.agg(F.array(*rows).alias("all")).select(F.inline("all"))


def preservation_check(before: DataFrame, after: DataFrame, key: str = ROW_ID,
                       least_share: float = 0.8) -> DataFrame:
    """One row: row counts, matched columns, and whether the rewrite kept the data.

    Kept means equal row counts and at least ``least_share`` of the original columns found
    unchanged under some name.
    """
    total = len([c for c in before.columns if c != key])
    matched = match_columns(before, after, key).agg(F.count(F.lit(1)).alias("matched_columns"))
    counts = (before.select(F.lit(1).alias("o"), F.lit(0).alias("r"))
              .unionAll(after.select(F.lit(0).alias("o"), F.lit(1).alias("r")))
              .agg(F.coalesce(F.sum("o"), F.lit(0)).alias("original_rows"),
                   F.coalesce(F.sum("r"), F.lit(0)).alias("rewritten_rows")))
    same = F.col("original_rows") == F.col("rewritten_rows")
    share = F.col("matched_columns") / F.lit(float(max(total, 1)))
    both = counts.unionByName(matched, allowMissingColumns=True).agg(
        *[F.max(c).cast("bigint").alias(c) for c in ("original_rows", "rewritten_rows", "matched_columns")])
    return both.select(
        "original_rows", "rewritten_rows", same.alias("row_count_valid"),
        F.when(same, F.col("matched_columns")).otherwise(F.lit(0)).alias("matched_columns"),
        F.lit(total).cast("bigint").alias("total_columns"),
        (same & (F.lit(total == 0) | (share >= least_share))).alias("values_preserved"))


def changed_cells(before: DataFrame, after: DataFrame, key: str = ROW_ID) -> DataFrame:
    """(key, column, before, after) of every cell that differs, in columns both tables have."""
    shared = [c for c in before.columns if c in after.columns and c != key]
    a = before.select(F.col(key), *[quoted(c).cast("string").alias(f"a{i}") for i, c in enumerate(shared)])
    b = after.select(F.col(key), *[quoted(c).cast("string").alias(f"b{i}") for i, c in enumerate(shared)])
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"a{i}").alias("before"), F.col(f"b{i}").alias("after"))
        for i, c in enumerate(shared)])
    diff = F.filter(cells, lambda s: ~s["before"].eqNullSafe(s["after"]))
    return a.join(b, key, "full").select(F.col(key), F.inline(diff))
