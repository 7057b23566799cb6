"""Issue and change tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

ISSUE_SCHEMA = ("column string, issue_type string, severity string, description string, "
                "affected_rows bigint, suggested_fix string")
CHANGE_SCHEMA = "step int, column string, metric string, n bigint, detail string"
SEVERITIES = ["critical", "warning", "info"]
NOTE = "column_binding"


def empty_issues(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ISSUE_SCHEMA)


def issue(column: Column, issue_type: str, severity: Column | str, description: Column,
          affected: Column, fix: str) -> Column:
    """One issue as a struct, NULL when no row is affected."""
    level = severity if isinstance(severity, Column) else F.lit(severity)
    row = F.struct(
        column.alias("column"), F.lit(issue_type).alias("issue_type"), level.alias("severity"),
        description.alias("description"), affected.cast("bigint").alias("affected_rows"),
        F.lit(fix).alias("suggested_fix"))
    return F.when(affected > 0, row)


def explode_issues(df: DataFrame, *structs: Column) -> DataFrame:
    """Rows of all non-NULL issue structs."""
    return df.select(F.inline(F.filter(F.array(*structs), lambda s: s.isNotNull())))


def by_severity(issues: DataFrame) -> DataFrame:
    """(severity, issues, affected_rows)."""
    return issues.groupBy("severity").agg(
        F.count(F.lit(1)).alias("issues"), F.sum("affected_rows").alias("affected_rows"))


def append_schema_errors(issues: DataFrame, errors: DataFrame) -> DataFrame:
    """Validation errors join the findings as critical schema mismatches."""
    as_issues = errors.select(
        F.lit("schema").alias("column"), F.lit("schema_mismatch").alias("issue_type"),
        F.lit("critical").alias("severity"), "description", "affected_rows",
        F.lit("Bind another column or convert this one").alias("suggested_fix"))
    return issues.unionByName(as_issues)


def ranked(issues: DataFrame) -> DataFrame:
    """The issues with ``rank`` (0 for the most severe level), ``number`` within the level, and a one-line ``note``."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity")) - 1
    # an issue table holds a few rows per column
    order = Window.partitionBy("severity").orderBy("column", "issue_type", "description")
    advice = F.when(F.col("suggested_fix") != "", F.concat(F.lit(" -> "), "suggested_fix")).otherwise("")
    note = F.concat(F.col("severity"), F.lit("/"), F.col("issue_type"), F.lit(" "), F.col("column"), F.lit(": "), F.col("description"), advice)
    return issues.select("*", rank.cast("int").alias("rank"), F.row_number().over(order).alias("number"), note.alias("note"))


def issue_notes(issues: DataFrame) -> list[str]:
    """The notes of all issues, most severe first."""
    return [r["note"] for r in ranked(issues).orderBy("rank", "number").select("note").collect()]
