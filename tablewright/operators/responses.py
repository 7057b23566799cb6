"""Diagnosis responses: reading JSON, issues and code out of free text, row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.functions.text import code_block, json_object

ISSUE_FIELDS = ("array<struct<column string, issue_type string, severity string, description string, "
                "affected_rows string, suggested_fix string>>")
DIAGNOSIS = f"is_valid boolean, overall_quality_score double, issues {ISSUE_FIELDS}, summary string"


def parse_responses(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add is_valid, quality_score, issues, summary and parsed.

    Fields that are missing take their defaults. A text that is no JSON object gives one
    ``parse_error`` issue.
    """
    body = json_object(F.col(text_col))
    # a JSON object parses as a map of raw values; anything else does not
    whole = F.try_parse_json(body)
    parsed = F.coalesce(F.startswith(F.schema_of_variant(whole), F.lit("OBJECT")), F.lit(False))
    d = F.from_json(F.when(parsed, body), DIAGNOSIS)
    lowered = F.lower(body)
    mentions = F.contains(lowered, F.lit("issue")) | F.contains(lowered, F.lit("problem"))
    words = F.when(mentions, "Response could not be parsed as JSON; it may hold the analysis as text.").otherwise(
        "Response could not be parsed as JSON.")
    error = F.array(F.struct(
        F.lit("unknown").alias("column"), F.lit("parse_error").alias("issue_type"), F.lit("critical").alias("severity"),
        words.alias("description"), F.lit("unknown").alias("affected_rows"),
        F.lit("Check the raw response").alias("suggested_fix")))
    work = df.withColumn("__ok", parsed).withColumn("__d", d)
    ok = F.col("__ok")
    return work.select(
        *[F.col(c) for c in df.columns], ok.alias("parsed"),
        F.coalesce("__d.is_valid", F.lit(False)).alias("is_valid"),
        F.coalesce("__d.overall_quality_score", F.lit(0.0)).alias("quality_score"),
        F.when(ok, F.coalesce("__d.issues", F.array().cast(ISSUE_FIELDS))).otherwise(error).alias("issues"),
        F.when(ok, F.coalesce("__d.summary", F.lit("Analysis completed"))).otherwise(
            F.lit("Analysis failed: JSON parse error")).alias("summary"))


def response_issues(parsed: DataFrame, key: str) -> DataFrame:
    """One row per issue of parsed responses."""
    return parsed.select(key, F.inline("issues"))


def extract_code(df: DataFrame, text_col: str = "text", language: str = "python", out: str = "code") -> DataFrame:
    return df.withColumn(out, code_block(F.col(text_col), language))


def preview_of(c: Column, keep: int = 500) -> Column:
    return F.substring(c, 1, keep)
