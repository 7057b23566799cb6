"""Validation of a table against a schema: every rule is a counter, all counters share one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewright.functions import lenient, text
from tablewright.operators.clean import quoted
from tablewright.plans.schema import TargetColumn, TargetSchema

FINDING_SCHEMA = "column string, level string, rule string, description string, affected_rows bigint"


def column_rules(c: Column, dtype: T.DataType, col: TargetColumn) -> list[tuple[str, str, Column, str]]:
    """(rule, level, failing-row predicate, message template with one %d) of one column."""
    label = "Column '{}' has %d ".format(col.name.replace('%', '%%'))
    rules = [("nulls", "error" if col.required else "warning", c.isNull(), label + "null values")]
    if col.is_numeric:
        x = lenient.to_number(c, dtype)
        rules.append(("non_numeric", "error", c.isNotNull() & x.isNull(), label + "non-numeric values"))
        if col.type == "int":
            rules.append(("non_integer", "warning", x != F.rint(x), label + "non-integer values"))
        if col.min_value is not None:
            rules.append(("below_minimum", "error", x < F.lit(float(col.min_value)),
                          label + f"values below minimum {col.min_value}"))
        if col.max_value is not None:
            rules.append(("above_maximum", "error", x > F.lit(float(col.max_value)),
                          label + f"values above maximum {col.max_value}"))
    if col.validation_regex and col.type == "string":
        rules.append(("pattern", "error",
                      ~text.matches_from_start(c.cast("string"), col.validation_regex),
                      label + "values not matching pattern"))
    return rules


def validate_table(df: DataFrame, schema: TargetSchema, mapping: dict[str, str]) -> DataFrame:
    """Findings as rows (column, level, rule, description, affected_rows); empty when all rules hold."""
    types = {f.name: f.dataType for f in df.schema}
    findings = []
    for col in schema.columns:
        source = mapping.get(col.name)
        if source is None:
            level = "error" if col.required else "warning"
            words = ("Required column '{}' not found in data" if col.required
                     else "Optional column '{}' not found").format(col.name)
            findings.append(_finding(col.name, level, "missing", F.lit(words), F.count(F.lit(1)), always=True))
            continue
        for rule, level, fails, template in column_rules(quoted(source), types[source], col):
            n = F.count_if(fails)
            findings.append(_finding(
                col.name, level, rule, F.format_string(template.replace("%d", "%1$d"), n), n))
    counted = df.agg(F.array(*findings).alias("all"))
    return counted.select(F.inline(F.filter("all", lambda s: s.isNotNull())))


def _finding(name: str, level: str, rule: str, words: Column, n: Column, always: bool = False) -> Column:
    row = F.struct(
        F.lit(name).alias("column"), F.lit(level).alias("level"), F.lit(rule).alias("rule"),
        words.alias("description"), n.alias("affected_rows"))
    return row if always else F.when(n > 0, row)


def errors(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("level") == "error")


def warnings(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("level") == "warning")
