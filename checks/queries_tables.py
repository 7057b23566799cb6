"""Cleaning, repair, validation, projection and comparison of tables."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from checks.catalog import query, table
from checks.fixtures import (
    CLEANED, FULL, MESSY, MESSY_TWICE, NULLED, SPACES, STRICT, TEXT_COLUMNS, adjusted_sql, messy,
    messy_twice, sql_bool, sql_number, sql_repair,
)
from tablewright.functions import lenient, numbers, text
from tablewright.operators import dates, unmatched
from tablewright.plans.table_function import Contract, register_fix
from tablewright.operators import clean, compare, issues, padjust, profile, project, repair, validate
from tablewright.operators.clean import quoted
from tablewright.operators.snapshots import SnapshotStore
from tablewright.plans.harmonise import diagnose, preprocess, rule_diagnosis, run
from tablewright.plans.recipes import recipe, recipe_json
from tablewright.plans.resolve import mapping, resolve
from tablewright.session import scratch_path
from tablewright.plans.schema import STANDARD, TargetColumn, TargetSchema

STRING = T.StringType()

SQL_FC = sql_number('"log2FC"')
SQL_P = sql_number("adj_p")
SQL_P01 = f"CASE WHEN ({SQL_P}) < 0 THEN 0.0 WHEN ({SQL_P}) > 1 THEN 1.0 ELSE ({SQL_P}) END"
CLEAN_PV = CLEANED + f",\npv AS (SELECT row_id, {SQL_P01} AS p FROM cleaned)"


def nulled(spark, sf_dir):
    return clean.null_literals(messy(spark, sf_dir))


def cleaned(spark, sf_dir):
    return clean.clean_table(nulled(spark, sf_dir)).df


@query(f"""
WITH {CLEAN_PV}, {adjusted_sql()}
SELECT c.row_id, {sql_repair('"Gene_ID"')} AS "GeneSymbol", {SQL_FC} AS "FoldChange", pv.p AS "PValue",
       a.bh AS "PValue_bh"
FROM cleaned c JOIN pv USING (row_id) LEFT JOIN adjusted a ON a.p = pv.p
""")
def harmonise_expression(spark, sf_dir):
    """Clean, bind, repair, project to the builtin schema, and adjust the p-values."""
    prepared = preprocess(nulled(spark, sf_dir), STANDARD)
    out = project.project(prepared.df, STANDARD, prepared.mapping)
    adjusted = padjust.adjust(out, "PValue", {"PValue_bh": "bh"})
    return adjusted.withColumn("PValue_bh", F.round("PValue_bh", 9))


@query(f'WITH {NULLED} SELECT row_id, {", ".join(chr(34) + c + chr(34) for c in TEXT_COLUMNS)} FROM nulled')
def null_literals(spark, sf_dir):
    return nulled(spark, sf_dir)


@query(f'WITH {NULLED} SELECT row_id, "Gene_ID", "log2FC", adj_p, is_sig, visit, " site " FROM nulled')
def drop_empty_columns(spark, sf_dir):
    return clean.drop_empty_columns(nulled(spark, sf_dir))[0]


@query(f"""WITH {MESSY} SELECT row_id, {", ".join(f'trim("{c}", {SPACES}) AS "{c.strip()}"' for c in TEXT_COLUMNS)}
FROM messy""")
def trim_strings(spark, sf_dir):
    return clean.trim_column_names(clean.trim_strings(messy(spark, sf_dir)))


@query(f"WITH {MESSY_TWICE} SELECT DISTINCT * FROM twice")
def dedup_rows(spark, sf_dir):
    return clean.drop_duplicate_rows(messy_twice(spark, sf_dir))


@query(f"WITH {CLEANED} SELECT * FROM cleaned")
def clean_whole_table(spark, sf_dir):
    return cleaned(spark, sf_dir)


@query(f"WITH {MESSY} " + " UNION ALL ".join(
    f"""SELECT {i} AS position, '{c}' AS "column", count("{c}") AS non_null,
    count(*) FILTER (trim("{c}", {SPACES}) <> '') AS non_blank,
    count(*) FILTER (trim("{c}", {SPACES}) <> "{c}") AS trimmable, count(*) AS rows FROM messy"""
    for i, c in enumerate(TEXT_COLUMNS)))
def column_census(spark, sf_dir):
    return clean.column_census(messy(spark, sf_dir))


@query(f"""WITH {MESSY} SELECT row_id, {SQL_FC} AS fold_change, {SQL_P} AS p,
CAST(round_even({SQL_FC}, 0) AS BIGINT) AS fold_whole FROM messy""")
def lenient_numbers(spark, sf_dir):
    df = messy(spark, sf_dir)
    fc, p = quoted("log2FC"), quoted("adj_p")
    return df.select("row_id", lenient.to_number(fc, STRING).alias("fold_change"),
                     lenient.to_number(p, STRING).alias("p"), lenient.to_whole_number(fc, STRING).alias("fold_whole"))


@query(f"WITH {MESSY} SELECT row_id, {sql_bool('is_sig')} AS significant FROM messy")
def lenient_bools(spark, sf_dir):
    return messy(spark, sf_dir).select("row_id", lenient.to_boolean(F.col("is_sig"), STRING).alias("significant"))


@query(f"WITH {MESSY} SELECT row_id, CAST(try_strptime(visit, '%Y-%m-%d') AS DATE) AS visit FROM messy")
def lenient_dates(spark, sf_dir):
    return messy(spark, sf_dir).select("row_id", lenient.to_date(F.col("visit"), STRING).alias("visit"))


@query("""
SELECT l_orderkey, l_partkey, l_linenumber, l_discount, l_quantity,
  round(log2(greatest(l_discount, 1e-10)), 9) AS discount_log2,
  round(log10(greatest(l_extendedprice, 1e-10)), 9) AS price_log10,
  abs(l_discount - 0.05) AS distance, round_even(l_quantity / 2, 0) AS half, -l_tax AS negated
FROM lineitem
""")
def transforms_scalar(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_discount", "l_quantity",
        F.round(numbers.log2(F.col("l_discount")), 9).alias("discount_log2"),
        F.round(numbers.log10(F.col("l_extendedprice")), 9).alias("price_log10"),
        F.abs(F.col("l_discount") - 0.05).alias("distance"),
        numbers.round_half_even(F.col("l_quantity") / 2).alias("half"), F.negative("l_tax").alias("negated"))


TRANSFORMS = TargetSchema("transforms", columns=[
    TargetColumn("Gene_ID", transform="uppercase"), TargetColumn("log2FC", "float", transform="abs"),
    TargetColumn("adj_p", "float", transform="log10"), TargetColumn("is_sig", transform="lowercase"),
    TargetColumn("visit", transform="trim")])


@query(f"""WITH {MESSY} SELECT row_id, upper("Gene_ID") AS "Gene_ID", abs({SQL_FC}) AS "log2FC",
round(log10(greatest(CASE WHEN ({SQL_P}) IS NOT NULL THEN ({SQL_P}) END,
      CASE WHEN ({SQL_P}) IS NOT NULL THEN 1e-10 END)), 9) AS adj_p,
lower(is_sig) AS is_sig, trim(visit, {SPACES}) AS visit FROM messy""")
def transforms_in_place(spark, sf_dir):
    df = messy(spark, sf_dir).drop("note", "blank", " site ")
    bound = {c.name: c.name for c in TRANSFORMS.columns}
    return repair.apply_transforms(df, TRANSFORMS, bound).withColumn("adj_p", F.round("adj_p", 9))


@query(f"""WITH {MESSY} SELECT row_id, {SQL_FC} AS "log2FC", {SQL_P} AS adj_p, {sql_bool('is_sig')} AS is_sig,
CAST(try_strptime(visit, '%Y-%m-%d') AS DATE) AS visit FROM messy""")
def types_in_place(spark, sf_dir):
    df = messy(spark, sf_dir).select("row_id", "log2FC", "adj_p", "is_sig", "visit")
    schema = TargetSchema("types", columns=[
        TargetColumn("log2FC", "float"), TargetColumn("adj_p", "float"), TargetColumn("is_sig", "bool"),
        TargetColumn("visit", "date")])
    return repair.convert_types(df, schema, {c.name: c.name for c in schema.columns})


@query(f"""WITH {MESSY} SELECT row_id, "Gene_ID" AS raw,
{sql_repair('"Gene_ID"')} AS repaired,
regexp_matches("Gene_ID", '^([A-Za-z][A-Za-z0-9-]*)$') AS matched FROM messy""")
def pattern_repair(spark, sf_dir):
    col = STANDARD.columns[0]
    raw = F.col("Gene_ID")
    return messy(spark, sf_dir).select(
        "row_id", raw.alias("raw"), repair.repair_pattern(raw, col).alias("repaired"),
        text.matches_from_start(raw, col.validation_regex).alias("matched"))


@query(f"WITH {MESSY} SELECT row_id, {SQL_P01} AS clamped FROM messy")
def range_clamp(spark, sf_dir):
    p = lenient.to_number(F.col("adj_p"), STRING)
    return messy(spark, sf_dir).select("row_id", repair.clamp_range(p, STANDARD.columns[2]).alias("clamped"))


@query(f"WITH {MESSY} SELECT row_id, coalesce({SQL_FC}, 0.5) AS filled FROM messy")
def null_fill(spark, sf_dir):
    col = TargetColumn("FoldChange", "float", default_value=0.5)
    fc = lenient.to_number(quoted("log2FC"), STRING)
    return messy(spark, sf_dir).select("row_id", repair.fill_null(fc, col).alias("filled"))


@query(f"""WITH {NULLED} SELECT row_id, {sql_repair('"Gene_ID"')} AS "Gene_ID", {SQL_FC} AS "log2FC", {SQL_P01} AS adj_p,
is_sig, visit FROM nulled""")
def auto_fix(spark, sf_dir):
    df = nulled(spark, sf_dir).drop("note", "blank", " site ")
    fixed, _ = repair.auto_fix(df, STANDARD, mapping(resolve(df.columns, STANDARD)))
    return fixed


@query(f"""WITH {NULLED}, s AS (SELECT "Gene_ID" AS g, {sql_repair('"Gene_ID"')} AS r, "log2FC" AS f, {SQL_FC} AS fn,
  adj_p AS a, {SQL_P} AS p FROM nulled)
SELECT 'GeneSymbol' AS target, 'Gene_ID' AS "column", 0 AS coerced,
  count(*) FILTER (NOT regexp_matches(g, '^[A-Za-z][A-Za-z0-9-]*$')) AS pattern_before,
  count(*) FILTER (NOT regexp_matches(r, '^[A-Za-z][A-Za-z0-9-]*$')) AS pattern_after,
  NULL::BIGINT AS clamped, count(*) FILTER (g IS NULL) AS nulls, count(*) AS rows FROM s
UNION ALL SELECT 'FoldChange', 'log2FC', count(*) FILTER (f IS NOT NULL AND fn IS NULL), NULL, NULL, NULL,
  count(*) FILTER (fn IS NULL), count(*) FROM s
UNION ALL SELECT 'PValue', 'adj_p', count(*) FILTER (a IS NOT NULL AND p IS NULL), NULL, NULL,
  count(*) FILTER (p < 0 OR p > 1), count(*) FILTER (p IS NULL), count(*) FROM s
""")
def repair_counts(spark, sf_dir):
    df = nulled(spark, sf_dir)
    _, counters = repair.auto_fix(df, STANDARD, mapping(resolve(df.columns, STANDARD)))
    return counters.select("target", "column", "coerced", "pattern_before", "pattern_after", "clamped", "nulls", "rows")


def _findings_sql(parts):
    return "SELECT * FROM (" + " UNION ALL ".join(
        f"""SELECT '{col}' AS "column", '{level}' AS level, '{rule}' AS rule,
        'Column ''{col}'' has ' || count(*) || ' {words}' AS description, count(*) AS affected_rows
        FROM s WHERE {test}""" for col, level, rule, words, test in parts) + ") WHERE affected_rows > 0"


@query(f"""WITH {NULLED}, s AS (SELECT "Gene_ID" AS g, "log2FC" AS f, {SQL_FC} AS fn, adj_p AS a, {SQL_P} AS p FROM nulled)
""" + _findings_sql([
    ("GeneSymbol", "error", "nulls", "null values", "g IS NULL"),
    ("GeneSymbol", "error", "pattern", "values not matching pattern", "NOT regexp_matches(g, '^[A-Za-z][A-Za-z0-9-]*$')"),
    ("FoldChange", "error", "nulls", "null values", "f IS NULL"),
    ("FoldChange", "error", "non_numeric", "non-numeric values", "f IS NOT NULL AND fn IS NULL"),
    ("PValue", "error", "nulls", "null values", "a IS NULL"),
    ("PValue", "error", "non_numeric", "non-numeric values", "a IS NOT NULL AND p IS NULL"),
    ("PValue", "error", "below_minimum", "values below minimum 0.0", "p < 0"),
    ("PValue", "error", "above_maximum", "values above maximum 1.0", "p > 1"),
]))
def validate_findings(spark, sf_dir):
    df = nulled(spark, sf_dir)
    return validate.validate_table(df, STANDARD, mapping(resolve(df.columns, STANDARD)))


@query(f"""WITH {NULLED}, s AS (SELECT "Gene_ID" AS g, "log2FC" AS f, {SQL_FC} AS fn, adj_p AS a, {SQL_P} AS p FROM nulled)
""" + _findings_sql([
    ("GeneSymbol", "error", "nulls", "null values", "g IS NULL"),
    ("GeneSymbol", "error", "pattern", "values not matching pattern", "NOT regexp_matches(g, '^[A-Z][A-Z0-9]*$')"),
    ("FoldChange", "warning", "nulls", "null values", "f IS NULL"),
    ("FoldChange", "error", "non_numeric", "non-numeric values", "f IS NOT NULL AND fn IS NULL"),
    ("FoldChange", "warning", "non_integer", "non-integer values", "fn <> round_even(fn, 0)"),
    ("FoldChange", "error", "below_minimum", "values below minimum 1.0", "fn < 1"),
    ("FoldChange", "error", "above_maximum", "values above maximum 300.0", "fn > 300"),
    ("PValue", "error", "nulls", "null values", "a IS NULL"),
    ("PValue", "error", "below_minimum", "values below minimum 0.0", "p < 0"),
    ("PValue", "error", "above_maximum", "values above maximum 1.0", "p > 1"),
]) + """ UNION ALL SELECT 'Dose', 'error', 'missing', 'Required column ''Dose'' not found in data', count(*) FROM s
UNION ALL SELECT 'Batch', 'warning', 'missing', 'Optional column ''Batch'' not found', count(*) FROM s""")
def validate_strict(spark, sf_dir):
    df = nulled(spark, sf_dir)
    return validate.validate_table(df, STRICT, mapping(resolve(df.columns, STRICT)))


@query(f"""WITH {CLEAN_PV}, {adjusted_sql()}
SELECT c.row_id, "Gene_ID" AS "GeneSymbol", {SQL_FC} AS "FoldChange", {SQL_P} AS "PValue",
  {sql_bool('is_sig')} AS "Significant", CAST(try_strptime(visit, '%Y-%m-%d') AS DATE) AS "Visit", site AS "Site",
  round(log2(CASE WHEN ({SQL_FC}) IS NOT NULL THEN greatest({SQL_FC}, 1e-10) END), 9) AS "FC_log2",
  a.bh AS "P_bh", a."by" AS "P_by", a.bonferroni AS "P_bonf", a.holm AS "P_holm", 7::BIGINT AS "Batch"
FROM cleaned c JOIN pv USING (row_id) LEFT JOIN adjusted a ON a.p = pv.p""")
def project_full_schema(spark, sf_dir):
    df = cleaned(spark, sf_dir)
    out = project.project(df, FULL, mapping(resolve(df.columns, FULL)))
    return out.withColumns({c: F.round(c, 9) for c in ("FC_log2", "P_bh", "P_by", "P_bonf", "P_holm")})


@query(f"""WITH {CLEANED} SELECT "Gene_ID" AS "GeneSymbol", "log2FC" AS "FoldChange", adj_p AS "PValue",
row_id, is_sig, visit, site FROM cleaned""")
def restructure_columns(spark, sf_dir):
    df = cleaned(spark, sf_dir)
    return project.restructure(df, STANDARD, mapping(resolve(df.columns, STANDARD)))


def _rewritten(df):
    renamed = project.restructure(df, STANDARD, mapping(resolve(df.columns, STANDARD)))
    return renamed.withColumn("visit", F.upper(F.concat("visit", F.lit("x"))))


@query(f"""WITH {CLEANED} SELECT count(*) AS original_rows, count(*) AS rewritten_rows, true AS row_count_valid,
5::BIGINT AS matched_columns, 6::BIGINT AS total_columns, true AS values_preserved FROM cleaned""")
def preservation_check(spark, sf_dir):
    df = cleaned(spark, sf_dir)
    return compare.preservation_check(df, _rewritten(df))


@query(f"""WITH {CLEANED} SELECT CASE WHEN count(*) > 0 THEN o END AS original, r AS rewritten
FROM cleaned, (VALUES ('Gene_ID', 'GeneSymbol'), ('log2FC', 'FoldChange'), ('adj_p', 'PValue'),
               ('is_sig', 'is_sig'), ('site', 'site')) v(o, r) GROUP BY o, r""")
def match_columns(spark, sf_dir):
    df = cleaned(spark, sf_dir)
    return compare.match_columns(df, _rewritten(df))


@query(f"""WITH {CLEANED} SELECT 'Gene_ID' AS original, 'GeneSymbol' AS rewritten, count(*) FILTER (false) AS differing FROM cleaned
UNION ALL SELECT 'visit', 'visit', count(visit) FROM cleaned""")
def confirm_matches(spark, sf_dir):
    df = cleaned(spark, sf_dir)
    return compare.confirm_matches(df, _rewritten(df), [("Gene_ID", "GeneSymbol"), ("visit", "visit")])


NULL_COUNTS = "+".join(f"""count(*) FILTER ("{c}" IS NULL)""" for c in TEXT_COLUMNS)
FIXED_NULLS = f"""(SELECT count(*) FILTER ("Gene_ID" IS NULL) + count(*) FILTER (({SQL_FC}) IS NULL)
  + count(*) FILTER (({SQL_P}) IS NULL) + count(*) FILTER (is_sig IS NULL) + count(*) FILTER (visit IS NULL)
  + count(*) FILTER (site IS NULL) FROM cleaned)"""


@query(f"""WITH {CLEANED}, m AS (SELECT 'rows' AS measure, (SELECT count(*) FROM messy) AS "before",
    (SELECT count(*) FROM cleaned) AS "after"
  UNION ALL SELECT 'columns', 8, 6 UNION ALL SELECT 'nulls', (SELECT {NULL_COUNTS} FROM messy), {FIXED_NULLS})
SELECT measure, "before", "after", "after" - "before" AS change FROM m""")
def compare_tables(spark, sf_dir):
    prepared = preprocess(nulled(spark, sf_dir), STANDARD)
    return compare.compare_tables(messy(spark, sf_dir), prepared.df)


@query(f"""WITH {NULLED} SELECT row_id, c AS "column", b AS "before", a AS "after" FROM (
  SELECT row_id, 'Gene_ID' AS c, "Gene_ID" AS b, {sql_repair('"Gene_ID"')} AS a FROM nulled
  UNION ALL SELECT row_id, 'adj_p', adj_p, CASE WHEN ({SQL_P}) < 0 THEN '0.0000' WHEN ({SQL_P}) > 1 THEN '1.0000' ELSE adj_p END
  FROM nulled) WHERE a IS DISTINCT FROM b""")
def changed_cells(spark, sf_dir):
    before = nulled(spark, sf_dir).select("row_id", "Gene_ID", "adj_p")
    p = lenient.to_number(F.col("adj_p"), STRING)
    after = before.withColumn("Gene_ID", repair.repair_pattern(F.col("Gene_ID"), STANDARD.columns[0])).withColumn(
        "adj_p", F.when((p < 0) | (p > 1), F.format_string("%.4f", numbers.clamp(p, 0, 1))).otherwise(F.col("adj_p")))
    return compare.changed_cells(before, after)


PREP_ISSUES = f"""
prep AS (SELECT "Gene_ID" AS g, {sql_repair('"Gene_ID"')} AS r, "log2FC" AS f, {SQL_FC} AS fn, {SQL_P} AS p FROM cleaned),
prep_issues AS (SELECT * FROM (
  SELECT 'Gene_ID' AS "column", 'pattern_violation' AS issue_type, 'warning' AS severity,
    count(*) || ' cells break the pattern ^[A-Za-z][A-Za-z0-9\\-]*$' AS description, count(*) AS affected_rows
    FROM prep WHERE NOT regexp_matches(r, '^[A-Za-z][A-Za-z0-9-]*$')
  UNION ALL SELECT 'Gene_ID', 'null_values', 'critical', count(*) || ' required cells are missing',
    count(*) FROM prep WHERE g IS NULL
  UNION ALL SELECT 'log2FC', 'coercion_failure', 'warning', count(*) || ' values could not be read as float', count(*)
    FROM prep WHERE f IS NOT NULL AND fn IS NULL
  UNION ALL SELECT 'log2FC', 'null_values', 'critical', count(*) || ' required cells are missing',
    count(*) FROM prep WHERE fn IS NULL
  UNION ALL SELECT 'adj_p', 'null_values', 'critical', count(*) || ' required cells are missing',
    count(*) FROM prep WHERE p IS NULL) WHERE affected_rows > 0)
"""


@query(f"WITH {CLEANED}, {PREP_ISSUES} SELECT * FROM prep_issues")
def preprocess_issues(spark, sf_dir):
    prepared = preprocess(nulled(spark, sf_dir), STANDARD)
    return prepared.issues.where(F.col("issue_type") != issues.NOTE).drop("suggested_fix")


@query(f"""WITH {CLEANED}, {PREP_ISSUES}
SELECT severity, count(*) AS issues, CAST(sum(affected_rows) AS BIGINT) AS affected_rows FROM prep_issues GROUP BY severity""")
def issues_by_severity(spark, sf_dir):
    prepared = preprocess(nulled(spark, sf_dir), STANDARD)
    return issues.by_severity(prepared.issues.where(F.col("issue_type") != issues.NOTE))


@query(f"""WITH {CLEANED}, {PREP_ISSUES}
SELECT severity, CAST(CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS INTEGER) AS rank, CAST(number AS INTEGER) AS number,
  severity || '/' || issue_type || ' ' || "column" || ': ' || description || ' -> look' AS note
FROM (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY "column", issue_type, description) AS number FROM prep_issues)""")
def issues_rendered(spark, sf_dir):
    prepared = preprocess(nulled(spark, sf_dir), STANDARD)
    found = prepared.issues.where(F.col("issue_type") != issues.NOTE).withColumn("suggested_fix", F.lit("look"))
    return issues.ranked(found).select("severity", "rank", "number", "note")


@query(f"""WITH {CLEANED}, prep AS (SELECT "Gene_ID" AS g, {sql_repair('"Gene_ID"')} AS r, {SQL_P} AS p FROM cleaned)
SELECT * FROM (
  SELECT 1 AS step, '*' AS "column", 'all_null' AS metric, least(count(*), 1) AS n FROM prep
  UNION ALL SELECT 1, '*', 'blank', least(count(*), 1) FROM prep
  UNION ALL SELECT 1, '*', 'trimmed', least(count(*), 1) FROM prep
  UNION ALL SELECT 1, '*', 'renamed', least(count(*), 1) FROM prep
  UNION ALL SELECT 1, '*', 'shape', least(count(*), 1) FROM prep
  UNION ALL SELECT 1, '*', 'duplicates', (SELECT count(*) FROM messy) - (SELECT count(*) FROM cleaned)
  UNION ALL SELECT 4, 'log2FC', 'converted', count(*) FROM prep
  UNION ALL SELECT 4, 'adj_p', 'converted', count(*) FROM prep
  UNION ALL SELECT 5, 'Gene_ID', 'pattern_fixed', count(*) FILTER (NOT regexp_matches(g, '^[A-Za-z][A-Za-z0-9-]*$'))
    - count(*) FILTER (NOT regexp_matches(r, '^[A-Za-z][A-Za-z0-9-]*$')) FROM prep
  UNION ALL SELECT 6, 'adj_p', 'clamped', count(*) FILTER (p < 0 OR p > 1) FROM prep) WHERE n > 0""")
def preprocess_changes(spark, sf_dir):
    df = messy(spark, sf_dir)
    # blanks are part of the fixture, so literals are turned to NULL in the other columns only
    ready = df.select("row_id", *[
        lenient.na_to_null(quoted(c)).alias(c) if c != "note" else quoted(c) for c in TEXT_COLUMNS])
    return preprocess(ready, STANDARD).changes.select("step", "column", "metric", "n")


@query(f"""WITH {CLEANED}, {PREP_ISSUES} SELECT count(*) = 0 AS is_valid,
CASE WHEN count(*) = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS quality_score, count(*) AS issues,
'open issues: ' || count(*) AS summary FROM prep_issues""")
def rule_diagnosis_row(spark, sf_dir):
    prepared = preprocess(nulled(spark, sf_dir), STANDARD)
    return rule_diagnosis(prepared.issues.where(F.col("issue_type") != issues.NOTE)).row()


@query(f"""WITH {NULLED}, s AS (SELECT "Gene_ID" AS g, "log2FC" AS f, {SQL_FC} AS fn, adj_p AS a, {SQL_P} AS p FROM nulled),
v AS (""" + _findings_sql([
    ("GeneSymbol", "error", "nulls", "null values", "g IS NULL"),
    ("GeneSymbol", "error", "pattern", "values not matching pattern", "NOT regexp_matches(g, '^[A-Za-z][A-Za-z0-9-]*$')"),
    ("FoldChange", "error", "nulls", "null values", "f IS NULL"),
    ("FoldChange", "error", "non_numeric", "non-numeric values", "f IS NOT NULL AND fn IS NULL"),
    ("PValue", "error", "nulls", "null values", "a IS NULL"),
    ("PValue", "error", "below_minimum", "values below minimum 0.0", "p < 0"),
    ("PValue", "error", "above_maximum", "values above maximum 1.0", "p > 1"),
]) + """)
SELECT 'schema' AS "column", 'schema_mismatch' AS issue_type, 'critical' AS severity, description, affected_rows FROM v
UNION ALL SELECT 'Gene_ID', 'null_values', 'warning', count(*) || ' null values', count(*) FROM s WHERE g IS NULL
UNION ALL SELECT 'log2FC', 'null_values', 'warning', count(*) || ' null values', count(*) FROM s WHERE f IS NULL
UNION ALL SELECT 'adj_p', 'null_values', 'warning', count(*) || ' null values', count(*) FROM s WHERE a IS NULL
UNION ALL SELECT '*', 'duplicates', 'info', n || ' duplicate rows', n FROM
  (SELECT CAST(sum(c - 1) AS BIGINT) AS n FROM (SELECT count(*) AS c FROM s GROUP BY g, f, a)) WHERE n > 0""")
def diagnose_table(spark, sf_dir):
    df = nulled(spark, sf_dir).select("row_id", "Gene_ID", "log2FC", "adj_p")
    return diagnose(df, STANDARD).issues.drop("suggested_fix")


@query(f"""WITH {MESSY} SELECT row_id, coalesce("Gene_ID", 'NULL') AS "Gene_ID", coalesce(adj_p, 'NULL') AS adj_p
FROM messy ORDER BY row_id LIMIT 100""")
def display_cells(spark, sf_dir):
    df = messy(spark, sf_dir).select("row_id", "Gene_ID", "adj_p")
    return profile.shown_cells(df).withColumn("row_id", F.col("row_id").cast("bigint"))


@query(f"""WITH {CLEANED} SELECT (SELECT {NULL_COUNTS} FROM messy) AS nulls_before, {FIXED_NULLS} AS nulls,
{FIXED_NULLS} < (SELECT {NULL_COUNTS} FROM messy) AS reduced""")
def null_delta(spark, sf_dir):
    prepared = preprocess(nulled(spark, sf_dir), STANDARD)
    return profile.null_delta(messy(spark, sf_dir), prepared.df)




_REWRITTEN = """
after_ AS (SELECT c_custkey + 1 AS row_id, c_name AS "full name", CAST(CASE WHEN c_nationkey < 5 THEN c_nationkey + 100 ELSE c_nationkey END AS VARCHAR) AS c_nationkey,
  c_acctbal, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS segment, c_custkey % 3 AS added FROM customer),
olds AS (SELECT unnest(['c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS "column", unnest([c_name, c_nationkey::VARCHAR, c_acctbal::VARCHAR, c_mktsegment]) AS v FROM customer),
news AS (SELECT unnest(['full name', 'c_nationkey', 'c_acctbal', 'segment', 'added']) AS found, unnest(["full name", c_nationkey, c_acctbal::VARCHAR, segment, added::VARCHAR]) AS v FROM after_),
old_sets AS (SELECT "column", list_sort(list(coalesce(v, '-'))) AS vs FROM olds GROUP BY 1),
new_sets AS (SELECT found, list_sort(list(coalesce(v, '-'))) AS vs FROM news GROUP BY 1),
exact_ AS (SELECT "column", arg_min(found, CASE WHEN "column" = found THEN 0 ELSE 1 END) AS found FROM old_sets JOIN new_sets USING (vs) GROUP BY 1),
shares AS (SELECT o."column", n.found, count(*) AS both_ FROM (SELECT DISTINCT "column", v FROM olds) o JOIN (SELECT DISTINCT found, v FROM news) n USING (v)
  WHERE o."column" NOT IN (SELECT "column" FROM exact_) AND n.found NOT IN (SELECT found FROM exact_) GROUP BY 1, 2),
best AS (SELECT "column", found, both_ / (SELECT count(DISTINCT v) FROM olds WHERE olds."column" = shares."column") AS share,
  row_number() OVER (PARTITION BY "column" ORDER BY "column" = found DESC, both_ DESC, found) AS n FROM shares
  WHERE both_ >= 0.5 * (SELECT count(DISTINCT v) FROM olds WHERE olds."column" = shares."column")),
fates AS (
  SELECT "column", CASE WHEN "column" = found THEN 'kept' ELSE 'renamed' END AS fate, found, 1.0::DOUBLE AS share FROM exact_
  UNION ALL SELECT "column", 'changed', found, round(share, 6) FROM best WHERE n = 1)"""


@query(f"""WITH {_REWRITTEN.strip()}
SELECT * FROM fates
UNION ALL SELECT DISTINCT "column", 'missing', NULL, 0.0 FROM olds WHERE "column" NOT IN (SELECT "column" FROM fates)
UNION ALL SELECT DISTINCT found, 'new', found, 0.0 FROM news WHERE found NOT IN (SELECT found FROM fates)""")
def unmatched_columns(spark, sf_dir):
    """A rewritten table in another order: a renamed column, changed values, changed rows of an unnamed one, one lost and one new."""
    before = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "row_id")
    after = before.select(
        (F.col("row_id") + 1).alias("row_id"), F.col("c_name").alias("full name"),
        F.when(F.col("c_nationkey") < 5, F.col("c_nationkey") + 100).otherwise(F.col("c_nationkey")).cast("string").alias("c_nationkey"), "c_acctbal",
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"), (F.col("row_id") % 3).alias("added")).orderBy("c_acctbal")
    return unmatched.column_fates(before, after).withColumn("share", F.round("share", 6))


@query(f"""WITH {MESSY}, s AS (SELECT row_id, "Gene_ID" AS g, upper(trim("Gene_ID", ' ' || chr(9))) AS symbol, {sql_number('"log2FC"')} AS fc, "log2FC" AS f FROM messy)
SELECT row_id, CASE WHEN f IS NOT NULL AND fc IS NOT NULL THEN symbol END AS symbol, fc AS change,
  CASE WHEN fc IS NULL THEN 'ValueError' WHEN symbol IS NULL THEN 'symbol is missing' WHEN fc < -100 OR fc > 400 THEN 'change is out of range'
    WHEN NOT regexp_full_match(symbol, '[A-Z][A-Z0-9]*') THEN 'symbol does not match' END AS contract_error FROM s""")
def fix_udtf(spark, sf_dir):
    """A fix called from SQL on a table; rows that break its contract say why."""
    def fix(row):
        symbol = row["Gene_ID"]
        return {"symbol": None if symbol is None else symbol.strip(" \t").upper(), "change": float(row["log2FC"])}

    contract = Contract('Gene_ID string, log2FC string', "symbol string, change double", keep=("row_id",), required=("symbol",),
                        ranges={"change": (-100.0, 400.0)}, patterns={"symbol": "[A-Z][A-Z0-9]*"})
    register_fix(spark, "fix_symbols", fix, contract)
    messy(spark, sf_dir).createOrReplaceTempView("messy_symbols")
    called = spark.sql("SELECT * FROM fix_symbols(TABLE(SELECT row_id, Gene_ID, log2FC FROM messy_symbols))")
    return called.withColumn("contract_error", F.regexp_extract("contract_error", "^[^:]*", 0))


@query("""WITH o AS (SELECT o_orderkey AS row_id, CAST(o_orderdate AS DATE) AS d, o_orderkey % 97 = 0 AS odd, day(o_orderdate) <= 12 AS low FROM orders)
SELECT row_id, CASE WHEN NOT odd THEN d END AS day_first, d AS month_first, CASE WHEN NOT odd THEN d END AS named,
  CASE WHEN low THEN make_date(year(d), day(d), month(d)) END AS unsure FROM o""")
def lenient_dates_by_column(spark, sf_dir):
    """Days first or months first for whole columns; where no day settles it, months first; what has another format is not read."""
    o, d = table(spark, sf_dir, "orders"), F.col("o_orderdate")
    odd = F.col("o_orderkey") % 97 == 0
    texts = o.select(
        F.col("o_orderkey").alias("row_id"), F.when(odd, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "dd/MM/yyyy")).alias("day_first"),
        F.date_format(d, "M/d/yyyy").alias("month_first"), F.when(odd, "soon").otherwise(F.date_format(d, "d MMM yyyy")).alias("named"),
        F.when(F.dayofmonth(d) <= 12, F.date_format(d, "dd/MM/yyyy")).alias("unsure"))
    typed, _ = dates.dates_by_column(texts, ["day_first", "month_first", "named", "unsure"])
    return typed


@query(f"""WITH {CLEANED}, r AS (SELECT row_id, {sql_repair('"Gene_ID"')} AS g, {SQL_FC} AS f, coalesce({SQL_P01}, 1.0) AS p FROM cleaned),
t AS (SELECT row_id, 'table' AS kind, g AS "GeneSymbol", f AS "FoldChange", p AS "PValue", NULL AS fix, NULL::BOOLEAN AS worked FROM r WHERE g IS NOT NULL AND f IS NOT NULL)
SELECT * FROM t
UNION ALL SELECT 1, 'attempt', NULL, NULL, NULL, 'broken', false UNION ALL SELECT 2, 'attempt', NULL, NULL, NULL, 'clamps', true
UNION ALL SELECT 3, 'attempt', NULL, NULL, NULL, 'fills', true
UNION ALL SELECT count(*), 'rows in the last snapshot', NULL, NULL, NULL, NULL, true FROM t""")
def run_with_recipes(spark, sf_dir):
    """The whole run with recipes: one that fails, one that does not settle the issues, and one that does; with snapshots."""
    recipes = {"broken": [{"op": "convert", "column": "nowhere", "type": "float"}], "clamps": [{"op": "clamp", "column": "PValue", "low": 0, "high": 1}],
               "fills": [{"op": "fill", "column": "PValue", "value": 1.0}, {"op": "drop_nulls", "columns": ["GeneSymbol", "FoldChange"]}]}
    store = SnapshotStore(spark, scratch_path(spark, "run-snapshots"))
    outcome = run(nulled(spark, sf_dir), STANDARD, {name: recipe(recipe_json(steps)) for name, steps in recipes.items()}, snapshots=store, min_severity="warning")
    if not outcome.success:
        raise ValueError("the run did not end with a valid table")
    attempts = outcome.attempts_table(spark).select(F.col("iteration").cast("bigint").alias("row_id"), F.lit("attempt").alias("kind"), F.col("fix"), F.col("success").alias("worked"))
    _, last = store.latest_of("fix_attempt")
    kept = last.agg(F.count("*").alias("row_id")).select(
        "row_id", F.lit("rows in the last snapshot").alias("kind"), F.lit(None).cast("string").alias("fix"), F.lit(True).alias("worked"))
    table_rows = outcome.df.withColumns({"kind": F.lit("table"), "fix": F.lit(None).cast("string"), "worked": F.lit(None).cast("boolean")})
    return table_rows.unionByName(attempts.unionByName(kept), allowMissingColumns=True)
