"""The whole-table jobs: rule-based preprocessing, diagnosis, the fix loop, recipes."""

from __future__ import annotations

import time
import traceback
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.operators import issues as iss
from tablewright.operators import validate
from tablewright.operators.clean import CleanResult, clean_table, data_columns
from tablewright.operators.profile import quick_check
from tablewright.operators.project import project
from tablewright.operators.repair import RepairPlan, apply_repairs, plan_repairs, repair_counters
from tablewright.operators.snapshots import SnapshotStore
from tablewright.plans.resolve import Binding, binding_notes, mapping, resolve
from tablewright.plans.schema import TargetSchema
from tablewright.session import materialise


@dataclass
class Prepared:
    """Result of the rule-based preprocessing."""

    df: DataFrame
    changes: DataFrame
    issues: DataFrame
    mapping: dict[str, str]
    bindings: dict[str, Binding]

    def is_valid(self, min_severity: str = "info") -> bool:
        return not blocking(self.issues, min_severity).head(1)

    def report(self) -> DataFrame:
        """(part, subject, finding, n, note): what was changed and what is open, as one table."""
        done = self.changes.select(F.lit("changed").alias("part"), F.col("column").alias("subject"), F.col("metric").alias("finding"),
                                   "n", F.col("detail").alias("note"))
        still = self.issues.select(F.concat(F.lit("open:"), "severity").alias("part"), F.col("column").alias("subject"),
                                   F.col("issue_type").alias("finding"), F.col("affected_rows").alias("n"), F.col("description").alias("note"))
        return done.unionByName(still)


def blocking(issues: DataFrame, min_severity: str = "info") -> DataFrame:
    """Issues that make a table invalid. Notes about name binding never do."""
    levels = iss.SEVERITIES[:iss.SEVERITIES.index(min_severity) + 1]
    return issues.where(F.col("severity").isin(levels) & (F.col("issue_type") != iss.NOTE))


def preprocess(df: DataFrame, schema: TargetSchema, transforms: bool = True,
               patterns: dict[str, list[str]] | None = None, keep_clean: bool = True) -> Prepared:
    """Clean, bind, transform, convert, repair patterns, clamp, fill nulls, report.

    One pass over the raw columns decides what to drop. The deduplicated table is written once
    (``keep_clean``), as the counters, the result and any adjustment read it again, and then read no
    more columns than they need. One pass over it counts everything; the result is a projection.
    """
    cleaned = clean_table(df)
    if keep_clean:
        cleaned.df = materialise(cleaned.df, "cleaned")
    bindings = resolve(cleaned.df.columns, schema, patterns)
    bound = mapping(bindings)
    plans = plan_repairs(cleaned.df, schema, bound, transforms)
    # one row per bound column
    counters = repair_counters(cleaned.df, plans).collect() if plans else []
    rows_after = counters[0].rows if counters else cleaned.df.count()
    by_target = {r.target: r for r in counters}
    changes = _changes(cleaned, plans, by_target, rows_after)
    found = _issues(plans, by_target) + [
        (target, iss.NOTE, "warning", note, rows_after, "bind the column by its source name")
        for target, note in binding_notes(bindings)]
    spark = df.sparkSession
    return Prepared(
        apply_repairs(cleaned.df, plans),
        spark.createDataFrame(changes, iss.CHANGE_SCHEMA), spark.createDataFrame(found, iss.ISSUE_SCHEMA),
        bound, bindings)


def _changes(cleaned: CleanResult, plans: list[RepairPlan], counters: dict, rows_after: int) -> list[tuple]:
    """(step, column, metric, n, detail) of everything that was touched; steps number the stages."""
    whole_table = [
        ("all_null", len(cleaned.all_null), ", ".join(cleaned.all_null)),
        ("blank", len(cleaned.blank), ", ".join(cleaned.blank)),
        ("trimmed", len(cleaned.trimmed), ", ".join(cleaned.trimmed)),
        ("duplicates", cleaned.rows_before - rows_after, ""),
        ("renamed", len(cleaned.renamed), ", ".join(cleaned.renamed)),
        ("shape", int((cleaned.rows_before, cleaned.columns_before) != (rows_after, len(cleaned.df.columns))),
         f"{cleaned.rows_before}x{cleaned.columns_before} to {rows_after}x{len(cleaned.df.columns)}"),
    ]
    out = [(1, "*", metric, n, detail) for metric, n, detail in whole_table]
    for p in plans:
        c, held = counters[p.col.name], cleaned.df.schema[p.source].dataType
        out += [(step, p.source, metric, n, detail) for step, metric, n, detail in (
            (3, "transformed", c.transformed, p.col.transform),
            (4, "converted", rows_after if held != p.col.spark_type else 0, f"{held.simpleString()} to {p.col.spark_type.simpleString()}"),
            (5, "pattern_fixed", c.pattern_before - c.pattern_after if p.checks_pattern else 0, p.col.validation_regex),
            (6, "clamped", c.clamped if p.checks_range else 0, f"{p.col.min_value} to {p.col.max_value}"),
            (7, "filled", c.nulls if p.col.default_value is not None else 0, str(p.col.default_value)))]
    return [(step, column, metric, int(n), detail or "") for step, column, metric, n, detail in out if n and n > 0]


def _issues(plans: list[RepairPlan], counters: dict) -> list[tuple]:
    """(column, issue_type, severity, description, affected_rows, suggested_fix) of what repairs could not settle."""
    out = []
    for p in plans:
        c = counters[p.col.name]
        missing = c.nulls if p.col.default_value is None else 0
        needed = p.col.required
        kinds = (
            ("coercion_failure", "warning", c.coerced, f"values could not be read as {p.col.type}", "look at the source values"),
            ("fractional_values", "warning", c.fractional, "values were rounded to integers", "declare the column as float"),
            ("pattern_violation", "warning", c.pattern_after, f"cells break the pattern {p.col.validation_regex}", "correct them by hand"),
            ("null_values", "critical" if needed else "info", missing, f"{'required' if needed else 'optional'} cells are missing",
             "give a default value or drop the rows" if needed else "a default value would fill them"),
        )
        out += [(p.source, kind, level, f"{n} {words}", n, advice) for kind, level, n, words, advice in kinds if n]
    return out


# diagnosis

@dataclass
class Diagnosis:
    is_valid: bool
    quality_score: float
    issues: DataFrame
    summary: str

    def row(self) -> DataFrame:
        """One row: is_valid, quality_score, issues, summary."""
        return self.issues.sparkSession.createDataFrame(
            [(self.is_valid, self.quality_score, self.issues.count(), self.summary)],
            "is_valid boolean, quality_score double, issues bigint, summary string")


def rule_diagnosis(found: DataFrame, min_severity: str = "info") -> Diagnosis:
    """Valid when no blocking issue is left; the score is 1.0, else 0.5."""
    n = blocking(found, min_severity).count()
    return Diagnosis(n == 0, 1.0 if n == 0 else 0.5, found, f"open issues: {n}")


def diagnose(df: DataFrame, schema: TargetSchema, min_severity: str = "critical") -> Diagnosis:
    """Quick-check findings and schema errors in one list; errors are critical schema mismatches."""
    bound = mapping(resolve(df.columns, schema))
    findings = validate.validate_table(df, schema, bound)
    both = iss.append_schema_errors(quick_check(df), validate.errors(findings))
    # a few rows per column: held as a local table so that later looks cost no scan
    kept = df.sparkSession.createDataFrame(both.collect(), iss.ISSUE_SCHEMA)
    return rule_diagnosis(kept, min_severity)


# fixes

@dataclass
class FixResult:
    success: bool
    df: DataFrame | None
    seconds: float
    error: str | None = None
    error_kind: str | None = None  # execution | logical
    changes: list[str] = field(default_factory=list)


def apply_fix(df: DataFrame, fix: Callable[[DataFrame], DataFrame]) -> FixResult:
    """Run a user's table function and check its result: a DataFrame with columns and rows.

    The result is written once, so that errors inside its tasks show up here and later steps
    read the outcome instead of running the function again.
    """
    start = time.time()
    try:
        out = df.transform(fix)
    except AssertionError as exc:  # transform() refuses anything but a DataFrame
        return FixResult(False, None, time.time() - start, str(exc), "logical")
    except Exception as exc:
        return FixResult(False, None, time.time() - start, f"{type(exc).__name__}: {exc}\n{traceback.format_exc()}",
                         "execution")
    if not out.columns:
        return FixResult(False, None, time.time() - start, "Result has no columns", "logical")
    try:
        out = materialise(out, "fix")
        rows, rows_before = out.count(), df.count()
    except Exception as exc:
        return FixResult(False, None, time.time() - start, f"{type(exc).__name__}: {exc}", "execution")
    if rows == 0:
        return FixResult(False, None, time.time() - start, "Result is empty", "logical")
    changes = []
    if len(out.columns) != len(df.columns):
        changes.append(f"Columns changed: {len(df.columns)} -> {len(out.columns)}")
    if rows != rows_before:
        changes.append(f"Rows changed: {rows_before} -> {rows}")
    return FixResult(True, out, time.time() - start, changes=changes)


def pandas_fix(body: Callable, schema: str) -> Callable[[DataFrame], DataFrame]:
    """A fix from a function on pandas batches; it sees one batch of rows at a time."""
    def over_batches(batches):
        for batch in batches:
            yield body(batch)

    return lambda df: df.mapInPandas(over_batches, schema)


@dataclass
class Outcome:
    """Result of the full run."""

    df: DataFrame | None
    success: bool
    prepared: Prepared
    diagnosis: Diagnosis
    attempts: list[tuple] = field(default_factory=list)

    def summary(self) -> DataFrame:
        spark = self.prepared.df.sparkSession
        return spark.createDataFrame(
            [(self.success, self.diagnosis.is_valid, self.diagnosis.quality_score,
              self.prepared.changes.count(), self.prepared.issues.count(), len(self.attempts))],
            "success boolean, is_valid boolean, quality_score double, changes bigint, issues bigint, attempts int")

    def attempts_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            self.attempts, "iteration int, attempt int, fix string, success boolean, error_kind string, "
                           "error string, seconds double")


def run(df: DataFrame, schema: TargetSchema, fixes: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
        auto_fix: bool = True, max_attempts: int = 3, snapshots: SnapshotStore | None = None,
        min_severity: str = "info") -> Outcome:
    """Preprocess, project once, diagnose, and try the given fixes until the table is valid.

    Execution errors do not count as attempts; there are at most twice ``max_attempts`` rounds.
    """
    held: dict[str, str] = {}  # the snapshot that already has the current table

    def keep(stage: str, table: DataFrame | None = None, **facts) -> None:
        """A snapshot of a new table, or one that refers to the data of the last."""
        if snapshots is not None:
            held["id"] = snapshots.refer(stage, held["id"], facts) if table is None else snapshots.create(stage, table, facts)

    keep("preprocessing", df, action="before_preprocessing")
    prepared = preprocess(df, schema, transforms=False)
    current = project(prepared.df, schema, prepared.mapping)
    if snapshots is not None or (fixes and auto_fix):
        current = materialise(current, "projected")
    keep("preprocessing", current, action="after_preprocessing")
    diagnosis = rule_diagnosis(prepared.issues, min_severity)
    keep("diagnosing", action="after_diagnosis", is_valid=diagnosis.is_valid)
    outcome = Outcome(current, diagnosis.is_valid, prepared, diagnosis)
    if diagnosis.is_valid or not auto_fix or not fixes:
        return outcome
    attempt = 0
    queue = list(fixes.items())
    for iteration in range(1, 2 * max_attempts + 1):
        name, fix = queue[(iteration - 1) % len(queue)]
        result = apply_fix(current, fix)
        counted = result.error_kind != "execution"
        attempt += counted
        outcome.attempts.append((iteration, attempt if counted else None, name, result.success,
                                 result.error_kind, result.error, result.seconds))
        if result.success:
            current = result.df
            keep("fix_attempt", current, attempt=attempt, fix=name)
            diagnosis = diagnose(current, schema, min_severity)
            outcome.df, outcome.diagnosis = current, diagnosis
            if diagnosis.is_valid:
                outcome.success = True
                break
        if attempt >= max_attempts:
            break
    keep("complete", attempts=attempt, success=outcome.success)
    return outcome


def structure_kept(before: DataFrame, after: DataFrame) -> list[str]:
    """Names of data columns that a rewrite dropped."""
    return [c for c in data_columns(before) if c not in after.columns]
