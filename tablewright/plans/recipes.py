"""Recipes: named steps with parameters, stored as JSON, so that a fix can be kept and run again."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from tablewright.functions import lenient, numbers, text
from tablewright.functions.vectors import fit_length
from tablewright.operators import clean
from tablewright.operators import library as lib
from tablewright.operators import tfidf
from tablewright.operators.clean import quoted
from tablewright.operators.repair import transform_value
from tablewright.plans.harmonise import FixResult, apply_fix


def _map_column(df: DataFrame, column: str, make) -> DataFrame:
    return df.withColumn(column, make(quoted(column), df.schema[column].dataType))


STEPS: dict[str, Callable[..., DataFrame]] = {
    "trim_strings": clean.trim_strings,
    "trim_names": clean.trim_column_names,
    "drop_duplicates": clean.drop_duplicate_rows,
    "drop_empty_columns": lambda df: clean.drop_empty_columns(df)[0],
    "rename": lambda df, columns: df.withColumnsRenamed(columns),
    "keep": lambda df, columns: df.select(*[quoted(c) for c in columns]),
    "transform": lambda df, column, name: _map_column(df, column, lambda c, t: transform_value(c, t, name)),
    "convert": lambda df, column, type: _map_column(df, column, lambda c, t: lenient.convert(c, t, type)),
    "clamp": lambda df, column, low=None, high=None: _map_column(
        df, column, lambda c, t: numbers.clamp(lenient.to_number(c, t), low, high)),
    "repair_symbol": lambda df, column: _map_column(df, column, lambda c, t: text.repair_symbol(c)),
    "fill": lambda df, column, value: _map_column(df, column, lambda c, t: F.coalesce(c, F.lit(value).try_cast(t))),
    "drop_nulls": lambda df, columns: df.dropna(subset=columns),
    "blank_to_null": lambda df, column: _map_column(df, column, lambda c, t: lenient.na_to_null(c)),
}


def recipe_json(steps: list[dict]) -> str:
    """JSON text of a recipe, checked."""
    for step in steps:
        if step.get("op") not in STEPS:
            raise ValueError(f"unknown step {step.get('op')!r}; known: {sorted(STEPS)}")
    return json.dumps(steps)


def recipe(text_or_steps: str | list[dict]) -> Callable[[DataFrame], DataFrame]:
    """The table function of a recipe."""
    steps = json.loads(text_or_steps) if isinstance(text_or_steps, str) else text_or_steps
    recipe_json(steps)

    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            arguments = {k: v for k, v in step.items() if k != "op"}
            df = STEPS[step["op"]](df, **arguments)
        return df

    return run


def apply_stored(df: DataFrame, stored: list[tuple[str, str]]) -> list[tuple[str, FixResult]]:
    """Run stored recipes (id, JSON) one after the other, each on the outcome of the last that worked."""
    results = []
    for entry_id, body in stored:
        try:
            fix = recipe(body)
        except (ValueError, TypeError, AttributeError) as exc:
            results.append((entry_id, FixResult(False, None, 0.0, str(exc), "execution")))
            continue
        result = apply_fix(df, fix)
        results.append((entry_id, result))
        if result.success:
            df = result.df
    return results


def fix_from_library(df: DataFrame, store: lib.FixLibrary, model: tfidf.TfidfModel, source_file: str,
                     k: int = 3) -> tuple[DataFrame, list[tuple[str, FixResult]]]:
    """Run the recipes that worked on the k most similar tables, and record how they did here.

    Only entries of the same vocabulary are compared. Returns the last good table and the results.
    """
    made = tfidf.vectorise_table(df, model).withColumn("id", F.lit("query"))
    query = made.select("id", fit_length(F.col("vector")).alias("vector"))
    library = store.read().where(F.col("vocab_id") == model.vocab_id)
    near = lib.successful_scripts(query, library, k).orderBy("rank").collect()  # at most k rows
    results = apply_stored(df, [(r.id, r.script_content) for r in near])
    for _, result in results:
        df = result.df if result.success else df
    if results:
        bodies = {r.id: r.script_content for r in near}
        rows = [(bodies[i], "SUCCESS" if r.success else "FAILURE", r.error_kind or "applied", r.seconds, r.error or "")
                for i, r in results]
        outcome = df.sparkSession.createDataFrame(
            rows, "script_content string, status string, error_type string, execution_time double, error_message string")
        facts = made.select("tokens", "vector", "vocab_id", F.lit(source_file).alias("source_file"), F.lit(1).alias("one"))
        store.add(outcome.withColumn("one", F.lit(1)).join(F.broadcast(facts), "one").drop("one"))
    return df, results
