"""Batch command: load a file, harmonise or only diagnose it, write the result.

    spark-submit -m tablewright.plans.job --input data.csv --output out.parquet
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.operators import library as lib
from tablewright.operators.issues import issue_notes
from tablewright.operators.snapshots import SnapshotStore
from tablewright.plans.harmonise import diagnose, run
from tablewright.plans.recipes import recipe
from tablewright.plans.registry import SchemaRegistry
from tablewright.plans.schema import STANDARD
from tablewright.session import build_session, clear_scratch
from tablewright.sources.ingest import load_tables
from tablewright.sources.sinks import write_table


def parse_arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Harmonise a table to a target schema")
    parser.add_argument("-i", "--input", required=True, help="file or archive")
    parser.add_argument("-o", "--output", help="result path; the suffix names the format")
    parser.add_argument("-s", "--schema", default=STANDARD.name, help="schema name")
    parser.add_argument("--schemas-dir", help="folder of schema files")
    parser.add_argument("--snapshots-dir", help="folder for stage snapshots")
    parser.add_argument("--diagnose-only", action="store_true", help="report only, change nothing")
    parser.add_argument("--max-attempts", type=int, default=3, help="fix attempts")
    parser.add_argument("--no-auto-fix", action="store_true", help="do not try fixes")
    parser.add_argument("--recipes", help="JSON file of fixes to try: {name: [step, ...]}")
    parser.add_argument("--library", help="fix library whose newest successful recipes are tried as well")
    parser.add_argument("--library-recipes", type=int, default=3, help="how many of them")
    return parser.parse_args(argv)


def chosen_fixes(spark: SparkSession, args: argparse.Namespace) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Fixes by name: those of the recipe file in its order, then the library's."""
    bodies: dict[str, object] = {}
    if args.recipes:
        text = "\n".join(r.value for r in spark.read.text(args.recipes, wholetext=True).collect())
        bodies |= json.loads(text)
    if args.library:
        worked = lib.with_status(lib.FixLibrary(spark, args.library).read(), "SUCCESS")
        newest = worked.orderBy(F.desc("created_at"), "id").limit(args.library_recipes)
        bodies |= {f"library:{r.id}": r.script_content for r in newest.collect()}
    return {name: recipe(body) for name, body in bodies.items()}


def numbered(path: str, k: int, tables: int) -> str:
    """The output path of table k; more than one table get numbers before the suffix."""
    if tables == 1:
        return path
    stem, dot, suffix = path.rpartition(".")
    return f"{stem}-{k + 1}.{suffix}" if dot and "/" not in suffix else f"{path}-{k + 1}"


def main(argv: list[str] | None = None) -> int:
    """Every table of the input goes through on its own; one JSON line per table tells the outcome."""
    args = parse_arguments(argv)
    spark = build_session("tablewright-job")
    registry = SchemaRegistry(spark, args.schemas_dir)
    schema = registry.get(args.schema)
    if schema is None:
        print(json.dumps({"error": f"unknown schema {args.schema}", "known": registry.names()}), file=sys.stderr)
        return 1
    try:
        tables = load_tables(spark, args.input)
    except ValueError as exc:
        print(json.dumps({"error": str(exc)}), file=sys.stderr)
        return 1
    fixes = {} if args.no_auto_fix or args.diagnose_only else chosen_fixes(spark, args)
    store = SnapshotStore(spark, args.snapshots_dir) if args.snapshots_dir else None
    for k, df in enumerate(tables):
        said: dict[str, object] = {"table": k + 1, "columns": len(df.columns) - 1}
        if args.diagnose_only:
            diagnosis = diagnose(df, schema)
            said |= {"valid": diagnosis.is_valid, "score": diagnosis.quality_score, "issues": issue_notes(diagnosis.issues)}
        else:
            outcome = run(df, schema, fixes, not args.no_auto_fix, args.max_attempts, store)
            said |= {"success": outcome.success, "score": outcome.diagnosis.quality_score,
                     "attempts": [{"fix": a[2], "worked": a[3]} for a in outcome.attempts],
                     "report": [r.asDict() for r in outcome.prepared.report().collect()]}
            if args.output:
                said["output"] = numbered(args.output, k, len(tables))
                write_table(outcome.df, said["output"])
        print(json.dumps(said))
    clear_scratch(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
