from pyspark.sql import functions as F

from tablewright.operators import clean, compare, project, repair, validate
from tablewright.plans.harmonise import preprocess
from tablewright.plans.resolve import mapping, resolve
from tablewright.plans.schema import STANDARD, TargetColumn, TargetSchema

ROWS = [
    (0, " BRCA1 ", "1.5", "0.01", "", None), (1, "_TP53", "x", "2", " ", None), (2, "BRCA1", "1.5", "0.01", "", None),
    (3, None, "2", "-1", None, None), (4, "9", None, "0.5", "", None)]
SCHEMA = "row_id bigint, ` Gene ` string, fold string, p_val string, note string, empty string"


def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_cleaning(spark):
    out = clean.clean_table(table(spark))
    assert out.df.columns == ["row_id", "Gene", "fold", "p_val"]
    assert (out.all_null, out.blank, out.trimmed, out.renamed) == (["empty"], ["note"], [" Gene "], [" Gene "])
    assert sorted(r.row_id for r in out.df.collect()) == [0, 1, 3, 4]


def test_cleaning_twice_changes_nothing(spark):
    once = clean.clean_table(table(spark)).df
    twice = clean.clean_table(once)
    assert twice.df.columns == once.columns and twice.df.exceptAll(once).count() == 0
    assert not (twice.trimmed or twice.renamed or twice.blank)


def test_preprocess_counts_and_values(spark):
    done = preprocess(table(spark), STANDARD)
    rows = {r.row_id: r for r in done.df.collect()}
    assert [rows[i].Gene for i in (0, 1, 3, 4)] == ["BRCA1", "TP53", None, ""]
    assert [rows[i].p_val for i in (0, 1, 3, 4)] == [0.01, 1.0, 0.0, 0.5]
    metrics = {(r.column, r.metric): r.n for r in done.changes.collect()}
    assert metrics[("p_val", "clamped")] == 2 and metrics[("Gene", "pattern_fixed")] == 1
    assert metrics[("*", "duplicates")] == 1
    found = {(r.column, r.issue_type): r.affected_rows for r in done.issues.collect()}
    assert found[("Gene", "pattern_violation")] == 1 and found[("fold", "coercion_failure")] == 1
    assert found[("fold", "null_values")] == 2 and found[("Gene", "null_values")] == 1
    assert not done.is_valid()
    report = {(r.part, r.subject, r.finding): r.n for r in done.report().collect()}
    assert report[("changed", "Gene", "pattern_fixed")] == 1 and report[("open:warning", "Gene", "pattern_violation")] == 1


def test_null_stays_null_through_text_transforms(spark):
    schema = TargetSchema("s", columns=[TargetColumn("a", transform="uppercase"), TargetColumn("b", "bool")])
    df = spark.createDataFrame([(1, None, "no"), (2, "x", "yes")], "row_id bigint, a string, b string")
    out = project.project(df, schema, mapping(resolve(df.columns, schema)))
    assert [tuple(r) for r in out.orderBy("row_id").collect()] == [(1, None, False), (2, "X", True)]


def test_transforms_run_once_and_a_shared_source_is_kept(spark):
    schema = TargetSchema("s", columns=[
        TargetColumn("raw", "float", source="v"), TargetColumn("neg", "float", source="v", transform="negate"),
        TargetColumn("gone", "int", required=False, default_value=3), TargetColumn("nothing", "date", required=False)])
    df = spark.createDataFrame([("2",), ("a",)], "v string")
    out = project.project(df, schema, mapping(resolve(df.columns, schema)))
    assert sorted([tuple(r) for r in out.collect()], key=str) == [(2.0, -2.0, 3, None), (None, None, 3, None)]
    assert out.schema["gone"].dataType.simpleString() == "bigint"


def test_adjustment_target_needs_no_name_match(spark):
    schema = TargetSchema("s", columns=[TargetColumn("q", "float", transform="bonferroni", stat_test_source_column="p")])
    df = spark.createDataFrame([(0.01,), (0.3,), (None,)], "p double")
    out = project.project(df, schema, {})
    assert sorted([r.q for r in out.collect()], key=str) == [0.02, 0.6, None]


def test_int_columns_round_and_report_fractions(spark):
    schema = TargetSchema("s", columns=[TargetColumn("n", "int", min_value=0, max_value=3, default_value=1)])
    df = spark.createDataFrame([("2.5",), ("7",), ("x",), ("-1",)], "n string")
    plans = repair.plan_repairs(df, schema, {"n": "n"}, transforms=False)
    assert sorted(r.n for r in repair.apply_repairs(df, plans).collect()) == [0, 1, 2, 3]
    c = repair.repair_counters(df, plans).first()
    assert (c.coerced, c.fractional, c.clamped, c.nulls) == (1, 1, 2, 1)


def test_validation_messages(spark):
    df = spark.createDataFrame([("a1", "1", "2"), (None, "x", "0.5")], "GeneSymbol string, FoldChange string, PValue string")
    schema = TargetSchema("s", columns=[*STANDARD.columns, TargetColumn("Dose", "float"), TargetColumn("Opt", required=False)])
    found = validate.validate_table(df, schema, mapping(resolve(df.columns, schema)))
    assert {r.description for r in validate.errors(found).collect()} == {
        "Column 'GeneSymbol' has 1 null values", "Column 'FoldChange' has 1 non-numeric values",
        "Column 'PValue' has 1 values above maximum 1.0", "Required column 'Dose' not found in data"}
    assert [r.description for r in validate.warnings(found).collect()] == ["Optional column 'Opt' not found"]


def test_preservation_accepts_renames_and_rejects_losses(spark):
    before = spark.range(50).select(F.col("id").alias("row_id"), *[
        (F.col("id") * k).cast("string").alias(f"c{k}") for k in range(1, 6)])
    renamed = before.select("row_id", F.col("c3").alias("z"), F.col("c1").alias("y"), "c2", "c4", "c5")
    assert compare.preservation_check(before, renamed).first().values_preserved
    assert not compare.preservation_check(before, renamed.where("row_id < 49")).first().values_preserved
    changed = renamed.withColumn("z", F.lit("q")).withColumn("y", F.lit("r"))
    row = compare.preservation_check(before, changed).first()
    assert row.matched_columns == 3 and not row.values_preserved
    pairs = [(r.original, r.rewritten) for r in compare.match_columns(before, renamed).collect()]
    assert ("c3", "z") in pairs and ("c1", "y") in pairs
    assert all(r.differing == 0 for r in compare.confirm_matches(before, renamed, pairs).collect())


def test_column_names_with_dots(spark):
    df = spark.createDataFrame([(1, " x ", None)], "row_id bigint, `a.b` string, `c d` string")
    out = clean.clean_table(df).df
    assert [tuple(r) for r in out.collect()] == [(1, "x")] and out.columns == ["row_id", "a.b"]
