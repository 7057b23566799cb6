from pyspark.sql import functions as F

from tablewright.plans.schema import TargetColumn, TargetSchema
from tablewright.session import scratch_path
from tablewright.streaming import incremental, issue_state

SCHEMA = TargetSchema("s", columns=[TargetColumn("Age", "int", source="age", min_value=0, max_value=120), TargetColumn("Name", "string", source="name")])


def test_totals_go_on_after_a_restart_and_alert_once(spark):
    folder, out, state = (scratch_path(spark, x) for x in ("in", "out", "state"))
    waves = [[("1", "a"), ("x", "b")], [("x", "c"), ("x", ""), ("130", "d")], [("y", "e")]]
    for k, wave in enumerate(waves):
        df = spark.createDataFrame([(str(k * 10 + i), *r) for i, r in enumerate(wave)], "row_id string, age string, name string").coalesce(1)
        df.write.mode("append").option("header", True).option("emptyValue", "").csv(folder)
        arrivals = incremental.read_arrivals(spark, folder, ["row_id", "age", "name"])
        issue_state.start_issue_state(arrivals, SCHEMA, out, state, share=0.5).awaitTermination()
    now = {(r.target, r.counter): (r.n, r["rows"]) for r in issue_state.current_issues(spark, out).collect()}
    assert now == {("Age", "coerced"): (4, 6), ("Age", "fractional"): (0, 6), ("Age", "clamped"): (1, 6), ("Age", "nulls"): (4, 6), ("Age", "rows"): (6, 6),
                   ("Name", "coerced"): (0, 6), ("Name", "nulls"): (1, 6), ("Name", "rows"): (6, 6)}
    # one of two is no more than half; three of five is; later batches say nothing new
    raised = issue_state.alerts(spark, out).select("target", "counter", "n").collect()
    assert sorted(map(tuple, raised)) == [("Age", "coerced", 3), ("Age", "nulls", 3)]
    assert spark.conf.get(issue_state.PROVIDER, "").endswith("RocksDBStateStoreProvider") is False


def test_batches_are_added_up_before_the_key(spark):
    """Rows that reach the key: one per counter, task and batch, whatever the rows are."""
    rows = spark.range(5_000, numPartitions=2).select(F.col("id").alias("row_id"), (F.col("id") % 150).cast("string").alias("age"), F.lit("n").alias("name"))
    from tablewright.operators.repair import plan_repairs
    from tablewright.plans.resolve import mapping, resolve

    plans = plan_repairs(rows, SCHEMA, mapping(resolve(rows.columns, SCHEMA)), transforms=False)
    partial = issue_state.checked(rows, plans)
    assert partial.count() == 2 * 8
    assert partial.where("counter = 'clamped'").agg(F.sum("n")).first()[0] == rows.where("cast(age AS int) > 120").count()
