import json

import pytest
from pyspark.sql import functions as F

from tablewright.operators import context, responses
from tablewright.operators.issues import issue_notes
from tablewright.operators.snapshots import SnapshotStore, attempt_numbers
from tablewright.plans import job
from tablewright.plans.harmonise import apply_fix, diagnose, pandas_fix, preprocess, run
from tablewright.plans.recipes import apply_stored, recipe, recipe_json
from tablewright.plans.schema import STANDARD, TargetColumn, TargetSchema
from tablewright.session import scratch_path
from tablewright.sources.paths import write_text
from tablewright.streaming import incremental

SCHEMA = TargetSchema("s", columns=[TargetColumn("gene", validation_regex="^[A-Z0-9]+$"), TargetColumn("fc", "float")])


def dirty(spark):
    return spark.createDataFrame([(0, "TP53", "1.5"), (1, "myc", "x"), (2, None, "2")], "row_id bigint, gene string, fc string")


def test_valid_table_needs_no_fix(spark):
    df = spark.createDataFrame([(0, "TP53", "1.5")], "row_id bigint, gene string, fc string")
    outcome = run(df, SCHEMA, fixes={"never": lambda d: d})
    assert outcome.success and outcome.attempts == [] and outcome.df.first().fc == 1.5


def test_fix_loop_counts_only_runs_that_worked(spark):
    def broken(df):
        raise KeyError("no such column")

    fixes = {"broken": broken, "drop": recipe([{"op": "drop_nulls", "columns": ["gene", "fc"]}])}
    store = SnapshotStore(spark, scratch_path(spark, "snap"))
    outcome = run(dirty(spark), SCHEMA, fixes, snapshots=store, max_attempts=3)
    assert outcome.success and outcome.df.count() == 1
    assert [(a[1], a[2], a[3], a[4]) for a in outcome.attempts] == [(None, "broken", False, "execution"), (1, "drop", True, None)]
    stages = [r.stage for r in store.manifest().orderBy("id").collect()]
    assert stages == ["preprocessing", "preprocessing", "diagnosing", "fix_attempt", "complete"]
    assert outcome.summary().first().attempts == 2 and outcome.attempts_table(spark).count() == 2


def test_fix_loop_stops_at_the_limit(spark):
    outcome = run(dirty(spark), SCHEMA, {"same": lambda d: d}, max_attempts=2)
    assert not outcome.success and len(outcome.attempts) == 2
    assert len(run(dirty(spark), SCHEMA, {"bad": lambda d: 1 / 0}, max_attempts=2).attempts) == 4
    assert run(dirty(spark), SCHEMA, {"same": lambda d: d}, auto_fix=False).attempts == []


def test_result_contract(spark):
    df = dirty(spark)
    assert apply_fix(df, lambda d: d.where("false")).error == "Result is empty"
    assert apply_fix(df, lambda d: 5).error_kind == "logical"
    assert apply_fix(df, lambda d: d.select()).error == "Result has no columns"
    assert apply_fix(df, lambda d: d.select(F.col("nope"))).error_kind == "execution"
    assert apply_fix(df, lambda d: d.select(F.raise_error(F.lit("boom")).alias("x"))).error_kind == "execution"
    done = apply_fix(df, lambda d: d.drop("fc").where("row_id < 2"))
    assert done.success and done.changes == ["Columns changed: 3 -> 2", "Rows changed: 3 -> 2"]
    upper = apply_fix(df, pandas_fix(lambda b: b.assign(gene=b["gene"].str.upper()), df.schema.simpleString()[7:-1]))
    assert {r.gene for r in upper.df.collect()} == {"TP53", "MYC", None}


def test_min_severity(spark):
    schema = TargetSchema("s", columns=[TargetColumn("gene", required=False)])
    prepared = preprocess(dirty(spark), schema)
    assert not prepared.is_valid() and prepared.is_valid("warning")


def test_diagnosis_lists_schema_errors_as_critical(spark):
    found = diagnose(dirty(spark), SCHEMA)
    kinds = {(r.column, r.issue_type, r.severity) for r in found.issues.collect()}
    assert ("schema", "schema_mismatch", "critical") in kinds and ("gene", "null_values", "warning") in kinds
    assert (found.is_valid, found.quality_score) == (False, 0.5)
    notes = issue_notes(found.issues)
    assert notes[0].startswith("critical/schema_mismatch schema: ") and len(notes) == found.issues.count()
    assert issue_notes(found.issues.where("false")) == []


def test_recipes(spark):
    steps = [{"op": "transform", "column": "gene", "name": "uppercase"}, {"op": "convert", "column": "fc", "type": "float"},
             {"op": "fill", "column": "gene", "value": "NONE"}, {"op": "clamp", "column": "fc", "high": 1.8},
             {"op": "rename", "columns": {"gene": "g"}}]
    out = recipe(recipe_json(steps))(dirty(spark)).orderBy("row_id")
    assert [tuple(r) for r in out.collect()] == [(0, "TP53", 1.5), (1, "MYC", None), (2, "NONE", 1.8)]
    with pytest.raises(ValueError):
        recipe([{"op": "exec", "code": "1"}])
    results = apply_stored(dirty(spark), [("a", "not json"), ("b", json.dumps(steps[:1])), ("c", '[{"op": "keep", "columns": ["zz"]}]')])
    assert [(i, r.success, r.error_kind) for i, r in results] == [("a", False, "execution"), ("b", True, None), ("c", False, "execution")]


def test_snapshots(spark):
    store = SnapshotStore(spark, scratch_path(spark, "snap"))
    assert store.latest() is None and store.totals()["count"] == 0
    first = store.create("preprocessing", dirty(spark), {"k": 1})
    store.create("complete")
    again = store.refer("diagnosing", store.refer("validating", first))
    assert store.load(again)[1].count() == 3 and store.load(again)[0]["rows"] == 3 and store.latest()[0]["id"] == again
    with pytest.raises(ValueError):
        store.refer("complete", "zz")
    store.clear()
    first = store.create("preprocessing", dirty(spark), {"k": 1})
    store.create("complete")
    info, data = store.load(first)
    assert info["metadata"] == {"k": 1} and data.count() == 3 and store.load("zz") is None
    assert store.latest()[0]["stage"] == "complete" and store.latest()[1] is None
    assert store.latest_of("preprocessing")[0]["id"] == first and store.latest_of("error") is None
    assert store.totals()["count"] == 2 and store.totals()["bytes"] > 0
    with pytest.raises(ValueError):
        store.create("loading")
    store.clear()
    assert store.latest() is None


def test_attempt_numbers(spark):
    log = spark.createDataFrame([(1, 1, None), (1, 2, "execution"), (1, 3, "logical")], "run_id int, iteration int, error_kind string")
    assert [r.attempt for r in attempt_numbers(log).orderBy("iteration").collect()] == [1, None, 2]


def test_contexts(spark):
    requests = spark.createDataFrame([(1, "see notes now"), (2, ""), (3, None)], "request_id int, text string")
    files = spark.createDataFrame([(1, 1, "notes.csv", "csv", "N"), (3, 1, "b.txt", "text", "B")],
                                  "request_id int, position int, name string, kind string, content string")
    got = {r.request_id: r.context for r in context.build_contexts(requests, files).collect()}
    assert got[2] is None and got[3] == "## file b.txt (text)\nB"
    assert got[1] == "## request\nsee notes now\n\n## named in the request\nnotes.csv\n\n## file notes.csv (csv)\nN"
    parts = {(r.request_id, r.part, r.position) for r in context.context_parts(requests, files).collect()}
    assert parts == {(1, "request", None), (1, "named", None), (1, "file", 1), (3, "file", 1)}


def test_responses_take_defaults(spark):
    df = spark.createDataFrame([(1, '{"summary": "s", "issues": [{"column": "c"}]}'), (2, "[1, 2]"), (3, "a problem"), (4, "")],
                               "id int, text string")
    out = {r.id: r for r in responses.parse_responses(df).collect()}
    assert (out[1].parsed, out[1].is_valid, out[1].quality_score, out[1].summary) == (True, False, 0.0, "s")
    assert out[1].issues[0].column == "c"
    assert [out[i].parsed for i in (2, 3, 4)] == [False] * 3 and out[3].issues[0].issue_type == "parse_error"


def test_job(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(job, "build_session", lambda *a, **k: spark)
    monkeypatch.setattr(job, "clear_scratch", lambda s: 0)  # other tests still read theirs
    (tmp_path / "d.csv").write_text("Gene,fold,p_val\nTP53,1.5,0.1\n_MYC,2,7\n")
    out = str(tmp_path / "out.parquet")
    assert job.main(["-i", str(tmp_path / "d.csv"), "-o", out]) == 0
    assert sorted(tuple(r)[1:] for r in spark.read.parquet(out).collect()) == [("MYC", 2.0, 1.0), ("TP53", 1.5, 0.1)]
    assert job.main(["-i", str(tmp_path / "d.csv"), "--diagnose-only"]) == 0
    assert job.main(["-i", str(tmp_path / "none.csv")]) == 1
    assert job.main(["-i", str(tmp_path / "d.csv"), "-s", "zz"]) == 1
    assert '"success": true' in capsys.readouterr().out


HEADER = ["row_id", "Gene", "fold", "p_val"]


def test_two_batches_equal_one_batch_job(spark):
    folder = scratch_path(spark, "arrivals")
    out, notes, state = (scratch_path(spark, x) for x in ("out", "notes", "state"))

    def arrive(name, lines):
        write_text(spark, f"{folder}/{name}.csv", "\n".join([",".join(HEADER), *lines]) + "\n")

    def drain():
        incremental.start(incremental.read_arrivals(spark, folder, HEADER), STANDARD, out, notes, state).awaitTermination()

    arrive("one", ["1, _TP53 ,1.5,0.1", "2,MYC!!,x,7"])
    drain()
    arrive("two", ["3,NA,2,-1"])
    drain()
    got = incremental.harmonised(spark, out)
    whole = spark.read.schema(", ".join(f"`{c}` string" for c in HEADER)).option("header", True).csv(folder)
    assert got.count() == 3 and got.exceptAll(incremental.row_local(whole, STANDARD)).count() == 0
    totals = {r.target: r for r in incremental.issue_totals(spark, notes).collect()}
    assert totals["PValue"].clamped == 2 and totals["FoldChange"].coerced == 1 and totals["GeneSymbol"].nulls == 1
    assert {r.batch for r in spark.read.parquet(out).select("batch").distinct().collect()} == {0, 1}


def test_batches_of_arrivals_are_bounded_by_bytes(spark):
    """Many small files make few batches, with the rows that they give one by one."""
    folder = scratch_path(spark, "small-arrivals")
    body = ",".join(HEADER) + "\n" + "".join(f"{i},MYC,1,0.1\n" for i in range(20))
    for i in range(5):
        write_text(spark, f"{folder}/f{i}.csv", body)
    batches = {}
    for name, bound in (("all", 64 << 20), ("some", 2 * len(body)), ("each", 1)):
        out, notes, state = (scratch_path(spark, x) for x in ("out", "notes", "state"))
        incremental.start(incremental.read_arrivals(spark, folder, HEADER, max_bytes=bound), STANDARD, out, notes, state).awaitTermination()
        rows = spark.read.parquet(out)
        assert rows.count() == 100
        batches[name] = rows.select("batch").distinct().count()
    assert batches["all"] == 1 < batches["some"] < batches["each"] == 5
    with pytest.raises(ValueError):
        incremental.read_arrivals(spark, folder, HEADER, max_files=1, max_bytes=1)


def test_adjustments_are_refused_on_streams(spark):
    schema = TargetSchema("s", columns=[TargetColumn("q", "float", transform="bonferroni")])
    with pytest.raises(ValueError):
        incremental.row_local(dirty(spark), schema)


def test_repeats_across_batches_are_dropped_with_an_event_time(spark):
    folder = scratch_path(spark, "arrivals")
    out, notes, state = (scratch_path(spark, x) for x in ("out", "notes", "state"))
    header = [*HEADER, "at"]
    for i in range(2):
        write_text(spark, f"{folder}/f{i}.csv", ",".join(header) + "\n1,TP53,1,0.1,2024-01-01 00:00:00\n")
        stream = incremental.read_arrivals(spark, folder, header).withColumn("at", F.to_timestamp("at"))
        incremental.start(stream, STANDARD, out, notes, state, event_time="at").awaitTermination()
    assert incremental.harmonised(spark, out).count() == 1


def test_recipes_of_similar_tables_are_reused(spark):
    from tablewright.operators import tfidf
    from tablewright.operators.library import FixLibrary
    from tablewright.plans.recipes import fix_from_library

    from tablewright.operators.fingerprint import fingerprint

    model = tfidf.fit(fingerprint(dirty(spark)), "token_string")
    assert tfidf.TfidfModel.from_json(model.to_json()).vocab_id == model.vocab_id
    store = FixLibrary(spark, scratch_path(spark, "reuse"))
    known = tfidf.vectorise_table(dirty(spark), model)
    good = recipe_json([{"op": "transform", "column": "gene", "name": "uppercase"}])
    bad = recipe_json([{"op": "keep", "columns": ["zz"]}])
    bodies = spark.createDataFrame([(good, "SUCCESS", 1), (bad, "SUCCESS", 1), ("x", "FAILURE", 1)], "script_content string, status string, one int")
    store.add(bodies.join(known.withColumn("one", F.lit(1)), "one").drop("one").withColumns(
        {"error_type": F.lit("case"), "source_file": F.lit("a.csv")}))
    out, results = fix_from_library(dirty(spark), store, model, "b.csv")
    assert {r.gene for r in out.collect()} == {"TP53", "MYC", None}
    assert sorted(r.success for _, r in results) == [False, True]
    kept = {(r.source_file, r.status) for r in store.read().collect()}
    assert kept == {("a.csv", "SUCCESS"), ("a.csv", "FAILURE"), ("b.csv", "SUCCESS"), ("b.csv", "FAILURE")}
    again = tfidf.revectorise(store.read(), tfidf.fit(store.read(), "fingerprint_tokens", max_features=5), 1000)
    assert again.count() == 5 and len(again.first().vector) == 1000
    assert again.first().vocab_id not in ("", model.vocab_id)
