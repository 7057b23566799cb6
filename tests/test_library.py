import json
import zipfile

from pyspark.sql import functions as F

from tablewright.operators import library as lib
from tablewright.session import scratch_path


def attempts(spark, n=6):
    rows = [(f"s{i}", lib.STATUSES[i % 3], f"e{i % 2}", "f.csv", ["T1", "T2"] * 60, [float(i), 1.0]) for i in range(n)]
    return spark.createDataFrame(rows, "script_content string, status string, error_type string, source_file string, "
                                       "tokens array<string>, vector array<double>")


def test_entries_are_padded_and_cut(spark):
    row = lib.entries(attempts(spark)).where("script_content = 's3'").first()
    assert len(row.vector) == 1000 and row.vector[:3] == [3.0, 1.0, 0.0]
    assert row.token_count == 120 and len(row.fingerprint_tokens.split()) == 120
    assert len(lib.entries(attempts(spark), stored_tokens=100).where("script_content = 's3'").first().fingerprint_tokens.split()) == 100
    bare = attempts(spark).drop("vector")
    assert set(lib.entries(bare).first().vector) == {0.0}


def test_versions(spark):
    store = lib.FixLibrary(spark, scratch_path(spark, "lib"))
    assert store.versions() == [] and store.read().count() == 0
    rows = lib.entries(attempts(spark)).withColumn("id", F.col("script_content")).cache()
    assert store.import_rows(rows) == 6 and store.import_rows(rows) == 0
    store.update(spark.createDataFrame([("s2", "SUCCESS", 2.5), ("zz", "SUCCESS", 1.0)], "id string, status string, execution_time double"))
    changed = store.read().where("id = 's2'").first()
    assert (changed.status, changed.execution_time, changed.script_content) == ("SUCCESS", 2.5, "s2")
    store.delete(spark.createDataFrame([("s0",)], "id string"))
    assert store.read().count() == 5 and store.read(1).count() == 6
    stats = {(r.kind, r.name): r.entries for r in store.stats().collect()}
    assert stats[("total", "")] == 5 and stats[("status", "PENDING")] == 1 and stats[("error_type", "e0")] == 2
    assert store.add(attempts(spark).limit(2)) == 5 and store.read().count() == 7
    store.compact()
    assert store.read().count() == 7
    store.clear()
    assert store.read().count() == 0 and store.versions() == [1, 2, 3, 4, 5, 6, 7]


def test_nearest_by_status_and_vocabulary(spark):
    whole = lib.entries(attempts(spark, 12)).withColumn("id", F.col("script_content")).withColumn("vocab_id", F.lit("v"))
    q = whole.where("id = 's4'").select("id", "vector")
    near = lib.nearest_entries(q, whole, 3).orderBy("rank").collect()
    assert [r.id for r in near] == ["s4", "s3", "s5"] and [r.distance for r in near] == [0.0, 1.0, 1.0]
    assert [r.id for r in lib.successful_scripts(q, whole).orderBy("rank").collect()] == ["s3", "s6", "s0"]
    assert lib.nearest_entries(q, whole, 3, vocab_id="other").count() == 0
    texts = {(r.advice, r.id): r.text for r in lib.advice(q, whole).collect()}
    assert texts[("avoid", "s4")] == "s4..." and texts[("reuse", "s3")] == "s3"


def test_json_export_and_import(spark):
    path = scratch_path(spark, "export")
    rows = lib.entries(attempts(spark).withColumn("created_at", F.lit("2024-01-01T00:00:00")))
    lib.export_json(rows, path)
    assert lib.read_json(spark, path).select("id", "vector").exceptAll(rows.select("id", "vector")).count() == 0


def test_bundles(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("one/embedding.json", json.dumps([1.0, 2.0]))
        z.writestr("one/script.py", "print(1)\nprint(2)")
        z.writestr("one/metadata.json", json.dumps({"status": "SUCCESS", "error_type": "e", "execution_time": 1.5}))
        z.writestr("two/script.py", "x")
    rows = {r.id: r for r in lib.read_bundles(spark, [str(tmp_path / "b.zip")]).collect()}
    assert rows["one"].vector[:3] == [1.0, 2.0, 0.0] and rows["one"].status == "SUCCESS"
    assert rows["one"].script_content == "print(1)\nprint(2)" and rows["one"].execution_time == 1.5
    assert set(rows["two"].vector) == {0.0} and rows["two"].status == "PENDING"
    store = lib.FixLibrary(spark, scratch_path(spark, "bundle-lib"))
    assert store.import_rows(lib.read_bundles(spark, [str(tmp_path / "b.zip")])) == 2


def test_unfinished_versions_are_not_read(spark):
    from tablewright.sources.paths import write_text

    root = scratch_path(spark, "lib")
    store = lib.FixLibrary(spark, root)
    store.add(attempts(spark))
    write_text(spark, f"{root}/v00000009-full/part-0.parquet", "half")
    assert store.versions() == [1] and store.read().count() == 6




def test_two_writers_lose_nothing(spark):
    from concurrent.futures import ThreadPoolExecutor

    store = lib.FixLibrary(spark, scratch_path(spark, "lib"))
    store.import_rows(lib.entries(attempts(spark)).withColumn("id", F.col("script_content")))

    def change(i):
        return store.update(spark.createDataFrame([(f"s{i}", f"BY{i}")], "id string, status string"))

    with ThreadPoolExecutor(3) as pool:
        versions = list(pool.map(change, range(3)))
    assert sorted(versions) == [2, 3, 4]
    assert {r.id: r.status for r in store.read().collect() if r.status.startswith("BY")} == {f"s{i}": f"BY{i}" for i in range(3)}
