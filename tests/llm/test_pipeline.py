"""The stages of the corpus pipeline, each held against what its input says."""

import os
import re

import pytest

import corpus_pipeline
from checks.compare import compare, connect
from tablewright.llm.queries import ORACLE, QUERIES
from tests.llm.test_documents import classes, measures, removed_lines

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    ok, words = compare(spark, connect(SF_DIR), name, QUERIES[name], ORACLE[name], SF_DIR)
    assert ok, words


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    bench = [r["text"] for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    rows = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        got = out.collect()
        before = [(i, r["text"], r["source"]) for i, r in sorted(rows.items())]
        if name != "packing":
            assert out.columns == docs.columns
            kept = {r["doc_id"]: r for r in got}
            assert len(kept) == len(got)
        if name == "quality_rules":
            failed = {i for i, t, _ in before if (m := measures(t))[0] < 10 or 100 * m[4] > 20 * m[0]}
            assert set(kept) == set(rows) - failed
        elif name == "line_dedup":
            gone = removed_lines(before, 8)
            for i, t, _ in before:
                left = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
                assert (i in kept) == bool(not gone[i] or re.search(r"[^\x20\x09-\x0D]", left))
                assert i not in kept or kept[i]["text"] == left and kept[i]["n_chars"] == len(left)
        elif name == "near_dedup":
            low = classes(before, 5, 80)
            assert set(kept) == {i for i in rows if low[i] == i}
        elif name == "decontamination":
            leaked = {i for i, t, _ in before if any(b in t for b in bench)}
            assert leaked and set(kept) == set(rows) - leaked
        else:
            assert {r["doc_id"] for r in got} == set(rows)
            assert sum(r["length"] for r in got) == sum({r["doc_id"]: r["doc_tokens"] for r in got}.values())
            break
        rows, docs = kept, spark.createDataFrame(got, docs.schema)


def test_rows_without_or_with_repeated_ids(spark, tmp_path):
    """A bad row takes no clean row along that has no id either, or the same; copies go whatever their ids are."""
    def text(name):
        return " ".join(f"{name}{k}" for k in range(30))

    spark.createDataFrame([(1, text("item"))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    def stage(name, rows):
        docs = spark.createDataFrame([(i, t, "en", f"s{k}", len(t)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
        return sorted(((r["doc_id"], r["text"]) for r in dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path)).collect()), key=str)

    clean = [(None, text("a")), (None, text("b")), (7, text("c"))]
    many = [(k, text(f"m{k}x")) for k in range(20, 60)]  # so that no host is rejected
    assert stage("quality_rules", clean + many + [(None, "short"), (7, "short")]) == sorted(clean + many, key=str)
    assert stage("decontamination", clean + [(None, text("item")), (7, text("item"))]) == sorted(clean, key=str)
    copies = [(None, text("a")), (7, text("c")), (9, text("b")), (5, text("b")), (None, text("d")), (None, text("d"))]
    assert stage("near_dedup", clean + copies) == sorted([(None, text("a")), (5, text("b")), (7, text("c")), (None, text("d"))], key=str)


def test_whole_run_and_empty_documents(spark, tmp_path):
    spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF_DIR}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, SF_DIR).count() > 100
