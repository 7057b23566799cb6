import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tablewright.operators import library
from tablewright.operators.dates import column_formats, dates_by_column
from tablewright.operators.repair import apply_repairs, plan_repairs
from tablewright.plans.resolve import mapping, resolve
from tablewright.plans.schema import TargetColumn, TargetSchema
from tablewright.sources import tables
from tablewright.sources.ingest import ingest


@pytest.fixture(scope="module")
def days(spark):
    rows = [(1, "02/03/2024", "02/03/2024", "2024-01-02", None, "x"), (2, "13/03/2024", "1/2/2024", "2024-01-03 10:00", "", "y"), (3, " 05/03/2024 ", "3/14/2024", "2024-01-04", None, "z")]
    return spark.createDataFrame(rows, "row_id long, a string, b string, c string, d string, e string")


def test_one_format_for_a_column(days):
    assert column_formats(days, ["a", "b", "c", "d", "e", "row_id", "a"]) == {"a": "d/M/yyyy", "b": "M/d/yyyy", "c": "yyyy-MM-dd", "d": None, "e": None}
    typed, report = dates_by_column(days, ["a", "b", "c", "d", "e"])
    assert [[str(v) for v in r] for r in typed.select("a", "b", "c", "d", "e").orderBy("row_id").collect()] == [
        ["2024-03-02", "2024-02-03", "2024-01-02", "None", "None"], ["2024-03-13", "2024-01-02", "None", "None", "None"], ["2024-03-05", "2024-03-14", "2024-01-04", "None", "None"]]
    assert {(r.column, r.format, r["values"], r.unread) for r in report.collect()} == {
        ("a", "d/M/yyyy", 3, 0), ("b", "M/d/yyyy", 3, 0), ("c", "yyyy-MM-dd", 3, 1), ("d", None, 1, 1), ("e", None, 3, 3)}
    assert dates_by_column(days, ["row_id"])[1].count() == 0


def test_repairs_read_dates_by_column(days):
    schema = TargetSchema("s", columns=[TargetColumn("A", "date", source="a"), TargetColumn("C", "datetime", source="c", required=False)])
    bound = mapping(resolve(days.columns, schema))
    whole = apply_repairs(days, plan_repairs(days, schema, bound, transforms=False)).orderBy("row_id").collect()
    assert [str(r.a) for r in whole] == ["2024-03-02", "2024-03-13", "2024-03-05"] and [r.c is None for r in whole] == [False, True, False]
    # a stream never sees the whole column: value by value
    each = apply_repairs(days, plan_repairs(days, schema, bound, transforms=False, by_column=False)).orderBy("row_id").collect()
    assert [str(r.a) for r in each] == ["2024-02-03", "2024-03-13", "2024-05-03"] and all(r.c for r in each)


def test_broken_bundles_are_told(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("one/script.py", "fix")
        z.writestr("one/embedding.json", "[1.0")
        z.writestr("two/metadata.json", "{")
        z.writestr("two/embedding.json", "[1.5, 2]")
    (tmp_path / "good.zip").write_bytes(out.getvalue())
    (tmp_path / "broken.zip").write_bytes(out.getvalue()[:60])
    told = {(r.archive.rsplit("/", 1)[-1], r.member) for r in library.bundle_errors(spark, [str(tmp_path)]).collect()}
    assert ("good.zip", "one/embedding.json") in told and ("good.zip", "two/metadata.json") in told and len(told) == 3
    assert any(archive == "broken.zip" for archive, _ in told)
    assert {r.id for r in library.read_bundles(spark, [str(tmp_path)]).collect()} == {"one", "two"}


def test_header_without_an_end(spark, tmp_path, monkeypatch):
    """Text on one line, longer than a header may be: the file is an error, and the others are read."""
    (tmp_path / "endless.csv").write_text("a," * 40_000_000 + "a")
    (tmp_path / "fine.csv").write_text("k,v\n1,2\n")
    result = ingest(spark, str(tmp_path))
    assert result.status == "PARTIAL" and [r.label for r in result.errors.collect()] == ["endless.csv"]
    assert result.union().select("k", "v").collect()[0] == ("1", "2") and tables.MOST_HEADER == 16 << 20
