import gzip
import io
import tarfile
import zipfile

import pandas as pd
import pytest

from tablewright.sources import sinks, tables
from tablewright.sources.archives import expand, read_members
from tablewright.sources.ingest import file_preview, ingest, load_table, load_tables

CSV = "a,b\n1,x\n2,y\n"


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def zipped(members: dict) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def tarred(members: dict, mode="w") -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, data in members.items():
            data = data.encode() if isinstance(data, str) else data
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def nested(levels: int) -> bytes:
    data = CSV.encode()
    name = "t.csv"
    for i in range(levels):
        data, name = zipped({name: data}), f"n{i}.zip"
    return data


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("in")
    (root / "plain.csv").write_text(CSV)
    (root / "semi.txt").write_text(CSV.replace(",", ";"))
    (root / "t.csv.gz").write_bytes(gzip.compress(CSV.encode()))
    (root / "t.tar.gz").write_bytes(tarred({"d/t.csv": CSV, ".h/x.csv": CSV}, "w:gz"))
    (root / "wrong_ext.csv").write_bytes(zipped({"in.csv": CSV, ".hidden.csv": CSV}))
    (root / "nest4.zip").write_bytes(nested(4))
    (root / "records.json").write_text('[{"a": "1", "b": "x"}, {"a": "2", "b": "y"}]')
    pd.DataFrame({"a": ["1", "2"], "b": ["x", "y"]}).to_parquet(root / "t.parquet")
    return root


def test_every_kind_of_file_gives_the_same_table(spark, folder):
    result = ingest(spark, str(folder))
    assert result.status == "SUCCESS", result.errors
    counts = [r["count"] for r in result.union().groupBy("source_file").count().collect()]
    assert counts == [2] * 8
    assert rows(result.union().select("a", "b").distinct(), "a", "b") == [("1", "x"), ("2", "y")]
    totals = result.totals().first()
    assert (totals.files_extracted, totals.tabular_files, totals.failed_files) == (8, 8, 0)


@pytest.mark.parametrize("name, sep", [("wide.csv", ","), ("wide.tsv", "\t"), ("wide.txt", ";")])
def test_header_longer_than_the_head(spark, tmp_path, name, sep):
    names = [f"column_{k}_" + "x" * 690 for k in range(100)]
    lines = [sep.join(names)] + [sep.join(f"{r}_{k}" for k in range(100)) for r in range(3)]
    (tmp_path / name).write_text("\n".join(lines) + "\n")
    result = ingest(spark, str(tmp_path))
    assert result.status == "SUCCESS"
    df = result.tables[0].drop("source_file")
    assert df.columns == names
    assert sorted((r[0], r[99]) for r in df.collect()) == [(f"{r}_0", f"{r}_99") for r in range(3)]


def test_one_file_of_a_layout(spark, folder):
    result = ingest(spark, [str(folder / "plain.csv"), str(folder / "semi.txt")])
    path = next(p for layout in result.layouts for p in layout.paths if p.endswith("semi.txt"))
    assert rows(result.table(path), "a", "b") == [("1", "x"), ("2", "y")]


def test_depth_limit(spark, tmp_path):
    (tmp_path / "n5.zip").write_bytes(nested(5))
    (tmp_path / "n6.zip").write_bytes(nested(6))
    assert expand(spark, str(tmp_path / "n5.zip")).count() == 1
    assert [r.error for r in expand(spark, str(tmp_path / "n6.zip")).collect()] == ["archive nested deeper than 5 levels"]
    assert ingest(spark, str(tmp_path / "n6.zip")).status == "FAILED"


def test_statuses(spark, tmp_path):
    assert ingest(spark, str(tmp_path / "none.csv")).status == "FAILED"
    (tmp_path / "broken.zip").write_bytes(b"PK\x03\x04 not really")
    (tmp_path / "notes.bin").write_bytes(bytes(range(256)))
    (tmp_path / "ok.csv").write_text(CSV)
    (tmp_path / "words.txt").write_text("just words\nand more\n")
    result = ingest(spark, str(tmp_path))
    assert result.status == "PARTIAL" and len(result.tables) == 1
    errors = {r.label: r.error for r in result.manifest.where("error is not null").collect()}
    assert set(errors) == {"broken.zip", "words.txt"} and errors["words.txt"].startswith("Could not parse")
    assert not result.manifest.where("name = 'notes.bin'").first().is_tabular


def test_irregular_rows_and_missing_values(spark, tmp_path):
    (tmp_path / "s.csv").write_text('a,b,c\n1,2\n1,2,3,4\n1,2,3,4,5\n"x, y",NA,"q ""z"""\n5,6,7,\n,,\n')
    got = rows(ingest(spark, str(tmp_path / "s.csv")).tables[0], "a", "b", "c")
    assert got == sorted([
        ("1", "2", None), ("x, y", None, 'q "z"'), ("5", "6", "7"), (None, None, None)], key=str)


def test_encodings(spark, tmp_path):
    (tmp_path / "latin.csv").write_bytes("k,v\n1,caf\xe9\n".encode("latin-1"))
    (tmp_path / "utf8.csv").write_bytes("k,v\n2,café\u0007�\n".encode())
    (tmp_path / "bom.csv").write_bytes("k,v\n3,z\n".encode("utf-8-sig"))
    (tmp_path / "wide.csv").write_bytes("k,v\r\n4,wü\r\n".encode("utf-16"))
    assert rows(ingest(spark, str(tmp_path)).union(), "k", "v") == [
        ("1", "caf\xe9"), ("2", "caf\xe9?"), ("3", "z"), ("4", "wü")]


def test_headers(spark, tmp_path):
    assert tables.unique_names(["a", "", "a", "a"]) == ["a", "Unnamed: 1", "a.1", "a.2"]
    (tmp_path / "d.csv").write_text("a,a,\n1,2,3\n")
    assert ingest(spark, str(tmp_path / "d.csv")).tables[0].columns[:3] == ["a", "a.1", "Unnamed: 2"]


def test_quoted_line_breaks_are_found(spark, tmp_path):
    (tmp_path / "m.csv").write_text('a,b\n1,"x\ny"\n2,plain\n')
    (tmp_path / "n.csv").write_text('a,b\n3,"q ""z"""\n')
    result = ingest(spark, str(tmp_path))
    assert sorted((len(x.paths), x.multi_line) for x in result.layouts) == [(1, False), (1, True)]
    assert rows(result.union(), "a", "b") == [("1", "x\ny"), ("2", "plain"), ("3", 'q "z"')]


def test_types_tables_and_row_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("i,d,b,s,e\n1,1,true,x,\n-2,2.5e3,FALSE,007a,\n,,,,\n")
    (tmp_path / "b.csv").write_text("x,y,z\n1,2,3\n")
    first, second = load_tables(spark, str(tmp_path))
    assert [t for _, t in first.dtypes] == ["bigint", "bigint", "double", "boolean", "string"] and second.columns == ["row_id", "x", "y", "z"]
    assert [tuple(r) for r in first.orderBy("row_id").collect()] == [(0, 1, 1.0, True, "x"), (1, -2, 2500.0, False, "007a"), (2, None, None, None, None)]
    with pytest.raises(ValueError, match="2 tables"):
        load_table(spark, str(tmp_path))
    (tmp_path / "many").mkdir()
    for k, n in enumerate([3, 4000, 50]):
        (tmp_path / "many" / f"f{k}.csv").write_text("k,v\n" + "".join(f"{k},{i}\n" for i in range(n)))
    keyed = load_table(spark, str(tmp_path / "many")).orderBy("row_id").collect()
    assert [(r.k, r.v) for r in keyed] == [(k, i) for k, n in enumerate([3, 4000, 50]) for i in range(n)]
    assert [r.row_id for r in keyed] == list(range(4053))


def test_members_of_bundles_and_broken_ones(spark, tmp_path):
    (tmp_path / "t.tar.gz").write_bytes(tarred({"d/a.txt": "A", "b.txt": "BB"}, "w:gz"))
    (tmp_path / "z.zip").write_bytes(b"PK\x03\x04 broken")
    got = read_members(spark, str(tmp_path)).collect()
    assert sorted((r.member, bytes(r.content)) for r in got if r.error is None) == [("b.txt", b"BB"), ("d/a.txt", b"A")]
    assert [r.archive.rsplit("/", 1)[1] for r in got if r.error] == ["z.zip"]


def test_quoted_line_breaks_on_request(spark, tmp_path):
    (tmp_path / "m.csv").write_text('a,b\n1,"x\ny"\n')
    assert rows(ingest(spark, str(tmp_path / "m.csv"), multi_line=True).tables[0], "a", "b") == [("1", "x\ny")]


def test_tar_members_and_hidden_ones(spark, tmp_path):
    (tmp_path / "t.tar").write_bytes(tarred({"x/one.csv": CSV, "x/.two.csv": CSV, "three.tsv": CSV.replace(",", "\t")}))
    files = expand(spark, str(tmp_path / "t.tar"))
    assert rows(files, "chain", "reader", "size") == [("three.tsv", "tsv", 12), ("x/one.csv", "csv", 12)]
    assert rows(ingest(spark, str(tmp_path / "t.tar")).union().distinct().select("a", "b").distinct(), "a", "b") == [
        ("1", "x"), ("2", "y")]


def test_load_table_and_preview(spark, tmp_path):
    (tmp_path / "p.csv").write_text("a,b,c\n1,,x\n2,,\n")
    df = load_table(spark, str(tmp_path / "p.csv"))
    assert df.columns == ["row_id", "a", "c"] and df.count() == 2
    seen = file_preview(spark, str(tmp_path / "p.csv"))
    assert seen["shape"] == (2, 3) and seen["null_counts"] == {"a": 0, "b": 2, "c": 1}
    assert seen["mime"] == "text/csv" and seen["ingestion_status"] == "SUCCESS" and seen["size_human"] == "15.0 B"
    with pytest.raises(ValueError):
        load_table(spark, str(tmp_path / "none.csv"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'q"x,', None), (2, "", "z")], "n bigint, s string, t string")
    for suffix in ("csv", "tsv", "json", "parquet", "what"):
        path = str(tmp_path / f"out.{suffix}")
        fmt = sinks.write_table(df, path)
        assert fmt == {"what": "csv"}.get(suffix, suffix)
        back = ingest(spark, path).union()
        assert rows(back.selectExpr("cast(n as bigint) n", "nullif(s, '') s"), "n", "s") == [(1, 'q"x,'), (2, None)]
    assert sinks.auto_name("IPA: v-1 x").rsplit("_", 2)[0] == "IPA_v-1_x"
    assert sinks.write_named(df, str(tmp_path), "My schema").endswith(".csv")


def test_layouts_are_found_without_carrying_heads(spark, tmp_path):
    """Heads are read where the layout is found; long headers are whole, and what is no text has none."""
    from tablewright.sources.tables import with_layout

    long = ",".join(f"column_{i}_" + "x" * 600 for i in range(200))
    (tmp_path / "long.csv").write_text(f"{long}\n" + "1," * 199 + "1\n")
    (tmp_path / "semi.txt").write_text("a;b\n1;2\n", encoding="utf-16")
    rows = [(f"{tmp_path}/long.csv", "UTF-8", ","), (f"{tmp_path}/semi.txt", "UTF-16", None), (f"{tmp_path}/none", None, None)]
    files = spark.createDataFrame(rows * 20, "path string, enc string, fixed string").coalesce(1)
    got = with_layout(files, "enc", "fixed").collect()
    assert len(got) == 60
    assert {(r.path[-8:], r.layout and (r.layout.sep, tuple(r.layout.header))) for r in got} == {
        ("long.csv", (",", tuple(long.split(",")))), ("semi.txt", (";", ("a", "b"))), (str(tmp_path / "none")[-8:], None)}


def test_files_are_written_without_a_head_in_every_row(spark, tmp_path):
    from checks.queries_files import write_files

    lines = spark.createDataFrame([(f"f{i % 3}.csv", i, str(i)) for i in range(30)], "file string, part int, line string")
    assert write_files(lines, str(tmp_path), "plain", "h" * 100_000, "latin-1").count() == 3
    assert (tmp_path / "f1.csv").read_text() == "h" * 100_000 + "\n" + "".join(f"{i}\n" for i in range(1, 30, 3))


def test_kinds_of_odd_texts(spark):
    """Short ways to a kind agree with the casts they stand for."""
    from pyspark.sql import functions as F

    texts = ["1", "+1", "-01", "007", "1.", ".5", "1.5", "-.5e3", "1e5", "1E-5", "1e+5", "0x1p-3", "1d", "1.f", "inf", "-Inf", "Infinity", "NaN", "nanx", "true", "FALSE", "", "9" * 18,
             "9" * 19, "-" + "9" * 20, "1996-03-13", "1:2", "1/2", "a", "N", "\t1.5", "\t-5", "12\n", "1d\n", "1 ", "-", "+", "e5", "١", "1-", "1e-", "1e5-3", "+ 1"]
    c = F.col("s")
    slow = (F.when(c.rlike(r"^[+-]?\d+$") & c.try_cast("bigint").isNotNull(), 1).otherwise(0)
            + F.when(c.try_cast("double").isNotNull() & ~c.rlike("[dDfF]$"), 2).otherwise(0) + F.when(F.lower(c).isin("true", "false"), 4).otherwise(0))
    got = spark.createDataFrame([(t,) for t in texts], "s string").select("s", slow.alias("slow"), tables._kinds_of(c).alias("quick")).collect()
    assert [(r.s, r.slow) for r in got] == [(r.s, r.quick) for r in got]


def test_plain_files_are_not_sent_to_python(spark, tmp_path):
    """Files of plain characters are found and read without cleaning; others send a row to Python once, not once a column."""
    (tmp_path / "plain.csv").write_text("a,b,c\n1,x,y\n2,z,\t\n")
    (tmp_path / "marked.csv").write_text("k,v,w\n1,é,Å\n2,b\x07�,NA\n")
    (tmp_path / "latin.csv").write_bytes("m,n\n1,caf\xe9\n".encode("latin-1"))
    result = ingest(spark, str(tmp_path), typed=True)
    assert {x.header[0]: x.plain for x in result.layouts} == {"a": True, "k": False, "m": False}
    plans = {df.columns[0]: df._jdf.queryExecution().executedPlan().toString() for df in result.tables}
    assert "ArrowEvalPython" not in plans["a"] and plans["k"].count("ArrowEvalPython") == 1 and plans["k"].count("_compose") >= 1
    held = {df.columns[0]: df for df in result.tables}
    assert sorted(tuple(r)[:3] for r in held["a"].collect()) == [(1, "x", "y"), (2, "z", "\t")]
    assert rows(held["k"], "k", "v", "w") == [(1, "é", "Å"), (2, "b?", None)]
    assert rows(held["m"], "m", "n") == [(1, "caf\xe9")]
