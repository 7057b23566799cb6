import csv
import io
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewright.sources.ingest import ingest, load_tables
from tablewright.sources import records as module
from tablewright.sources.records import ArrayElements, QuotedLines, records
from tablewright.sources.tables import read_delimited, read_json_table


@pytest.fixture
def small_splits(spark):
    """Splits of 2 KB, so that records of this size cross their borders."""
    names = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "2000", "spark.sql.files.minPartitionNum": "1"}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def cell(rng):
    return rng.choice(["plain", "", 'with "quotes"', "a,b", "line\nbreak", "\n\n\"\n,", "it's 5\" long", "é\n€", "x" * rng.randint(0, 900), "\r\nwindows"])


def quoted_file(rng, n):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(["k", "a\nb", "c"])
    rows = [[str(i), cell(rng), cell(rng)] for i in range(n)]
    writer.writerows(rows)
    return out.getvalue(), rows


@pytest.mark.parametrize("encoding", ["UTF-8", "ISO-8859-1"])
def test_quoted_breaks_over_split_borders(spark, small_splits, tmp_path, encoding):
    rng = random.Random(6)
    want = []
    for name in ("one", "two"):
        text, rows = quoted_file(rng, 120)
        if encoding != "UTF-8":
            text, rows = text.replace("€", "e"), [[c.replace("€", "e") for c in r] for r in rows]
        (tmp_path / f"{name}.csv").write_bytes(text.encode(encoding))
        want += [(f"{name}.csv", *r) for r in rows]
    df = read_delimited(spark, str(tmp_path), ["k", "b", "c"], encoding=encoding, multi_line=True, with_source=True, with_start=True, compose=False)
    # with_start orders the rows of a file
    whole = spark.read.schema("k string, b string, c string").csv(
        str(tmp_path), header=True, multiLine=True, quote='"', escape='"', encoding=encoding, emptyValue="", maxCharsPerColumn=-1)
    assert len({(r["source_file"], r["__start"]) for r in df.collect()}) > 10
    got = df.groupBy(F.substring_index("source_file", "/", -1).alias("f"), "k").agg(F.count("*").alias("n")).collect()
    assert {(r.f, r.k): r.n for r in got} == {(f, k): 1 for f, k, _, _ in want}
    text = records(spark, str(tmp_path), QuotedLines(","), encoding).where("path LIKE '%one.csv'").collect()
    read = [next(csv.reader(io.StringIO(r.record))) for r in text]
    assert sorted(map(tuple, read)) == sorted(tuple(r[1:]) for r in want if r[0] == "one.csv")
    assert df.count() == whole.count() == len(want)


def test_rows_keep_their_order(spark, small_splits, tmp_path):
    text, rows = quoted_file(random.Random(9), 120)
    (tmp_path / "t.csv").write_text(text)
    (df,) = load_tables(spark, str(tmp_path / "t.csv"), typed=False, multi_line=True)
    assert [r["k"] for r in df.orderBy("row_id").collect()] == [r[0] for r in rows]


def test_quotes_inside_fields_and_open_ends(spark, small_splits, tmp_path):
    """An inch mark opens nothing; a field that is never closed runs to the end of its file and no further."""
    lines = ["k,size"] + [f'{i},5" pipe' for i in range(200)] + ['200,"open', "still open", "and on"]
    (tmp_path / "a.csv").write_text("\n".join(lines))
    (tmp_path / "b.csv").write_text('k,size\n1,"two\nlines"\n')
    got = {(r.path[-5:], r.record) for r in records(spark, str(tmp_path), QuotedLines(",")).collect()}
    assert got == {("a.csv", f'{i},5" pipe') for i in range(200)} | {("a.csv", '200,"open\nstill open\nand on'), ("b.csv", '1,"two\nlines"')}


def test_lines_of_every_state():
    form = QuotedLines(",")
    for line in ("", "a", '"', '""', 'a,"b', 'a"b,c', '"a"b,"c', '"a""b', 'x",y', '",",', '","', '"""', 'a,"",b', '"a","b'):
        for inside in (False, True):
            # the state after a line is the one that a reader of one character at a time is in
            state, at, text = ("quoted" if inside else "start"), 0, line
            while at < len(text):
                c = text[at]
                if state == "quoted":
                    if c == '"' and text[at + 1:at + 2] == '"':
                        at += 1
                    elif c == '"':
                        state = "field"
                elif c == ",":
                    state = "start"
                else:
                    state = "quoted" if state == "start" and c == '"' else "field"
                at += 1
            assert form.after(line, inside)[0] == (state == "quoted"), (line, inside)


@pytest.mark.parametrize("indent", [None, 2])
def test_json_arrays_over_split_borders(spark, small_splits, tmp_path, indent):
    rng = random.Random(4)
    want = [{"k": i, "t": cell(rng) + rng.choice(["}", "{[", '\\"', "\\", "],", ""]), "deep": {"x": [{"y": i}], "z": None if i % 3 else {"w": "}"}}} for i in range(60)]
    (tmp_path / "a.json").write_text(json.dumps(want, indent=indent, ensure_ascii=False))
    (tmp_path / "b.json").write_text(json.dumps([]))
    (tmp_path / "c.json").write_text("﻿" + json.dumps(want[:1]))
    got = [json.loads(r.record) for r in records(spark, str(tmp_path / "a.json"), ArrayElements()).collect()]
    assert sorted(got, key=lambda r: r["k"]) == want
    df = read_json_table(spark, str(tmp_path), False, with_source=True)
    assert df.count() == 61 and set(df.columns) == {"k", "t", "deep", "source_file"}
    assert df.where("source_file LIKE '%a.json'").agg(F.sum("k"), F.sum(F.col("deep.x")[0]["y"]), F.count("deep.z.w")).first() == (1770, 1770, 20)
    result = ingest(spark, str(tmp_path / "a.json"))
    assert result.status == "SUCCESS" and result.union().count() == 60


def test_arrays_of_bounded_size_by_many_tasks(spark, tmp_path, monkeypatch):
    """No task writes all objects; empty and repeated texts come back as well."""
    from checks import queries_files
    from tablewright import session

    rows = [(i, None if i % 50 == 3 else f'text "{i % 40}" }} [' * 20, "s", i) for i in range(300)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(queries_files, "ARRAY_BYTES", 20_000)
    got = queries_files.read_json_array_split(spark, str(tmp_path)).collect()
    path = [p for p in session._made if "/array-" in p][-1]
    sizes = [r.length for r in spark.read.format("binaryFile").load(path).select("length").collect()]
    assert len(sizes) >= 4 and max(sizes) < sum(sizes) / 2
    assert sorted((r.doc_id, r.text, r.source, r.n_chars, r.part) for r in got if r.text) == sorted((*r, r[0] % 7) for r in rows if r[1])
    assert len(got) == 300


def test_chunks_of_every_state():
    """Ends of chunks are those that a reader of one character at a time comes to, whichever state it begins in."""
    rng = random.Random(12)
    for _ in range(300):
        chunks = ["".join(rng.choice('"\\\\[{]é,x') for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 12))]
        skip = rng.randint(0, len(chunks) - 1)
        found = ArrayElements().ends(pa.array(chunks)[skip:])
        for begun in (False, True):
            inside, depth, want = begun, 0, []
            for chunk in chunks[skip:]:
                at = 0
                while at < len(chunk):
                    if inside and chunk[at] == "\\":
                        at += 1
                    elif chunk[at] == '"':
                        inside = not inside
                    elif not inside:
                        depth += (chunk[at] in "[{") - (chunk[at] == "]")
                    at += 1
                depth -= not inside
                want.append((inside, depth))
            # a backslash outside of strings stands in no JSON; one that a chunk ends with does not reach the next either
            if all(not c.replace("\\\\", "").endswith("\\") for c in chunks) and not _loose_slashes(chunks[skip:], begun):
                got = found.after(begun)
                assert [*zip(got[0].tolist(), got[1].tolist())] == want, (chunks[skip:], begun)


def _loose_slashes(chunks, inside):
    for chunk in chunks:
        at = 0
        while at < len(chunk):
            if chunk[at] == "\\":
                if not inside:
                    return True
                at += 1
            elif chunk[at] == '"':
                inside = not inside
            at += 1
    return False


def test_array_elements_are_parsed_once_by_few_tasks(spark, small_splits, tmp_path, monkeypatch):
    """One reading of a record serves all its columns, and small splits do not each cost a task; parts of a few bytes give the same."""
    monkeypatch.setattr(module, "HELD_BYTES", 100, raising=False)
    rng = random.Random(3)
    want = [{"k": i, "t": cell(rng), "u": rng.choice(["e\u0301 \x07", "\ufffd", "\u20ac \u2019", "\U0001f600"]), "deep": {"x": [i]}} for i in range(1500)]
    (tmp_path / "a.json").write_text(json.dumps(want, ensure_ascii=False))
    assert (tmp_path / "a.json").stat().st_size > 50 * 2000
    df = read_json_table(spark, str(tmp_path), False)
    plan = df._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("from_json") == 1
    assert df.rdd.getNumPartitions() <= 2 * 4 * spark.sparkContext.defaultParallelism
    cleaned = {"e\u0301 \x07": "\xe9 ", "\ufffd": "?"}
    got = sorted((r.k, r.t, r.u, r.deep.x[0]) for r in df.collect())
    assert got == [(r["k"], r["t"].replace("e\u0301", "\xe9"), cleaned.get(r["u"], r["u"]), r["k"]) for r in want]
