"""Files: every query writes a given table in some form to the shared folder and reads it back."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import functions as F

from checks.catalog import query, table
from checks.fixtures import MESSY, messy, sql_bool, sql_number, sql_repair
from tablewright.operators.snapshots import SnapshotStore
from tablewright.plans.schema import STANDARD, TargetColumn, TargetSchema
from tablewright.session import materialise, scratch_path
from tablewright.sources import sinks, tables
from tablewright.sources.archives import expand, read_members
from tablewright.sources.files import inventory, list_files, open_path, typed, with_heads
from tablewright.sources.ingest import ingest, load_tables
from tablewright.streaming import incremental, issue_state

#: what a batch of arriving files may hold; their number grows with the table, so batches are not counted in files
BATCH_BYTES = 64 << 20

#: text that goes into one JSON array
ARRAY_BYTES = 64 << 20

CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
CUSTOMER_SQL = ("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, "
                "c_mktsegment FROM customer")


def _customer(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(*[F.col(c).cast("string").alias(c) for c in CUSTOMER])


def write_files(lines, folder: str, pack: str, head: str, encoding: str = "utf-8"):
    """Run inside tasks: one file per ``file`` key of (file, part, line), packed as named, with ``head`` as its first line.

    A file takes the rows of one key; the callers cut their tables into keys of bounded size.
    """
    def put(batch: pd.DataFrame) -> pd.DataFrame:
        name = str(batch["file"].iloc[0])
        body = batch.sort_values("part")["line"].str.cat(sep="\n") + "\n"
        data = f"{head}\n{body}".encode(encoding)
        out = io.BytesIO()
        target = name
        if pack == "plain":
            out.write(data)
        elif pack == "gzip":
            out.write(gzip.compress(data))
            target += ".gz"
        elif pack == "zip":
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr(f"inner/{name}", data)
                z.writestr(f".hidden/{name}", data)
                z.writestr(f"inner/.{name}", data)
            target += ".zip"
        elif pack == "nested":
            inner = io.BytesIO()
            with tarfile.open(fileobj=inner, mode="w") as t:
                info = tarfile.TarInfo(f"deep/{name}")
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
            with zipfile.ZipFile(out, "w") as z:
                z.writestr("members.tar", inner.getvalue())
            target += ".zip"
        else:
            with tarfile.open(fileobj=out, mode="w:gz" if pack == "tar.gz" else "w") as t:
                info = tarfile.TarInfo(f"inner/{name}")
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
            target += f".{pack}"
        system, inner_path = open_path(f"{folder}/{target}")
        system.create_dir(inner_path.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(inner_path, compression=None) as stream:
            stream.write(out.getvalue())
        return pd.DataFrame({"path": [f"{folder}/{target}"], "bytes": [len(out.getvalue())]})

    return lines.groupBy("file").applyInPandas(put, "path string, bytes bigint")


def _delimited(spark, sf_dir, sep=",", suffix=".csv", rows_per_file=500):
    """(file, part, line): customers as text lines, a bounded number per file."""
    df = _customer(spark, sf_dir)
    key = F.col("c_custkey").cast("bigint")
    return df.select(
        F.concat(F.lit("customers"), F.floor(key / rows_per_file).cast("string"), F.lit(suffix)).alias("file"),
        key.alias("part"), F.concat_ws(sep, *CUSTOMER).alias("line"))


def _written(spark, sf_dir, pack, sep=",", encoding="utf-8", **options):
    folder = scratch_path(spark, f"files-{pack.replace('.', '-')}")
    write_files(_delimited(spark, sf_dir, sep, **options), folder, pack, sep.join(CUSTOMER), encoding).count()
    return folder


def _back(spark, folder):
    return ingest(spark, folder).union().select(*CUSTOMER)


def _round_trip(name, suffix):
    @query(CUSTOMER_SQL, name=name)
    def run(spark, sf_dir):
        path = scratch_path(spark, "sink") + suffix
        sinks.write_table(_customer(spark, sf_dir), path)
        return _back(spark, path)

    return run


_round_trip("csv_roundtrip", ".csv")
_round_trip("tsv_roundtrip", ".tsv")
_round_trip("unknown_suffix_roundtrip", ".out")
_round_trip("parquet_roundtrip", ".parquet")
_round_trip("json_roundtrip", ".json")


def _packed(name, pack, **options):
    @query(CUSTOMER_SQL, name=name)
    def run(spark, sf_dir):
        return _back(spark, _written(spark, sf_dir, pack, **options))

    return run


_packed("read_gzip", "gzip")
_packed("read_zip", "zip")
_packed("read_tar", "tar")
_packed("read_tar_gz", "tar.gz")
_packed("read_nested_archives", "nested")
_packed("sniff_semicolon", "plain", sep=";", suffix=".txt")
_packed("sniff_pipe", "plain", sep="|", suffix=".txt")
_packed("sniff_tab", "plain", sep="\t", suffix=".dat")
_packed("read_utf16", "plain", encoding="utf-16")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, 'Caf' || chr(233) || ' ' || n_name AS label FROM nation")
def read_latin1(spark, sf_dir):
    """Bytes that are no valid UTF-8 are read as Latin-1."""
    folder = scratch_path(spark, "files-latin1")
    lines = table(spark, sf_dir, "nation").select(
        F.lit("nations.csv").alias("file"), F.col("n_nationkey").alias("part"),
        F.concat(F.col("n_nationkey").cast("string"), F.lit(",Café "), "n_name").alias("line"))
    write_files(lines, folder, "plain", "n_nationkey,label", "latin-1").count()
    return ingest(spark, folder).union().select("n_nationkey", "label")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN o_orderkey % 5 <> 1 THEN o_orderstatus END AS o_orderstatus,
CASE WHEN o_orderkey % 5 NOT IN (1, 2) THEN o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 5 <> 0""")
def irregular_rows(spark, sf_dir):
    """Rows with too many fields go, short rows are padded, missing-value literals become NULL."""
    folder = scratch_path(spark, "irregular")
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    line = (F.when(k % 5 == 0, F.concat_ws(",", k.cast("string"), "o_orderstatus", "o_orderpriority", F.lit("surplus")))
            .when(k % 5 == 1, k.cast("string"))
            .when(k % 5 == 2, F.concat_ws(",", k.cast("string"), "o_orderstatus", F.lit("N/A")))
            .otherwise(F.concat_ws(",", k.cast("string"), "o_orderstatus", F.concat(F.lit('"'), "o_orderpriority", F.lit('"')))))
    lines = o.select(F.concat(F.lit("orders"), F.floor(k / 2000).cast("string"), F.lit(".csv")).alias("file"), k.alias("part"), line.alias("line"))
    write_files(lines, folder, "plain", "o_orderkey,o_orderstatus,o_orderpriority").count()
    return tables.read_delimited(spark, folder, ["o_orderkey", "o_orderstatus", "o_orderpriority"])


@query(CUSTOMER_SQL)
def read_long_header(spark, sf_dir):
    """A header of more than 64 KiB between the first column and the others; every row fills it."""
    folder = scratch_path(spark, "header")
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    pads = [f"pad_{i}_" + "x" * 700 for i in range(100)]
    line = F.concat_ws(",", k.cast("string"), F.lit("," * (len(pads) - 1)), "c_name", F.col("c_nationkey").cast("string"), "c_mktsegment")
    lines = c.select(F.concat(F.lit("wide"), F.floor(k / 500).cast("string"), F.lit(".csv")).alias("file"), k.alias("part"), line.alias("line"))
    write_files(lines, folder, "plain", ",".join([CUSTOMER[0], *pads, *CUSTOMER[1:]])).count()
    return ingest(spark, folder).union().select(*CUSTOMER)


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, CAST(n_chars AS VARCHAR) AS n_chars FROM documents")
def read_quoted_breaks(spark, sf_dir):
    """Texts with line breaks and quotes, as quoted fields of CSV files."""
    folder = scratch_path(spark, "breaks")
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    held = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    lines = d.select(F.concat(F.lit("docs"), F.floor(k / 500).cast("string"), F.lit(".csv")).alias("file"), k.alias("part"),
                     F.concat_ws(",", k.cast("string"), held, F.col("n_chars").cast("string")).alias("line"))
    write_files(lines, folder, "plain", "doc_id,text,n_chars").count()
    return ingest(spark, folder).union().select("doc_id", "text", "n_chars")


@query("""SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate, l_quantity > 25 AS is_large FROM lineitem""")
def ingest_typed(spark, sf_dir):
    """Every column of lineitem through CSV and back, with its type."""
    path = scratch_path(spark, "typed") + ".csv"
    df = table(spark, sf_dir, "lineitem").withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd")).withColumn("is_large", F.col("l_quantity") > 25)
    sinks.write_table(df, path)
    return ingest(spark, path, typed=True).union().drop("source_file")


@query("""SELECT 'customer' AS kind, c_custkey AS key, c_name AS name FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier""")
def ingest_two_layouts(spark, sf_dir):
    """Two kinds of tables in one folder: both come back."""
    folder = scratch_path(spark, "layouts")
    for name in ("customer", "supplier"):
        sinks.write_table(table(spark, sf_dir, name), f"{folder}/{name}.csv")
    found = {df.columns[1][0]: df for df in load_tables(spark, folder)}
    return found["c"].select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name")).unionByName(
        found["s"].select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")))


@query("SELECT count(DISTINCT c_custkey // 500) AS files_extracted, count(DISTINCT c_custkey // 500) AS tabular_files, 0::BIGINT AS failed_files FROM customer")
def ingest_totals(spark, sf_dir):
    return ingest(spark, _written(spark, sf_dir, "zip")).totals()


@query("""SELECT 'customers' || f || '.csv' AS name, '.csv' AS extension, 'plain' AS kind, 'text/csv' AS mime, true AS is_tabular,
'csv' AS reader, 'inner/customers' || f || '.csv' AS chain FROM (SELECT DISTINCT c_custkey // 500 AS f FROM customer)""")
def archive_members(spark, sf_dir):
    return expand(spark, _written(spark, sf_dir, "zip")).select("name", "extension", "kind", "mime", "is_tabular", "reader", "chain")


@query("""SELECT 'customers' || f || '.csv' AS name, '.csv' AS extension, 'text/csv' AS mime, size, CASE WHEN size < 1024 THEN
printf('%.1f B', size::DOUBLE) ELSE printf('%.1f KB', size / 1024.0::DOUBLE) END AS size_human FROM (
  SELECT c_custkey // 500 AS f, CAST(42 + sum(length(concat_ws(',', c_custkey, c_name, c_nationkey, c_mktsegment)) + 1) AS BIGINT) AS size
  FROM customer GROUP BY ALL)""")
def file_inventory(spark, sf_dir):
    return inventory(spark, _written(spark, sf_dir, "plain")).drop("path")


@query("SELECT 'customers' || f || '.csv' AS name, 'c_custkey,c_name' AS head FROM (SELECT DISTINCT c_custkey // 500 AS f FROM customer)")
def file_heads(spark, sf_dir):
    heads = with_heads(list_files(spark, _written(spark, sf_dir, "plain")), 16)
    return typed(heads).select("name", F.col("head").cast("string").alias("head"))


@query("""SELECT 'inner/customers' || f || '.csv' AS member, CAST(42 + sum(length(concat_ws(',', c_custkey, c_name, c_nationkey, c_mktsegment)) + 1) AS BIGINT) AS size,
CAST(42 + sum(length(concat_ws(',', c_custkey, c_name, c_nationkey, c_mktsegment)) + 1) AS BIGINT) AS content_bytes
FROM (SELECT *, c_custkey // 500 AS f FROM customer) GROUP BY f""")
def small_members(spark, sf_dir):
    members = read_members(spark, _written(spark, sf_dir, "zip"))
    return members.select("member", "size", F.length("content").cast("bigint").alias("content_bytes"))


@query("""SELECT 'preprocessing' AS stage, count(*) AS rows, 4::INTEGER AS "columns" FROM customer
UNION ALL SELECT 'complete', count(*), 4 FROM customer WHERE c_custkey % 2 = 0""")
def snapshot_store(spark, sf_dir):
    store = SnapshotStore(spark, scratch_path(spark, "snapshots"))
    df = _customer(spark, sf_dir)
    store.create("preprocessing", df, {"action": "first"})
    store.create("complete", df)
    store.create("complete", df.where(F.col("c_custkey").cast("bigint") % 2 == 0))
    newest = [store.latest_of(s) for s in ("preprocessing", "complete")]
    out = [data.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(info["stage"]).alias("stage"), "rows", F.lit(info["columns"]).alias("columns")) for info, data in newest]
    return out[0].unionByName(out[1])


ROW_LOCAL = TargetSchema("incremental", columns=[
    *STANDARD.columns, TargetColumn("Significant", "bool", source="is_sig", required=False),
    TargetColumn("Visit", "date", required=False)])


@query(f"""WITH {MESSY} SELECT row_id, {sql_repair('g')} AS "GeneSymbol", {sql_number('f')} AS "FoldChange",
CASE WHEN ({sql_number('a')}) < 0 THEN 0.0 WHEN ({sql_number('a')}) > 1 THEN 1.0 ELSE ({sql_number('a')}) END AS "PValue",
{sql_bool('is_sig')} AS "Significant", CAST(try_strptime(visit, '%Y-%m-%d') AS DATE) AS "Visit" FROM (
  SELECT row_id, CASE WHEN "Gene_ID" <> 'NA' THEN trim("Gene_ID", ' ' || chr(9)) END AS g,
    CASE WHEN "log2FC" <> 'N/A' THEN "log2FC" END AS f, CASE WHEN adj_p <> '' THEN adj_p END AS a, is_sig, visit FROM messy)""")
def incremental_harmonise(spark, sf_dir):
    """Arriving files give what one batch job gives."""
    folder = scratch_path(spark, "arrivals")
    rows = messy(spark, sf_dir)
    header = ["row_id", "Gene_ID", "log2FC", "adj_p", "is_sig", "visit"]
    fields = [F.concat(F.lit('"'), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"')) for c in header]
    lines = rows.select(
        F.concat(F.lit("batch"), F.floor(F.col("row_id") / 1000).cast("string"), F.lit(".csv")).alias("file"),
        F.col("row_id").alias("part"), F.concat_ws(",", *fields).alias("line"))
    write_files(lines, folder, "plain", ",".join(header)).count()
    arrivals = incremental.read_arrivals(spark, folder, header, max_bytes=BATCH_BYTES)
    arrivals = arrivals.withColumn("row_id", F.col("row_id").cast("bigint"))
    out, notes, state = (scratch_path(spark, x) for x in ("harmonised", "batch-issues", "stream-state"))
    incremental.start(arrivals, ROW_LOCAL, out, notes, state).awaitTermination()
    return incremental.harmonised(spark, out)




@contextmanager
def _splits_of(spark, size: int):
    """Plain files are dealt out in splits of about ``size`` bytes inside."""
    names = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": str(size)}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    try:
        yield
    finally:
        for n, v in before.items():
            if v is None:
                spark.conf.unset(n)
            else:
                spark.conf.set(n, v)


@query("""SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, source, CAST(n_chars AS VARCHAR) AS n_chars, true AS many_tasks FROM documents""")
def read_quoted_breaks_split(spark, sf_dir):
    """One file of all documents, with line breaks inside its fields, read by several tasks."""
    path = scratch_path(spark, "breaks") + ".csv"
    sinks.write_table(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars"), path)
    with _splits_of(spark, 256 * 1024):
        read = tables.read_delimited(spark, path, ["doc_id", "text", "source", "n_chars"], multi_line=True, compose=False, with_start=True)
        # written here, as the size of splits is that of the time a scan runs
        kept = materialise(read.withColumn("task", F.spark_partition_id()), "read")
    tasks = kept.agg((F.count_distinct("task") > 1).alias("many_tasks"))
    return kept.drop("task", tables.START).join(F.broadcast(tasks))


@query("""SELECT doc_id, text, source, n_chars, len(string_split(text, ' ')) AS words, doc_id % 7 AS part FROM documents""")
def read_json_array_split(spark, sf_dir):
    """All documents as JSON arrays on single lines, some ARRAY_BYTES of text each, with objects inside objects, read by several tasks each."""
    path = scratch_path(spark, "array")
    d = table(spark, sf_dir, "documents")
    held = d.select(F.struct("doc_id", "text", "source", "n_chars", F.struct(F.size(F.split("text", " ", -1)).alias("words"), F.struct((F.col("doc_id") % 7).alias("part")).alias("own")).alias("facts")).alias("o"))
    # a task writes one file, so a single array would be one task's work whatever its size
    files = 1 + (d.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ARRAY_BYTES
    # the text sink with a comma for line ends makes one line of objects; a bracket comes first, and none closes the array
    objects = held.select(F.pmod(F.xxhash64("o.doc_id", "o.text"), F.lit(files)).alias("file"), F.lit(1).alias("place"), F.to_json("o").alias("value"))
    first = spark.range(files).select(F.col("id").alias("file"), F.lit(0).alias("place"), F.lit('[{"doc_id":null}').alias("value"))
    dealt = first.unionByName(objects).repartitionById(files, F.col("file").cast("int"))
    dealt.sortWithinPartitions("place").select("value").write.option("lineSep", ",").text(path)
    with _splits_of(spark, 256 * 1024):
        read = materialise(tables.read_json_table(spark, path, lines=False), "read")
    return read.where("doc_id IS NOT NULL").select("doc_id", "text", "source", "n_chars", F.col("facts.words").cast("int").alias("words"), F.col("facts.own.part").alias("part"))


@query("""SELECT CAST(o_orderkey AS BIGINT) AS "row_id", CASE WHEN o_orderkey % 5 NOT IN (1, 2) THEN 'Caf' || chr(233) || ' ' || o_orderpriority END AS priority,
  CASE WHEN o_orderkey % 5 <> 1 THEN 'one' || chr(10) || 'two, "' || o_orderstatus || '"' END AS status,
  CASE WHEN o_orderkey % 5 <> 1 THEN o_totalprice END AS price FROM orders WHERE o_orderkey % 5 <> 0""")
def incremental_irregular(spark, sf_dir):
    """Arriving Latin-1 files with surplus and short rows, missing-value literals, quotes and line breaks inside fields."""
    folder = scratch_path(spark, "irregular-arrivals")
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    status = F.concat(F.lit('"one\ntwo, ""'), "o_orderstatus", F.lit('"""'))
    price, label = F.col("o_totalprice").cast("string"), F.concat(F.lit("Café "), "o_orderpriority")
    line = (F.when(k % 5 == 0, F.concat_ws(",", k.cast("string"), status, price, label, F.lit("surplus")))
            .when(k % 5 == 1, k.cast("string")).when(k % 5 == 2, F.concat_ws(",", k.cast("string"), status, price, F.lit("N/A")))
            .otherwise(F.concat_ws(",", k.cast("string"), status, price, label)))
    lines = o.select(F.concat(F.lit("orders"), F.floor(k / 2000).cast("string"), F.lit(".csv")).alias("file"), k.alias("part"), line.alias("line"))
    write_files(lines, folder, "plain", "row_id,status,price,priority", "latin-1").count()
    arrivals = incremental.read_arrivals(spark, folder, ["row_id", "status", "price", "priority"], max_bytes=BATCH_BYTES, encoding="ISO-8859-1", multi_line=True)
    schema = TargetSchema("orders", columns=[TargetColumn("status", "string", required=False), TargetColumn("price", "float", required=False),
                                             TargetColumn("priority", "string", required=False)])
    out, notes, state = (scratch_path(spark, x) for x in ("irregular", "irregular-issues", "irregular-state"))
    incremental.start(arrivals.withColumn("row_id", F.col("row_id").cast("bigint")), schema, out, notes, state).awaitTermination()
    return incremental.harmonised(spark, out)


@query(f"""WITH {MESSY}, s AS (SELECT CASE WHEN "Gene_ID" <> 'NA' THEN trim("Gene_ID", ' ' || chr(9)) END AS g,
    CASE WHEN "log2FC" <> 'N/A' THEN "log2FC" END AS f, CASE WHEN adj_p <> '' THEN adj_p END AS a FROM messy),
t AS (SELECT g, {sql_repair('g')} AS r, f, {sql_number('f')} AS fn, a, {sql_number('a')} AS p FROM s)
SELECT 'GeneSymbol' AS target, 'Gene_ID' AS "column", unnest(['coerced', 'nulls', 'pattern_after', 'pattern_before', 'rows']) AS counter, unnest([
  0, count(*) FILTER (r IS NULL), count(*) FILTER (NOT regexp_matches(r, '^[A-Za-z][A-Za-z0-9-]*$')), count(*) FILTER (NOT regexp_matches(g, '^[A-Za-z][A-Za-z0-9-]*$')), count(*)]) AS n,
  count(*) AS rows FROM t
UNION ALL SELECT 'FoldChange', 'log2FC', unnest(['coerced', 'nulls', 'rows']), unnest([count(*) FILTER (f IS NOT NULL AND fn IS NULL), count(*) FILTER (fn IS NULL), count(*)]), count(*) FROM t
UNION ALL SELECT 'PValue', 'adj_p', unnest(['clamped', 'coerced', 'nulls', 'rows']), unnest([
  count(*) FILTER (p < 0 OR p > 1), count(*) FILTER (a IS NOT NULL AND p IS NULL), count(*) FILTER (p IS NULL), count(*)]), count(*) FROM t""")
def incremental_issue_state(spark, sf_dir):
    """Issue counters of two waves of files, the second one after a restart of the stream."""
    folder, header = scratch_path(spark, "issue-arrivals"), ["row_id", "Gene_ID", "log2FC", "adj_p"]
    rows = messy(spark, sf_dir).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in header])
    out, state = scratch_path(spark, "issue-totals"), scratch_path(spark, "issue-state")
    for wave in (0, 1):
        rows.where(F.col("row_id") % 2 == wave).repartition(6).write.mode("append").option("header", True).option("quoteAll", True).option("escape", '"').csv(folder)
        arrivals = incremental.read_arrivals(spark, folder, header, max_files=4)
        issue_state.start_issue_state(arrivals, STANDARD, out, state).awaitTermination()
    return issue_state.current_issues(spark, out)
