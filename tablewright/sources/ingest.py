"""Ingestion: files and archives to tables, with a manifest of every file seen."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablewright.operators.clean import drop_empty_columns, quoted
from tablewright.operators.profile import preview
from tablewright.plans.schema import ROW_ID
from tablewright.session import materialise
from tablewright.sources import tables
from tablewright.sources.archives import expand
from tablewright.sources.files import inventory, same_path
from tablewright.sources.paths import path_exists

UNREADABLE = "Could not parse file with any method"


@dataclass(frozen=True)
class Layout:
    """Files that share reader, delimiter, encoding, header and line-break rule; they are one DataFrame."""

    reader: str
    sep: str | None
    encoding: str | None
    header: tuple[str, ...]
    paths: tuple[str, ...]
    multi_line: bool = False
    plain: bool = False


@dataclass
class IngestResult:
    manifest: DataFrame
    status: str
    errors: DataFrame
    tables: list[DataFrame] = field(default_factory=list)
    layouts: list[Layout] = field(default_factory=list)

    def union(self) -> DataFrame:
        """All tables in one, columns matched by name, with ``source_file``."""
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), self.tables)

    def table(self, path: str) -> DataFrame:
        """Rows of one file; only that file is read."""
        for layout in self.layouts:
            if path in layout.paths:
                return _read(self.manifest.sparkSession, replace(layout, paths=(path,))).drop("source_file")
        raise KeyError(path)

    def totals(self) -> DataFrame:
        """One row: files_extracted, tabular_files, failed_files."""
        return self.manifest.agg(
            F.count(F.lit(1)).alias("files_extracted"),
            F.count_if(F.col("is_tabular") & F.col("error").isNull()).alias("tabular_files"),
            F.count_if(F.col("error").isNotNull()).alias("failed_files"))


def ingest(spark: SparkSession, paths: list[str] | str, staging: str | None = None, check_text: bool = True,
           multi_line: bool | None = None, typed: bool = False) -> IngestResult:
    """Read every table behind the paths.

    Files of one layout are read together, so the number of DataFrames grows with the number of
    layouts, not with the number of files. Files with quoted line breaks are found and read whole;
    ``multi_line`` sets that for all files instead. ``typed`` gives text columns their types.
    ``errors`` is a table (label, error) of inputs that are missing and of files that cannot be read.
    """
    paths = paths if isinstance(paths, list) else [paths]
    missing = [p for p in paths if not any(ch in p for ch in "*?[{") and not path_exists(spark, p)]
    present = [p for p in paths if p not in missing]
    errors = spark.createDataFrame([(p, "File not found") for p in missing], "label string, error string")
    if not present:
        return IngestResult(spark.createDataFrame([], "path string, is_tabular boolean, error string"), "FAILED", errors)
    manifest = materialise(_manifest(spark, present, staging, check_text, multi_line), "manifest")
    layouts = _layouts(manifest)
    found = [_read(spark, layout) for layout in layouts]
    if typed:
        found = [tables.typed_columns(df, ("source_file",)) for df in found]
    errors = errors.unionByName(manifest.where(F.col("error").isNotNull()).select("label", "error"))
    status = "FAILED" if not found else "SUCCESS" if errors.isEmpty() else "PARTIAL"
    return IngestResult(manifest, status, errors, found, layouts)


def _manifest(spark: SparkSession, paths: list[str], staging: str | None, check_text: bool, multi_line: bool | None) -> DataFrame:
    from tablewright.functions.files import text_encoding

    files = expand(spark, paths, staging).withColumn("path", same_path(F.col("path")))
    files = files.withColumn("encoding", text_encoding(F.col("head")))
    delimited = F.col("reader").isin("csv", "tsv", "sniff") & F.col("is_tabular")
    texts = [r.path for r in files.where(delimited).select("path").toLocalIterator()] if check_text else []
    if texts:
        files = files.join(tables.text_facts(spark, texts), "path", "left")
    else:
        files = files.withColumns({"valid": F.lit(True), "breaks": F.lit(False), "plain": F.lit(False)})
    encoding = F.coalesce("encoding", F.when(F.coalesce("valid", F.lit(True)), "UTF-8").otherwise("ISO-8859-1"))
    breaks = F.coalesce("breaks", F.lit(False)) if multi_line is None else F.lit(multi_line)
    files = files.withColumn("encoding", F.when(delimited, encoding)).withColumn("multi_line", delimited & breaks).drop("valid", "breaks")
    # other bytes than those looked at are read in other encodings
    files = files.withColumn("plain", F.coalesce(F.col("plain") & (F.col("encoding") == "UTF-8"), F.lit(False)))
    fixed = F.when(F.col("reader") == "csv", ",").when(F.col("reader") == "tsv", "\t")
    named = F.coalesce("encoding", F.lit("UTF-8"))
    first = F.substring(F.ltrim(F.decode(F.substring("head", 1, 64), "ISO-8859-1")), 1, 1)
    files = files.withColumns({"first": first, "named": F.when(delimited, named), "fixed": fixed}).drop("head")
    files = tables.with_layout(files, "named", "fixed")
    readable = (F.col("reader").isin("parquet", "json")
                | (delimited & F.col("layout.header").isNotNull() & (F.size("layout.header") > 0)))
    unreadable = F.when(F.col("is_tabular") & ~F.coalesce(readable, F.lit(False)), UNREADABLE)
    return files.select(
        "root", "chain", "path", "name", "size", "extension", "kind", "mime",
        F.coalesce("is_tabular", F.lit(False)).alias("is_tabular"),
        F.when(F.col("reader") == "json", F.when(F.col("first") == "[", "json").otherwise("json_lines"))
        .when(F.col("reader").isin("csv", "tsv", "sniff"), "delimited").otherwise(F.col("reader")).alias("reader"),
        "encoding", "multi_line", "plain", F.col("layout.sep").alias("sep"),
        F.when(delimited, F.col("layout.header")).alias("header"),
        F.coalesce("error", unreadable).alias("error"),
        F.coalesce("name", F.regexp_extract("root", "([^/]*)$", 1)).alias("label"))


def _layouts(manifest: DataFrame) -> list[Layout]:
    """Distinct layouts with their paths. A path list per layout reaches the driver, as for any read."""
    rows = (manifest.where(F.col("is_tabular") & F.col("error").isNull())
            .groupBy("reader", "sep", "encoding", "header", F.coalesce("multi_line", F.lit(False)).alias("multi_line"))
            .agg(F.sort_array(F.collect_list("path")).alias("paths"), F.bool_and("plain").alias("plain"))
            .orderBy(F.col("paths")[0]).collect())
    return [Layout(r.reader, r.sep, r.encoding, tuple(r.header or ()), tuple(r.paths), r.multi_line, r.plain) for r in rows]


def _read(spark: SparkSession, layout: Layout, with_start: bool = False) -> DataFrame:
    paths = list(layout.paths)
    if layout.reader == "parquet":
        return tables.read_parquet_table(spark, paths, True, with_start)
    if layout.reader in ("json", "json_lines"):
        return tables.read_json_table(spark, paths, layout.reader == "json_lines", True, with_start)
    return tables.read_delimited(spark, paths, list(layout.header), layout.sep, layout.encoding, layout.multi_line,
                                 with_source=True, with_start=with_start, plain=layout.plain)


def with_row_id(df: DataFrame, file: str = "source_file", start: str = tables.START) -> DataFrame:
    """A written copy with a row key from 0 that follows files by name and rows by place.

    ``start`` tells where the split of a row begins. Rows of one split come in order; the splits, one
    row each, are put in order by a running sum. The two columns are dropped.
    """
    if ROW_ID in df.columns:
        return df.drop(file, start)
    read = materialise(df.withColumn("__read", F.monotonically_increasing_id()), "read")
    order = Window.orderBy(file, start).rowsBetween(Window.unboundedPreceding, -1)
    splits = read.groupBy(file, start).agg(F.count(F.lit(1)).alias("__n"), F.min("__read").alias("__first")).select(
        file, start, (F.coalesce(F.sum("__n").over(order), F.lit(0)) - F.col("__first")).alias("__shift"))
    keyed = read.join(splits, [file, start]).withColumn(ROW_ID, F.col("__read") + F.col("__shift"))
    return materialise(keyed.select(ROW_ID, *[quoted(c) for c in df.columns if c not in (file, start)]), "keyed")


def load_tables(spark: SparkSession, paths: list[str] | str, typed: bool = True, **options) -> list[DataFrame]:
    """Every table behind the paths, one per layout, keyed and typed, without all-empty columns."""
    result = ingest(spark, paths, **options)
    if not result.tables:
        raise ValueError("; ".join(f"{r.label}: {r.error}" for r in result.errors.orderBy("label").limit(20).collect()) or f"no table in {paths}")
    out = []
    for layout in result.layouts:
        df = with_row_id(_read(spark, layout, with_start=True))
        kept, _, _ = drop_empty_columns(df)
        out.append(tables.typed_columns(kept) if typed else kept)
    return out


def load_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """The one table behind a path (see ``load_tables``); several tables are an error, none is dropped."""
    found = load_tables(spark, path, **options)
    if len(found) > 1:
        raise ValueError(f"{path} holds {len(found)} tables: " + "; ".join(", ".join(df.columns[1:]) for df in found))
    return found[0]


def file_preview(spark: SparkSession, path: str, rows: int = 10) -> dict:
    """File facts, and columns, types, shape, first rows and NULL counts of its first table."""
    info = inventory(spark, path).first().asDict() if path_exists(spark, path) else {"path": path}
    result = ingest(spark, path, typed=True)
    if result.tables:
        info.update(preview(result.tables[0].drop("source_file"), rows, key=None))
    info.update(ingestion_status=result.status, errors=[f"{r.label}: {r.error}" for r in result.errors.collect()])
    return info
