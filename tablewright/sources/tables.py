"""Readers: delimited text with all its irregularities, JSON and parquet."""

from __future__ import annotations

import csv
import io
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablewright.functions.lenient import na_to_null
from tablewright.functions.text import clean_cells, clean_text, drop_unprintable, is_plain
from tablewright.operators.clean import quoted
from tablewright.session import materialise
from tablewright.sources.files import HEAD_BYTES, open_path, same_path
from tablewright.sources.records import ArrayElements, QuotedLines, records

# Delimiters in the order they are tried.
DELIMITERS = [",", "\t", ";", "|"]
#: bytes that a header may have
MOST_HEADER = 16 << 20
#: characters of headers that a task holds at once
HELD_HEADERS = 1 << 20
SPARE = "__extra"
START = "__start"
# marks "no field here" apart from "empty field"; cannot occur in text read as a table
ABSENT = "\x00absent"
PARSING = {"quote": '"', "escape": '"', "nullValue": ABSENT, "emptyValue": "", "maxCharsPerColumn": "-1"}
LAYOUT = T.StructType([
    T.StructField("sep", T.StringType()),
    T.StructField("header", T.ArrayType(T.StringType())),
])


def unique_names(names: list[str]) -> list[str]:
    """Repeated names get .1, .2 and so on; empty ones are named by position."""
    seen: Counter = Counter()
    out = []
    for i, name in enumerate(names):
        name = name or f"Unnamed: {i}"
        out.append(f"{name}.{seen[name]}" if seen[name] else name)
        seen[name] += 1
    return out


def _head_rows(text: str, sep: str) -> list[list[str]]:
    rows = csv.reader(io.StringIO(text), delimiter=sep)
    out = []
    try:
        for row in rows:
            if row:
                out.append(row)
            if len(out) == 50:
                break
    except csv.Error:
        pass
    return out


def _header_ends(text: str, seps: list[str]) -> bool:
    """Does a second row begin in the text, whatever the delimiter; also true of what is no delimited text."""
    def ends(sep: str) -> bool:
        try:
            return len(list(islice(filter(None, csv.reader(io.StringIO(text), delimiter=sep)), 2))) == 2
        except csv.Error:
            return True

    return all(ends(sep) for sep in seps)


def whole_header(path: str, encoding: str, seps: list[str]) -> bytes:
    """The head of a file, read on where the header does not end in it.

    A header that does not end within MOST_HEADER bytes gives an empty head, so that the file counts as unreadable.
    """
    system, inner = open_path(path)
    with system.open_input_stream(inner, compression=None) as stream:
        data = stream.read(HEAD_BYTES)
        if len(data) < HEAD_BYTES:
            return data
        while not _header_ends(data.decode(encoding, errors="replace"), seps):
            more = stream.read(len(data))
            if not more:
                break
            data += more
            if len(data) > MOST_HEADER:
                return b""
    return data


def sniff_layout(data: bytes, encoding: str, fixed: str | None) -> tuple[str | None, list[str] | None]:
    """Delimiter and header of a file head. A fixed delimiter is taken as it is; otherwise the first
    one that gives more than one column and at least one fitting row."""
    text = data.decode(encoding, errors="replace").lstrip("\ufeff")
    for sep in [fixed] if fixed else DELIMITERS:
        rows = _head_rows(text, sep)
        fits = rows and any(len(r) <= len(rows[0]) for r in rows[1:])
        if rows and (fixed or (len(rows[0]) > 1 and fits)):
            return sep, unique_names(rows[0])
    return None, None


def with_layout(files: DataFrame, encoding: str, fixed_sep: str) -> DataFrame:
    """Add ``layout`` (delimiter and header) to rows with a ``path``; ``encoding`` and ``fixed_sep`` are columns, a null encoding is no text.

    Heads are read here, one file at a time, so that neither they nor long headers are held for many files at once.
    """
    def sniff(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            begin, held, found = 0, 0, []
            for at, (path, enc, fixed) in enumerate(zip(batch["path"], batch[encoding], batch[fixed_sep]), 1):
                sep, header = sniff_layout(whole_header(path, enc, [fixed] if fixed else DELIMITERS), enc, fixed) if enc else (None, None)
                found.append({"sep": sep, "header": header} if enc else None)
                held += sum(map(len, header or ()))
                if held > HELD_HEADERS or at == len(batch):
                    yield batch.iloc[begin:at].assign(layout=found)
                    begin, held, found = at, 0, []

    return files.mapInPandas(sniff, T.StructType([*files.schema.fields, T.StructField("layout", LAYOUT)]))


def source_path() -> Column:
    """The file a row was read from, in the spelling of the inventory."""
    return _spelled(F.col("_metadata.file_path"))


def _spelled(path: Column) -> Column:
    return same_path(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))))


def text_facts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, valid, breaks, plain) of text files, in one split pass.

    ``valid``: every line is UTF-8. ``breaks``: some line leaves a quote open, so records may run over
    line ends; such a file has to be read whole, the others can be split. ``plain``: no line has a character to clean.
    """
    # the path is spelled out once a file, not once a line
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"))
    quotes = F.contains("value", F.lit('"'))
    facts = lines.groupBy("file").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("valid"),
        F.bool_or(F.when(quotes, F.regexp_count("value", F.lit('"')) % 2 == 1).otherwise(False)).alias("breaks"),
        F.bool_and(is_plain(F.col("value"))).alias("plain"))
    return facts.groupBy(_spelled(F.col("file")).alias("path")).agg(
        F.bool_and("valid").alias("valid"), F.bool_or("breaks").alias("breaks"), F.bool_and("plain").alias("plain"))


def _delimited(reader, header: list[str], sep: str, encoding: str, multi_line: bool = False):
    """Options of batch and stream readers alike; a spare column catches surplus fields."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*header, SPARE]])
    reader = (reader.schema(schema)
              .option("header", True).option("enforceSchema", True).option("sep", sep).option("encoding", encoding)
              .options(**PARSING).option("multiLine", multi_line).option("mode", "PERMISSIVE"))
    # line ends of UTF-16 are two bytes wide and have to be named to be found
    return reader.option("lineSep", "\n") if encoding.startswith("UTF-16") and not multi_line else reader


def _fitting(raw: DataFrame, header: list[str], encoding: str) -> DataFrame:
    """Rows without surplus fields."""
    if encoding.startswith("UTF-16"):
        raw = raw.withColumns({n: F.rtrim(quoted(n), F.lit("\r")) for n in (header[-1], SPARE)})
    return raw.where(quoted(SPARE).isNull())


def stream_delimited(spark: SparkSession, folder: str, header: list[str], sep: str = ",", encoding: str = "UTF-8",
                     multi_line: bool = False, max_files: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Arriving text files, by the rules of ``read_delimited``; cells are not cleaned yet.

    A batch takes files up to ``max_files`` or ``max_bytes`` (one file at least); only one of them may be given.
    """
    if max_files and max_bytes:
        raise ValueError("give max_files or max_bytes, not both")
    reader = _delimited(spark.readStream, header, sep, encoding, multi_line)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return _fitting(reader.csv(folder), header, encoding).select(*[quoted(n) for n in header])


def read_delimited(spark: SparkSession, paths: list[str] | str, header: list[str], sep: str = ",",
                   encoding: str = "UTF-8", multi_line: bool = False, with_source: bool = False,
                   compose: bool = True, with_start: bool = False, plain: bool = False) -> DataFrame:
    """Text files with one header line, all columns STRING (see ``typed_columns``).

    Short rows are padded with NULL; rows with too many fields are left out (an empty field after the
    last separator does not count as one); missing-value literals become NULL; characters that cannot
    be shown are cleaned. ``multi_line`` is for quoted line breaks; such files are split as others are, but for
    UTF-16, whose files are read whole, one task each. ``plain`` files have no character to clean (see ``text_facts``).
    """
    if multi_line and not encoding.startswith("UTF-16"):
        raw = _from_records(spark, paths, header, sep, encoding, with_source, with_start)
    else:
        raw = _fitting(_delimited(spark.read, header, sep, encoding, multi_line).csv(paths), header, encoding)
        raw = raw.select(*[quoted(n) for n in header], *_origin(with_source, with_start))
    origin = _kept_origin(with_source, with_start)
    raw = raw.toDF(*header, *[f"__{n}" for n in origin])  # a header may have these names too
    if compose and not plain:
        raw = clean_cells(raw, header)
    cell = quoted if plain or compose else lambda n: drop_unprintable(quoted(n))
    return raw.select(*[na_to_null(cell(n)).alias(n) for n in header], *[F.col(f"__{n}").alias(n) for n in origin])


def _from_records(spark: SparkSession, paths: list[str] | str, header: list[str], sep: str, encoding: str, *origin: bool) -> DataFrame:
    """Fitting rows of files whose records may run over line ends, parsed record by record."""
    found = records(spark, paths, QuotedLines(sep), encoding)
    options = {**PARSING, "sep": sep, "multiLine": "true", "lineSep": "\n", "mode": "PERMISSIVE"}
    places = [f"c{i}" for i in range(len(header) + 1)]
    record = F.regexp_replace("record", "\r$", "")
    parsed = found.withColumn("row", F.from_csv(record, ", ".join(f"{c} string" for c in places), options))
    fields = [F.col(f"row.{c}").alias(n) for c, n in zip(places, header)]
    return parsed.where(F.col(f"row.{places[-1]}").isNull()).select(*fields, *_named_origin(*origin))


def _named_origin(with_source: bool, with_start: bool) -> list[Column]:
    """The origin of rows that were made of records."""
    return ([F.col("path").alias("source_file")] if with_source else []) + ([F.col("start").alias(START)] if with_start else [])


def _kept_origin(with_source: bool, with_start: bool) -> list[str]:
    return ["source_file"] * with_source + [START] * with_start


def _origin(with_source: bool, with_start: bool) -> list[Column]:
    """The file of a row, and where the split of that file begins that it was read from."""
    source = [source_path().alias("source_file")] if with_source else []
    return source + ([F.col("_metadata.file_block_start").alias(START)] if with_start else [])


KINDS = {1: "bigint", 2: "double", 4: "boolean"}


def _kinds_of(c: Column) -> Column:
    """Bits of the KINDS that a text fits; whole numbers are numbers as well."""
    # common numbers are known by their look, words by their beginning; a cast that fails is dear, so dates and times are not tried
    common = c.rlike(r"\A[0-9]{1,18}(?:[.][0-9]{1,18})?\z")
    word = (c >= ":") & ~F.lower(F.substring(c, 1, 3)).isin("inf", "nan")
    dated = (c >= "0") & ((F.locate("-", c, 2) > 0) | F.contains(c, F.lit(":")) | F.contains(c, F.lit("/"))) & ~c.rlike("[eEpP]")
    return (F.when(common, F.when(F.contains(c, F.lit(".")), 2).otherwise(3))
            .when(c.isNull(), None)
            .when(word, F.when(F.lower(c).isin("true", "false"), 4).otherwise(0))
            .when((c < ":") & dated, 0)
            .when(c.rlike(r"^[+-]?\d+$") & c.try_cast("bigint").isNotNull(), 3)
            .when(c.try_cast("double").isNotNull() & ~c.rlike("[dDfF]$"), 2).otherwise(0))


def typed_columns(df: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """STRING columns whose every value is a whole number, a number or a truth value get that type.

    One pass counts the fitting values of all columns. Columns without a value stay STRING.
    """
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in skip]
    if not names:
        return df
    # the kinds that every value fits are those left of the bits of all values. As a function over an array: written out for
    # every column, the generated method would be too long for the JVM to compile
    bits = F.transform(F.array(*[F.trim(quoted(n)) for n in names]), _kinds_of)
    seen = df.select(bits.alias("k")).agg(*[F.bit_and(F.get("k", F.lit(i))).alias(f"k{i}") for i in range(len(names))]).first()
    kinds = {}
    for i, n in enumerate(names):
        fits = [kind for bit, kind in KINDS.items() if (seen[f"k{i}"] or 0) & bit]
        if fits:
            kinds[n] = fits[0]
    return df.select(*[F.trim(quoted(c)).cast(kinds[c]).alias(c) if c in kinds else quoted(c) for c in df.columns])


def _json_schema(found: DataFrame) -> T.StructType:
    """The schema of JSON records as Spark infers it, without sending them through Python."""
    spark = found.sparkSession
    texts = getattr(found.select("record")._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(spark._jsparkSession.read().json(texts), spark).schema


def read_json_table(spark: SparkSession, paths: list[str] | str, lines: bool | None = None,
                    with_source: bool = False, with_start: bool = False) -> DataFrame:
    """Records from JSON lines, from files that each hold one array of objects (``lines`` is False), or, where that is not said,
    from files of one value (read whole, one task each)."""
    if lines is False:
        found = records(spark, paths, ArrayElements())
        schema = _json_schema(found)
        origin = _named_origin(with_source, with_start)
        # made into rows, so that a record is parsed once and not for each column
        row = F.from_json("record", schema)
        raw = found.select(F.inline(F.array(row)), *origin) if schema.fields else found.select(*origin)
        texts = [f.name for f in schema if isinstance(f.dataType, T.StringType)]
        raw = clean_cells(raw, texts) if texts else raw
        columns = [quoted(f.name) for f in schema]
        return raw.select(*columns, *_kept_origin(with_source, with_start))
    raw = spark.read.option("multiLine", not lines).json(paths)
    columns = [clean_text(quoted(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else quoted(f.name)
               for f in raw.schema]
    return raw.select(*columns, *_origin(with_source, with_start))


def read_parquet_table(spark: SparkSession, paths: list[str] | str, with_source: bool = False, with_start: bool = False) -> DataFrame:
    raw = spark.read.parquet(*(paths if isinstance(paths, list) else [paths]))
    return raw.select(*[quoted(c) for c in raw.columns], *_origin(with_source, with_start))
