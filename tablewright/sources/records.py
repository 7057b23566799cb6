"""Records that run over line ends, read by many tasks: quoted fields of delimited text, and elements of a JSON array.

Spark's text reader deals a file out in splits of whole lines, so a split may begin inside a record. One scan
finds, for each split, what it makes of either state it may begin in; a running sum over the splits of a file
gives the state each really begins in. A second scan then gives the records that lie in one split, and
a third one the pieces at the borders of splits, which are few and are put together by file.

Only the keys of splits that begin inside a record reach the driver: one small row for 128 MB of text at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, pairwise
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablewright.session import gathered, materialise

#: text of a JSON array that a task looks at at once
HELD_BYTES = 4 << 20
PIECES = "path string, start long, piece int, opens boolean, header boolean, text string"


@dataclass(frozen=True)
class QuotedLines:
    """Delimited text: a field may be quoted from its first character on, and then runs to the next single quote."""

    sep: str
    line_sep: str = "\n"

    def after(self, line: str, inside: bool) -> tuple[bool, int]:
        """Is a quoted field open at the end of the line? Depth plays no part."""
        at = 0
        if not inside:
            if line[:1] != '"':
                at = line.find(self.sep + '"')
                if at < 0:
                    return False, 0
                at += len(self.sep)
            at += 1
        while True:
            quote = line.find('"', at)
            if quote < 0:
                return True, 0
            if line[quote + 1:quote + 2] == '"':
                at = quote + 2
                continue
            # a quote that nothing follows but text closes the field as well; the text is part of it
            at = line.find(self.sep + '"', quote + 1)
            if at < 0:
                return False, 0
            at += len(self.sep) + 1

    def plain(self, lines: pd.Series) -> pd.Series:
        """Lines that leave every state as it is."""
        return ~lines.str.contains('"', regex=False)

    def cut(self, lines: Iterator[str], inside: bool, depth: int) -> Iterator[tuple[str, bool, bool]]:
        """(text, begun here, complete) of the records of a split, in order."""
        held: list[str] = []
        begun = not inside
        for line in lines:
            held.append(line)
            if inside or '"' in line:
                inside, _ = self.after(line, inside)
            if not inside:
                yield "\n".join(held), begun, True
                held, begun = [], True
        if held:
            yield "\n".join(held), begun, False


@dataclass(frozen=True)
class ArrayElements:
    """The elements of the one array of a JSON file. Chunks end with a brace, so it may be written on one line.

    The state is whether a string is open; the depth counts brackets and braces outside of strings. A split is looked at as
    arrays of all quotes and brackets of some MB of it.
    """

    line_sep: str = "}"

    def ends(self, chunks: pa.Array) -> ChunkEnds:
        return ChunkEnds.of(chunks)


#: what a byte is to an array: a quote, a bracket that opens or closes
QUOTE, OPENS, CLOSES, ESCAPED, CHUNK_END = range(1, 6)
BYTE_KINDS = np.zeros(256, np.uint8)
BYTE_KINDS[list(b'"{[}]')] = [QUOTE, OPENS, OPENS, CLOSES, CLOSES]


@dataclass(frozen=True)
class ChunkEnds:
    """The quotes and brackets of chunks and their ends, one after the other, and which of these are ends."""

    kind: np.ndarray
    end: np.ndarray

    @classmethod
    def of(cls, chunks: pa.Array) -> ChunkEnds:
        chunks = chunks.cast(pa.large_binary())
        borders = np.frombuffer(chunks.buffers()[1], np.int64)[chunks.offset:chunks.offset + len(chunks) + 1]
        data = np.frombuffer(chunks.buffers()[2] or b"", np.uint8)[borders[0]:borders[-1]]
        borders = borders - borders[0]
        kinds = BYTE_KINDS[data]
        at = np.flatnonzero(kinds)
        kind = kinds[at]
        quotes = np.flatnonzero(kind == QUOTE)
        slashes = np.flatnonzero(data == ord("\\"))
        if len(slashes) and len(quotes):
            # a run of backslashes begins with its chunk at the earliest
            first = (np.diff(slashes, prepend=-2) != 1) | (borders[np.searchsorted(borders, slashes)] == slashes)
            run = slashes[np.maximum.accumulate(np.where(first, np.arange(len(slashes)), 0))]
            q = at[quotes]
            before = np.minimum(np.searchsorted(slashes, q - 1), len(slashes) - 1)
            follows = (slashes[before] == q - 1) & (q > borders[np.searchsorted(borders, q, side="right") - 1])
            kind[quotes[follows & ((q - run[before]) % 2 == 1)]] = ESCAPED
        place = np.searchsorted(at, borders[1:])
        return cls(np.insert(kind, place, CHUNK_END), place + np.arange(len(place)))

    def after(self, inside: bool) -> tuple[np.ndarray, np.ndarray]:
        """Is a string open at the end of each chunk, and the depth there, if one is or is not at the beginning, at depth 0.

        A quote opens a string or closes it; an escaped one closes none, so after it one is open. The brace at the end of a
        chunk counts outside of strings as others do.
        """
        turns = np.cumsum(self.kind == QUOTE)
        known = np.maximum.accumulate(np.where(self.kind == ESCAPED, np.arange(len(self.kind)), -1))
        inside = np.where(known >= 0, 1 + turns - turns[known], inside + turns) % 2 == 1
        change = np.array([0, 0, 1, -1, 0, -1])[self.kind]
        change[inside] = 0
        return inside[self.end], np.cumsum(change)[self.end]


def _lines(spark: SparkSession, paths: list[str] | str, line_sep: str, encoding: str) -> DataFrame:
    from tablewright.sources.tables import source_path

    raw = spark.read.option("lineSep", line_sep).text(paths)
    value = F.make_valid_utf8("value") if encoding == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    return raw.select(source_path().alias("path"), F.col("_metadata.file_block_start").alias("start"), value.alias("value"))


def _splits(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, Iterator[pd.Series]]]:
    """The splits of a task in order, each as an iterator of its lines; it has to be used up before the next."""
    state = {"key": None, "left": None}

    def parts() -> Iterator[tuple[tuple[str, int], pd.Series]]:
        for batch in batches:
            if len(batch):
                change = (batch["start"] != batch["start"].shift()) | (batch["path"] != batch["path"].shift())
                for _, part in batch.groupby(change.cumsum(), sort=False):
                    yield (part["path"].iloc[0], int(part["start"].iloc[0])), part["value"]

    source = parts()
    state["left"] = next(source, None)

    def lines(key) -> Iterator[pd.Series]:
        while state["left"] is not None and state["left"][0] == key:
            values = state["left"][1]
            state["left"] = next(source, None)
            yield values

    while state["left"] is not None:
        key = state["left"][0]
        yield *key, lines(key)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[pa.Array]]]:
    """As ``_splits``, of Arrow batches; the chunks come HELD_BYTES at a time, or one."""
    def parts() -> Iterator[tuple[tuple[str, int], pa.Array]]:
        for batch in batches:
            if not batch.num_rows:
                continue
            start, path = batch.column("start").to_numpy(), batch.column("path").dictionary_encode().indices.to_numpy()
            sums = np.cumsum(pc.binary_length(batch.column("value")).to_numpy())
            # a part begins with its split, or where another HELD_BYTES begin
            held = sums // HELD_BYTES
            change = (np.diff(start) != 0) | (np.diff(path) != 0) | (np.diff(held) != 0)
            for part in (batch.slice(i, j - i) for i, j in pairwise([0, *(1 + np.flatnonzero(change)).tolist(), batch.num_rows])):
                yield (part.column("path")[0].as_py(), part.column("start")[0].as_py()), part.column("value").cast(pa.string())

    for (path, start), group in groupby(parts(), key=itemgetter(0)):
        yield path, start, (chunks for _, chunks in group)


def _ends(lines: DataFrame, form) -> DataFrame:
    """(path, start, out, into, out_depth, into_depth): what each split makes of beginning outside of a quoted text, and inside."""
    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for path, start, parts in _splits(batches):
            out, into = False, True
            for part in parts:
                for line in part[~form.plain(part)]:
                    one = form.after(line, out)[0]
                    out, into = one, one if into == out else form.after(line, into)[0]
            yield pd.DataFrame({"path": [path], "start": [start], "out": [out], "into": [into], "out_depth": [0], "into_depth": [0]})

    def array_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, start, parts in _chunks(batches):
            state, depth = [False, True], [0, 0]
            for chunks in parts:
                found = form.ends(chunks)
                for i in (0, 1):
                    inside, change = found.after(state[i])
                    state[i], depth[i] = bool(inside[-1]), depth[i] + int(change[-1])
            yield pa.RecordBatch.from_pylist([{"path": path, "start": start, "out": state[0], "into": state[1], "out_depth": depth[0], "into_depth": depth[1]}])

    schema = "path string, start long, out boolean, into boolean, out_depth long, into_depth long"
    return lines.mapInPandas(ends, schema) if isinstance(form, QuotedLines) else lines.mapInArrow(array_ends, schema)


def _entries(lines: DataFrame, form) -> DataFrame:
    """(path, start, inside, depth): the state in which each split begins."""
    found = materialise(_ends(lines, form), "splits")
    order = Window.partitionBy("path").orderBy("start")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    # a split that ends the same either way sets the state; one that swaps the two counts
    swaps = F.sum((F.col("out") & ~F.col("into")).cast("int"))
    counted = found.withColumn("swaps", swaps.over(order.rowsBetween(Window.unboundedPreceding, 0)))
    fixed = F.last(F.when(F.col("out") == F.col("into"), F.struct("out", "swaps")), ignorenulls=True).over(earlier)
    known = counted.withColumns({"fixed": fixed, "before": F.coalesce(F.max("swaps").over(earlier), F.lit(0))})
    odd = (F.col("before") - F.coalesce("fixed.swaps", F.lit(0))) % 2 == 1
    inside = F.coalesce("fixed.out", F.lit(False)) != odd
    change = F.when(F.col("inside"), F.col("into_depth")).otherwise(F.col("out_depth"))
    return known.withColumn("inside", inside).select("path", "start", "inside", F.coalesce(F.sum(change).over(earlier), F.lit(0)).alias("depth"))


def records(spark: SparkSession, paths: list[str] | str, form: QuotedLines | ArrayElements, encoding: str = "UTF-8") -> DataFrame:
    """(path, start, record) of every record of the files; the first one of a delimited file, its header, is left out.

    Ordered by ``start`` and, within a value of it, by the order in which they are read, records of a file come as they
    stand there. A record that is open at the end of its file ends there. Elements of an array are written in between, as
    they are read more than once.
    """
    if isinstance(form, ArrayElements):
        return _elements(spark, paths, form, encoding)
    lines = _lines(spark, paths, form.line_sep, encoding)
    begin = {(r.path, r.start): r.inside for r in _entries(lines, form).where("inside").collect()}

    def run(wanted: bool):
        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for path, start, parts in _splits(batches):
                out, size, first = [], 0, start == 0
                for text, begun, complete in form.cut((x for part in parts for x in part), begin.get((path, start), False), 0):
                    whole = begun and complete
                    if whole != wanted:
                        first = False
                        continue
                    if not whole:
                        out.append((path, start, int(begun), begun, first and begun, text))
                    elif not first and text.strip():
                        out.append((path, start, 0, True, False, text))
                    first = False
                    size += len(text)
                    if size > 4 << 20:
                        yield pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])
                        out, size = [], 0
                if out:
                    yield pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])

        return lines.mapInPandas(cut, PIECES)

    whole = run(True).select("path", "start", F.col("text").alias("record"))
    return whole.unionByName(_joined(run(False), form.line_sep))


def _joined(pieces: DataFrame, between: str) -> DataFrame:
    """(path, start, record) of the records that lie in several splits, or are open at the end of their file."""
    # a piece that begins a record opens a run; those that follow in the file carry it on
    number = F.sum(F.col("opens").cast("int")).over(Window.partitionBy("path").orderBy("start", "piece"))
    runs = pieces.withColumn("run", number).groupBy("path", "run").agg(
        F.sort_array(F.collect_list(F.struct("start", "piece", "text"))).alias("at"), F.bool_or("header").alias("header"))
    joined = F.concat_ws(between, F.transform("at", lambda x: x["text"]))
    # after all records of the split it begins in, and before those of the next
    return runs.where(~F.col("header")).select("path", (F.col("at")[0]["start"] + 1).alias("start"), joined.alias("record"))


def _elements(spark: SparkSession, paths: list[str] | str, form: ArrayElements, encoding: str) -> DataFrame:
    lines = gathered(_lines(spark, paths, form.line_sep, encoding))
    begin = {(r.path, r.start): (r.inside, r.depth) for r in _entries(lines, form).where("inside or depth > 1").collect()}
    names = [*[c.split()[0] for c in PIECES.split(", ")], "whole"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, start, parts in _chunks(batches):
            # an element lies at depth 1 of its file; a split at its very beginning counts as there
            inside, depth = begin.get((path, start), (False, 0 if start == 0 else 1))
            begun, held = depth <= 1, []

            def pieces(texts: pa.Array, complete: bool) -> pa.RecordBatch:
                first = np.arange(len(texts)) == 0
                opens = ~first | begun
                whole = opens & complete
                columns = [pa.repeat(path, len(texts)), pa.repeat(pa.scalar(start, pa.int64()), len(texts)), pa.array((opens & ~whole).astype(np.int32)),
                           pa.array(opens), pa.array(np.zeros(len(texts), bool)), texts, pa.array(whole)]
                return pa.RecordBatch.from_arrays(columns, names)

            for chunks in parts:
                ends, change = form.ends(chunks).after(inside)
                last = np.flatnonzero(~ends & (depth + change <= 1))
                inside, depth = bool(ends[-1]), depth + int(change[-1])
                if len(last):
                    lists = pa.ListArray.from_arrays(pa.array(np.append(0, last + 1), pa.int32()), chunks)
                    texts = pc.binary_join_element_wise(pc.binary_join(lists, "}"), "", "}")
                    if held:
                        texts = pa.concat_arrays([pa.array(["}".join([*held, texts[0].as_py()])], pa.string()), texts[1:]])
                    yield pieces(texts, True)
                    begun, held, chunks = True, [], chunks[int(last[-1]) + 1:]
                held += chunks.to_pylist()
            if held and depth > 1:
                yield pieces(pa.array(["}".join(held) + "}"], pa.string()), False)

    # written, as all that follows reads it
    cuts = materialise(lines.mapInArrow(cut, f"{PIECES}, whole boolean"), "elements")
    whole = gathered(cuts).where("whole").select("path", "start", F.col("text").alias("record"))
    across = materialise(_joined(gathered(cuts).where("not whole").drop("whole"), ""), "borders")
    # what parts the elements stands before them; what follows the last one is none
    found = whole.unionByName(gathered(across)).withColumn("record", F.ltrim("record", F.lit("\ufeff[, \t\n\x0b\f\r")))
    return found.where(F.col("record").startswith("{"))
