"""Removal of lines that spread over many sites.

Every line gets a hash; one HyperLogLog sketch of its sites per line hash is built map-side and merged
by aggregation, so a line on every page of the corpus costs one small sketch per task. Lines whose
estimate lies near the limit get an exact distinct count; the others are decided by the sketch alone.
A long line is a passage and does not come about twice by chance, so it may have a lower limit than a short one.
Of each boilerplate line the first occurrence in the corpus stays, so no content is lost altogether.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import bytewords as bw
from tablewright.llm.streams import bounded_batches
from tablewright.session import materialise

MIN_SITES = 8
MIN_WORDS = 3
#: a line of more words than LONG_WORDS is a passage, shared by chance on no site; so many sites are enough
LONG_WORDS, LONG_SITES = 50, 3
SKETCH_BITS = 8
#: standard errors of the sketch within which the estimate is not trusted
BAND = 4.0


def line_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """(doc_id, row_key, site, line_no, line, words): every line with a word; spaces at its ends don't count."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(doc_id), F.col(text)).alias("row_key"),
                       F.xxhash64(F.col(site)).alias("site"), F.col(text).alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, bounds in bw.slices(batch, "text"):
                words, lines = bw.runs(data, bounds), bw.runs(data, bounds, bw.LINE_BYTES)
                low, high = np.searchsorted(words.start, lines.start), np.searchsorted(words.start, lines.end)
                worded = high > low
                breaks = np.zeros(len(data) + 1, np.int32)
                np.cumsum(data == 10, out=breaks[1:])
                owner = lines.owner()[worded]
                number = breaks[lines.start[worded]] - breaks[bounds[owner]]
                low, high = low[worded], high[worded]
                # the line without the spaces around it
                trimmed = bw.Runs(data, bounds, words.start[low], words.end[high - 1], lines.first, bw.KEEP_CASE)
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), part.column(2).take(take), pa.array(number, pa.int32()),
                     pa.array(trimmed.hashes().astype(np.int64)), pa.array((high - low).astype(np.int32))],
                    names=["doc_id", "row_key", "site", "line_no", "line", "words"])

    return rows.mapInArrow(split, "doc_id long, row_key long, site long, line_no int, line long, words int")


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, bits: int = SKETCH_BITS,
                 long_sites: int | None = None, long_words: int = LONG_WORDS) -> DataFrame:
    """(line, first): the lines on at least ``min_sites`` different sites, and where each stands first.

    With ``long_sites``, that is the limit of lines of more than ``long_words`` words, if it is lower.
    """
    margin = BAND * 1.04 / 2 ** (bits / 2)
    sketched = lines.where(F.col("words") >= min_words).groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", bits)).alias("sites"),
        F.min(F.struct("doc_id", "row_key", "line_no")).alias("first"), F.max("words").alias("words"))
    limit = F.lit(min_sites)
    if long_sites is not None:
        limit = F.when(F.col("words") > long_words, F.lit(min(long_sites, min_sites))).otherwise(limit)
    sketched = sketched.select("line", "sites", "first", limit.alias("limit"))
    far = materialise(sketched.where(F.col("sites") >= F.col("limit") * (1 - margin)), "spread")
    sure = far.where(F.col("sites") > F.col("limit") * (1 + margin)).select("line", "first")
    near = far.where(F.col("sites") <= F.col("limit") * (1 + margin))
    exact = lines.select("line", "site").join(near.select("line"), "line").distinct().groupBy("line").agg(F.count("*").alias("exact"))
    return sure.union(near.join(exact, "line").where(F.col("exact") >= F.col("limit")).select("line", "first"))


def remove_spread_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source",
                        min_sites: int = MIN_SITES, min_words: int = MIN_WORDS,
                        long_sites: int | None = None, long_words: int = LONG_WORDS) -> DataFrame:
    """``docs`` without boilerplate lines, plus ``removed_lines`` (their numbers from 0).

    A line is boilerplate when it has ``min_words`` words or more and stands on ``min_sites`` different
    sites or more, or ``long_sites`` (if given) and more than ``long_words`` words; its occurrence with the lowest doc_id and line number stays. All rows are returned,
    with their columns; a column called ``removed_lines`` is replaced. Null texts stay null; texts with
    nothing removed are returned as they are; a text whose lines all go becomes empty. A null site is a
    site of its own. Rows that repeat both doc_id and text are treated alike.
    """
    columns = [c for c in docs.columns if c != "removed_lines"]
    lines = materialise(line_table(docs, doc_id, text, site), "lines")
    spread = spread_lines(lines, min_sites, min_words, long_sites=long_sites, long_words=long_words)
    here = F.struct("doc_id", "row_key", "line_no")
    gone = lines.join(spread, "line").where(~here.eqNullSafe(F.col("first")))
    gone = gone.groupBy(F.col("row_key").alias("_row_key")).agg(F.sort_array(F.collect_set("line_no")).alias("_gone"))
    gone = materialise(gone, "gone")
    keyed = docs.select(*columns).withColumn("_row_key", F.xxhash64(F.col(doc_id), F.col(text)))
    # the list grows with the corpus: sent to all executors while it is small, it would change the plan with the size
    out = keyed.join(gone.hint("merge"), "_row_key", "left")
    cleaned = F.array_join(F.filter(F.split(F.col(text), "\n", -1), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    new_text = F.when(F.col("_gone").isNull(), F.col(text)).otherwise(cleaned)
    return out.select(*(new_text.alias(c) if c == text else F.col(c) for c in columns),
                      F.coalesce("_gone", F.array().cast("array<int>")).alias("removed_lines"))
