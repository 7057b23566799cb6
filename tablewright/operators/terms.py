"""TF-IDF with a vocabulary of any size, kept as a table.

Terms are numbered in alphabetical order by a range sort. Texts are dealt into chunks of some MB by their keys. The
distinct terms of each chunk go to the parts of the vocabulary, as one list for each part, and their positions come back
to the chunk, where each text becomes a sparse list of (position, weight). So what is shuffled is one term per chunk, not
one per text, a term that stands in every text is no hot key, and the length of a text is found where its terms are.
Parts are ranges of positions and lists are in alphabetical order, so a list and its answer, steps from one position to the
next, are compressed to a few bytes a term.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tablewright.operators.clean import quoted
from tablewright.operators.tfidf import HEAVY, chunk_count, flat, held_terms, joined, lowered, packed, packed_by, part_count, text_statistics, unpacked
from tablewright.session import materialise, scratch_path
from tablewright.sources.paths import delete_path

#: rows that leave a task at once
OUT_ROWS = 65_536


@dataclass(frozen=True)
class TermTable:
    """(position, term, total, documents, idf) of every term, written, and the number of texts it was made from."""

    terms: DataFrame
    texts: int
    low: int = 1
    high: int = 2

    def weights(self, df: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
        """(keys, term, position, weight): one row per text and term it holds, L2-normalised by text. The keys identify a text."""
        low, high = self.low, self.high
        texts, parts = chunked(df, text_col, keys)
        known = _answers(texts, self.terms, parts, low, high)
        names = [f"__key{i}" for i in range(len(keys))]
        out = T.StructType([*(T.StructField(c, texts.schema[c].dataType) for c in names), T.StructField("term", T.StringType()),
                            T.StructField("position", T.LongType()), T.StructField("weight", T.DoubleType())])

        def weigh(docs: pa.Table, listed: pa.Table) -> pa.Table:
            docs = docs.sort_by(IN_ORDER)
            row, term, n, held, _ = held_terms(flat(docs, "__text"), low, high)
            order = pc.sort_indices(held).to_numpy()
            position, idf = np.full(len(held), -1), np.zeros(len(held))
            for answer in listed.select(ANSWER).to_pylist():
                at, places, values = _answered(answer)
                position[order[at]], idf[order[at]] = places, values
            kept = position[term] >= 0
            row, term, n = row[kept], term[kept], n[kept]
            x = n * idf[term]
            text = flat(docs, "__same").to_numpy()[row]
            weight = x / np.sqrt(np.bincount(text, x * x))[text]
            columns = [flat(docs, c) for c in names]
            pieces = [slice(i, i + OUT_ROWS) for i in range(0, len(row), OUT_ROWS)] or [slice(0, 0)]
            return pa.Table.from_batches([pa.RecordBatch.from_arrays(
                [*(c.take(pa.array(row[p])) for c in columns), held.take(pa.array(term[p])), pa.array(position[term[p]]), pa.array(weight[p])],
                out.fieldNames()) for p in pieces])

        made = texts.groupBy("__chunk").cogroup(known.groupBy("__chunk")).applyInArrow(weigh, out)
        return made.select(*[F.col(c).alias(k) for c, k in zip(names, keys)], "term", "position", "weight")

    def vectors(self, df: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
        """(keys, positions, weights): the sparse vector of each text that holds a known term, in the order of positions."""
        entries = F.sort_array(F.collect_list(F.struct("position", "weight")))
        listed = self.weights(df, text_col, keys).groupBy(*keys).agg(entries.alias("e"))
        return listed.select(*keys, F.col("e.position").alias("positions"), F.col("e.weight").alias("weights"))


#: texts of a chunk in one order, so that their terms are numbered alike each time
IN_ORDER = [("__same", "ascending"), ("__text", "ascending")]


def chunked(df: DataFrame, text_col: str, keys: list[str]) -> tuple[DataFrame, int]:
    """(keys as __key0 and so on, __text in lower case, __chunk, __same) of texts whose keys are not null, and a number of parts.

    Chunks hold about CHUNK_BYTES of text. Rows of one key are in one chunk and have the same number ``__same`` there.
    """
    size = df.agg(F.sum(F.octet_length(quoted(text_col)))).first()[0] or 0
    chunks = max(chunk_count(size), df.sparkSession.sparkContext.defaultParallelism)
    names = [f"__key{i}" for i in range(len(keys))]
    texts = df.select(*[quoted(k).alias(c) for k, c in zip(keys, names)], lowered(quoted(text_col)).alias("__text")).dropna("any", subset=names)
    dealt = texts.withColumn("__chunk", F.pmod(F.xxhash64(*names), F.lit(chunks)))
    parts = part_count(size, df.sparkSession.sparkContext.defaultParallelism, HEAVY)
    return dealt.withColumn("__same", F.dense_rank().over(Window.partitionBy("__chunk").orderBy(*names))), parts


def placed_terms(texts: DataFrame, terms: DataFrame, parts: int, low: int, high: int) -> DataFrame:
    """(__chunk, at, position, idf): lists of the chunk's terms that the vocabulary has; ``at`` is a term's place among all those of the chunk."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for answer in batch.to_pylist():
                at, position, idf = _answered(answer)
                yield pa.RecordBatch.from_pylist([{"__chunk": answer["__chunk"], "at": at, "position": position, "idf": idf}])

    return _answers(texts, terms, parts, low, high).mapInArrow(read, "__chunk bigint, at array<bigint>, position array<bigint>, idf array<double>")


#: the place of a list's first term among those of its chunk, the position that steps are counted from, and what became of the terms
ANSWER = ["first", "before", "answer"]


def _answered(answer: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the chunk, position, idf) of the terms of a list that the vocabulary has."""
    (step,), (which,), (low,), (high,) = unpacked([answer["answer"]], 4)[1][1:]
    known = np.flatnonzero(step)
    idf = np.column_stack([low, high]).view(np.float64).ravel()
    return answer["first"] + known, answer["before"] + np.cumsum(step[known], dtype=np.int64), idf[which]


def _halves(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Doubles as two whole numbers each, so that equal ones compress and none is changed."""
    parts = np.ascontiguousarray(values, np.float64).view(np.uint32).reshape(-1, 2)
    return parts[:, 0], parts[:, 1]


def _answers(texts: DataFrame, terms: DataFrame, parts: int, low: int, high: int) -> DataFrame:
    """(__chunk, first, before, answer): what the vocabulary has of the terms that a chunk asked a part for."""
    step = max(1, -(-((terms.agg(F.max("position")).first()[0] or 0) + 1) // parts))
    # one term for each part
    begins = [r.term for r in terms.where(F.col("position") % step == 0).select("position", "term").orderBy("position").collect()]

    def deal(docs: pa.Table) -> pa.Table:
        held = held_terms(flat(docs.sort_by(IN_ORDER), "__text"), low, high)[3]
        held = held.take(pc.sort_indices(held))
        # what comes before the first term of all is in no part
        borders = [bisect_left(range(len(held)), b, key=lambda i: held[i].as_py()) for b in begins] + [len(held)]
        asked = [(p, i, j) for p, (i, j) in enumerate(zip(borders, borders[1:])) if i < j]
        return pa.table({"__part": pa.array([p for p, _, _ in asked], pa.int64()), "__chunk": pa.repeat(docs["__chunk"][0], len(asked)),
                         "first": pa.array([i for _, i, _ in asked], pa.int64()), "list": pa.array([packed(held[i:j]) for _, i, j in asked], pa.binary())})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, place = np.divmod(batch.column("position").to_numpy(), step)
            part, lists = packed_by(part, batch.column("term").cast(pa.string()), place, *_halves(batch.column("idf").to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(lists, pa.binary())], ["__part", "list"])

    def place(lists: pa.Table, vocabulary: pa.Table) -> pa.Table:
        known, held = unpacked(vocabulary["list"].to_pylist(), 3)
        places = 1 + joined(held[1]).astype(np.int64)
        # terms of as many texts share an idf
        values, of = np.unique(np.column_stack([joined(held[2]), joined(held[3])]).view(np.float64).ravel(), return_inverse=True)
        before = (vocabulary["__part"][0].as_py() * step if len(vocabulary) else 0) - 1
        asked, (sizes,) = unpacked(lists["list"].to_pylist(), 0)
        found = pc.fill_null(pc.index_in(asked, known), -1).to_numpy()
        answers, at = [], 0
        for n in map(len, sizes):
            row = found[at:at + n]
            at += n
            rows = row[row >= 0]
            steps = np.zeros(n, np.int64)
            steps[row >= 0] = np.diff(places[rows], prepend=0)
            here, which = np.unique(of[rows], return_inverse=True)
            answers.append(packed(pa.array([], pa.string()), steps, which, *_halves(values[here])))
        return pa.table({"__chunk": lists["__chunk"], "first": lists["first"], "before": pa.repeat(pa.scalar(before, pa.int64()), len(lists)),
                         "answer": pa.array(answers, pa.binary())})

    dealt = texts.groupBy("__chunk").applyInArrow(deal, "__part bigint, __chunk bigint, first bigint, list binary")
    vocabulary = terms.select("term", "position", "idf").mapInArrow(pack, "__part bigint, list binary")
    return dealt.groupBy("__part").cogroup(vocabulary.groupBy("__part")).applyInArrow(place, "__chunk bigint, first bigint, before bigint, answer binary")


def fit_terms(df: DataFrame, text_col: str, low: int = 1, high: int = 2, min_documents: int = 1) -> TermTable:
    """Every term that stands in at least ``min_documents`` texts; nothing of it reaches the driver but counts by partition."""
    stats, texts = text_statistics(df, text_col, low, high, min_documents)
    # written, as a range sort reads its input twice
    counts = scratch_path(df.sparkSession, "counts")
    stats.write.parquet(counts)
    ordered = df.sparkSession.read.schema(stats.schema).parquet(counts).repartitionByRange("term").sortWithinPartitions("term").withColumn("__at", F.monotonically_increasing_id())
    placed = materialise(ordered, "terms")
    delete_path(df.sparkSession, counts)
    part = F.shiftrightunsigned("__at", 33)
    before, total = [], 0
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row per partition
        before.append((r.part, total - (r.part << 33)))
        total += r["count"]
    shift = df.sparkSession.createDataFrame(before, "part bigint, shift bigint")
    idf = F.log(F.lit(1.0 + texts) / (1.0 + F.col("documents"))) + 1.0
    numbered = placed.withColumn("part", part).join(F.broadcast(shift), "part").select(
        (F.col("__at") + F.col("shift")).alias("position"), "term", "total", "documents", idf.alias("idf"))
    return TermTable(numbered, texts, low, high)
