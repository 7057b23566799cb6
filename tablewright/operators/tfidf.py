"""TF-IDF vectors of token texts, with 1- and 2-grams and a limited vocabulary.

Counting terms is one shuffle of the distinct terms of every few MB of text. Vectorising is row-local: the vocabulary (at most
``max_features`` terms) is part of the plan, so texts never leave their partition.
"""

from __future__ import annotations

import hashlib
import json
import math
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablewright.functions.vectors import fit_length
from tablewright.operators.fingerprint import fingerprint

MAX_FEATURES = 1000
TOKEN_PATTERN = "([A-Za-z0-9_]+)"
#: the bytes that TOKEN_PATTERN takes
WORD_BYTES = np.isin(np.arange(256), np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_", np.uint8))
#: bytes of text whose terms a task holds at once
CHUNK_BYTES = 4 << 20
#: chunks whose terms a part of the vocabulary takes as many of, so that the list of a chunk for a part is not too short to compress
PART_CHUNKS = 4
#: parts of the vocabulary at most; beyond HEAVY * PART_CHUNKS * CHUNK_BYTES of text the parts grow
HEAVY = 10_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(1))


def with_terms(df: DataFrame, text_col: str, out: str = "__terms", low: int = 1, high: int = 2) -> DataFrame:
    """Add the n-grams of a text, words joined by one blank."""
    df = df.withColumn("__words", words(F.coalesce(F.col(text_col), F.lit(""))))
    w = F.col("__words")
    level, grams = w, [w] if low == 1 else []
    for n in range(2, high + 1):
        # n-gram i is (n-1)-gram i followed by word i+n-1
        count = F.greatest(F.size(w) - (n - 1), F.lit(0))
        level = F.zip_with(F.slice(level, F.lit(1), count), F.slice(w, F.lit(n), count),
                           lambda head, last: F.concat(head, F.lit(" "), last))
        if n >= low:
            grams.append(level)
    return df.withColumn(out, F.concat(*grams)).drop("__words")


def term_statistics(terms: DataFrame, terms_col: str = "__terms") -> DataFrame:
    """(term, total, documents): how often a term occurs, and in how many texts.

    Sorting a text's own terms marks first occurrences, so both numbers come from one shuffle,
    merged before it; a term found everywhere is no hot key.
    """
    ordered = terms.select(F.sort_array(terms_col).alias("t"))
    t = F.col("t")
    marked = ordered.select(F.explode(F.transform(
        t, lambda x, i: F.struct(x.alias("term"), F.when(i == 0, F.lit(True))
                                 .otherwise(x != F.get(t, i - 1)).alias("first")))).alias("m"))
    return marked.groupBy(F.col("m.term").alias("term")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("m.first")).alias("documents"))


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row, word) of all words of the texts, in order, as of ``words``."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    data = np.frombuffer(b"".join(texts.drop_null().cast(pa.large_binary()).to_pylist()), np.uint8)
    inside = WORD_BYTES[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    # a text's first byte begins a word whatever the text before ends with
    borders = ends[ends < len(data)]
    first[borders] = inside[borders]
    begin = np.flatnonzero(first)
    kept = np.concatenate([np.flatnonzero(first[inside]), [np.count_nonzero(inside)]])
    word = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(kept.astype(np.int64)), pa.py_buffer(data[inside]))
    return np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(begin, ends), prepend=0)), word


def held_terms(texts: pa.Array, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(row, term, n) of every term of each lower-case text, in the order of rows; the distinct terms that ``term``
    counts off; and a number of each term that deals them into parts.

    Words and n-grams are numbered as they come, so a term becomes text once for all texts, not at every place it stands.
    """
    row, word = split_words(texts)
    coded = word.dictionary_encode()
    words, at = coded.dictionary.cast(pa.string()), coded.indices.to_numpy().astype(np.int64)
    sums = np.fromiter((zlib.crc32(w) for w in words.cast(pa.binary()).to_pylist()), np.int64, len(words))
    begin, gram, names, number, size = np.arange(len(at)), at, words, sums, max(len(words), 1)
    rows, grams, found, numbers, before = [], [], [], [], 0
    for n in range(1, high + 1):
        if n > 1:
            # n-gram i is (n-1)-gram i followed by word i+n-1
            inside = begin + n - 1 < len(at)
            inside[inside] = row[begin[inside]] == row[begin[inside] + n - 1]
            begin = begin[inside]
            coded = pa.array(gram[inside] * size + at[begin + n - 1]).dictionary_encode()
            head, last = np.divmod(coded.dictionary.to_numpy(), size)
            names = pc.binary_join_element_wise(names.take(pa.array(head)), words.take(pa.array(last)), " ")
            number = number[head] + (2 * n - 1) * sums[last]
            gram = coded.indices.to_numpy().astype(np.int64)
        if n >= low:
            rows.append(row[begin])
            grams.append(gram + before)
            found.append(names)
            numbers.append(number)
            before += len(names)
    places = np.sort(np.concatenate(rows) * max(before, 1) + np.concatenate(grams))
    first = np.flatnonzero(np.diff(places, prepend=-1))
    held = places[first]
    return (held // max(before, 1), held % max(before, 1), np.diff(first, append=len(places)), pa.concat_arrays(found),
            np.concatenate(numbers))


def packed(texts: pa.Array, *numbers: np.ndarray) -> bytes:
    """Texts, and whole numbers below 2**32, as few bytes. Lengths and numbers are laid out byte by byte, as most are small."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    columns = [np.diff(ends), *numbers]
    planes = [np.ascontiguousarray(c, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for c in columns]
    data = memoryview(texts.buffers()[2] or b"")[ends[0]:ends[-1]]
    raw = b"".join([np.array([len(c) for c in columns], "<u4").tobytes(), *planes, data])
    return len(raw).to_bytes(4, "little") + pa.Codec("zstd", 3).compress(raw, asbytes=True)


def unpacked(blobs: list[bytes], numbers: int) -> tuple[pa.Array, list[list[np.ndarray]]]:
    """The texts of all blobs one after the other; and for each column, lengths of texts first, the numbers of each blob."""
    columns, data = [[] for _ in range(1 + numbers)], []
    for blob in blobs:
        raw = pa.Codec("zstd").decompress(memoryview(blob)[4:], int.from_bytes(blob[:4], "little"), asbytes=True)
        at = 4 * (1 + numbers)
        for held, n in zip(columns, np.frombuffer(raw, "<u4", 1 + numbers).tolist()):
            held.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4").ravel())
            at += 4 * n
        data.append(memoryview(raw)[at:])
    ends = np.append(0, np.cumsum(joined(columns[0]), dtype=np.int64))
    texts = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(b"".join(data)))
    return texts.cast(pa.string()), columns


def joined(numbers: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint32), *numbers])


def packed_by(part: np.ndarray, texts: pa.Array, *numbers: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The distinct parts, and texts and numbers of each as ``packed``."""
    order = np.argsort(part, kind="stable")
    texts, numbers = texts.take(pa.array(order)), [n[order] for n in numbers]
    first = np.flatnonzero(np.diff(part[order], prepend=-1))
    places = [slice(i, j) for i, j in zip(first.tolist(), [*first[1:].tolist(), len(order)])]
    return part[order][first], [packed(texts[p], *(n[p] for n in numbers)) for p in places]


def flat(table: pa.Table, name: str) -> pa.Array:
    """A column as one array."""
    chunks = table[name].chunks
    return pa.concat_arrays(chunks) if chunks else pa.array([], table.schema.field(name).type)


def chunk_count(size: int) -> int:
    return max(-(-size // CHUNK_BYTES), 1)


def part_count(size: int, cores: int, most: int) -> int:
    return min(max(-(-chunk_count(size) // PART_CHUNKS), cores), most)


def in_chunks(batch: pa.RecordBatch, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """The rows of a batch with at most CHUNK_BYTES of text at a time, or one row."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(ends):
        limit = (ends[at - 1] if at else 0) + CHUNK_BYTES
        end = max(int(np.searchsorted(ends, limit, side="right")), at + 1)
        yield batch.slice(at, end - at)
        at = end


def text_statistics(df: DataFrame, text_col: str, low: int = 1, high: int = 2, min_documents: int = 1) -> tuple[DataFrame, int]:
    """(term, total, documents) as of ``term_statistics``, and the number of texts.

    What is shuffled are the distinct terms of CHUNK_BYTES of text, as one packed list for each part of the vocabulary.
    """
    seen = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text_col)).alias("size")).first()
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = part_count(seen["size"] or 0, cores, HEAVY)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in in_chunks(batch, batch.column(0)):
                _, term, n, names, number = held_terms(chunk.column(0), low, high)
                total = np.bincount(term, n, len(names)).astype(np.int64)
                documents = np.bincount(term, minlength=len(names)).astype(np.int64)
                part, lists = packed_by(number % parts, names, total, documents)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(lists, pa.binary())], ["part", "list"])

    def merge(lists: pa.Table) -> pa.Table:
        terms, counts = unpacked(lists["list"].to_pylist(), 2)
        coded = terms.dictionary_encode()
        at = coded.indices.to_numpy()
        total, documents = (np.bincount(at, joined(c), len(coded.dictionary)).astype(np.int64) for c in counts[1:])
        return pa.table({"term": coded.dictionary, "total": total, "documents": documents}).filter(pa.array(documents >= min_documents))

    counted = df.select(lowered(F.col(text_col)).alias("text")).mapInArrow(
        count, "part bigint, list binary")
    return counted.groupBy("part").applyInArrow(merge, "term string, total bigint, documents bigint"), seen["n"]


@dataclass(frozen=True)
class TfidfModel:
    """A fitted vocabulary in alphabetical order with its weights."""

    terms: list[str]
    totals: list[int]
    documents: list[int]
    texts: int
    low: int = 1
    high: int = 2

    @property
    def vocab_id(self) -> str:
        """Marks vectors of this vocabulary, so that they are never compared with others."""
        return hashlib.md5(self.to_json().encode()).hexdigest()[:16]

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> TfidfModel:
        return cls(**json.loads(text))

    def idf(self) -> list[float]:
        return [math.log((1 + self.texts) / (1 + d)) + 1 for d in self.documents]

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        """(position, term, total, documents, idf)."""
        rows = list(zip(range(len(self.terms)), self.terms, self.totals, self.documents, self.idf()))
        return spark.createDataFrame(
            rows, "position int, term string, total bigint, documents bigint, idf double")

    def transform(self, df: DataFrame, text_col: str, out: str = "vector") -> DataFrame:
        """Add the L2-normalised TF-IDF vector of each text (sparse ML vector)."""
        df = with_terms(df, text_col, "__terms", self.low, self.high)
        counter = CountVectorizerModel.from_vocabulary(
            self.terms, inputCol="__terms", outputCol="__counts")
        weigh = ElementwiseProduct(scalingVec=Vectors.dense(self.idf()), inputCol="__counts",
                                   outputCol="__weighted")
        unit = Normalizer(p=2.0, inputCol="__weighted", outputCol=out)
        made = unit.transform(weigh.transform(counter.transform(df)))
        return made.drop("__terms", "__counts", "__weighted")

    def transform_dense(self, df: DataFrame, text_col: str, out: str = "vector") -> DataFrame:
        """As ``transform``, as ARRAY<DOUBLE>."""
        made = self.transform(df, text_col, "__vector")
        return made.withColumn(out, vector_to_array("__vector")).drop("__vector")

    def weights(self, df: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
        """(keys, term, weight) of the non-zero entries."""
        dense = self.transform_dense(df.select(*keys, text_col), text_col, "v")
        entries = F.filter(F.transform("v", lambda x, i: F.struct(i.alias("position"), x.alias("weight"))),
                           lambda e: e["weight"] != 0)
        vocabulary = self.vocabulary(df.sparkSession).select("position", "term")
        return (dense.select(*keys, F.inline(entries))
                .join(F.broadcast(vocabulary), "position").select(*keys, "term", "weight"))


def fit(df: DataFrame, text_col: str, max_features: int = MAX_FEATURES, low: int = 1, high: int = 2) -> TfidfModel:
    """Most frequent terms over all texts (ties by term), at most ``max_features`` reach the driver."""
    stats, texts = text_statistics(df, text_col, low, high)
    chosen = stats.orderBy(F.col("total").desc(), "term").limit(max_features).collect()
    chosen.sort(key=lambda r: r.term)
    return TfidfModel([r.term for r in chosen], [r.total for r in chosen], [r.documents for r in chosen],
                      texts, low, high)


def fit_transform(df: DataFrame, text_col: str, out: str = "vector", **options) -> tuple[TfidfModel, DataFrame]:
    model = fit(df, text_col, **options)
    return model, model.transform_dense(df, text_col, out)


def vectorise_table(df: DataFrame, model: TfidfModel, by: list[str] | None = None, key: str = "row_id") -> DataFrame:
    """Fingerprint and vector of a table (or of each of its variants) in one call.

    (by, tokens, token_string, vector, vocab_id).
    """
    prints = fingerprint(df, by, key)
    return model.transform_dense(prints, "token_string").withColumn("vocab_id", F.lit(model.vocab_id))


def revectorise(library: DataFrame, model: TfidfModel, size: int) -> DataFrame:
    """A fix library with all vectors made anew from the stored tokens, after a refit."""
    fresh = model.transform_dense(library.drop("vector"), "fingerprint_tokens")
    return fresh.withColumn("vector", fit_length(F.col("vector"), size)).withColumn(
        "vocab_id", F.lit(model.vocab_id)).select(*library.columns)
