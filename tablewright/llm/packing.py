"""Packing of documents into sequences along a space-filling curve.

A document's tokens are hashed into a vector, the vector is projected to a few dimensions, and the cell
of the projection has a place on a Hilbert curve. Documents are range-sorted by that place (ties by id,
so a group of equal documents is dealt over many partitions) and written one after another into
sequences, cut wherever a sequence is full. So neighbours on the curve share sequences, and only the
tail of each partition is left over; it is cut into sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import bytewords as bw
from tablewright.llm.streams import bounded_batches
from tablewright.session import scratch_path

BUCKETS = 256
DIMENSIONS = 4
BITS = 8
#: bytes of words and their ids that a Python worker keeps, with what Python needs for an entry
CACHE_BYTES = 200 << 20
ENTRY_BYTES = 200
#: words looked up between two looks at the bound, and the length in bytes beyond which none is kept
CACHE_STEP = 10_000
LONG_WORD = 64
#: sequence ids of a partition start at its number times this
PER_PARTITION = 1 << 40


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of cells (rows of small whole numbers) on the Hilbert curve, after Skilling (2004)."""
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(len(x)):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn, q = np.zeros_like(x[0]), top
    while q > 1:
        turn = np.where((x[-1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for v in x:
            key = key << 1 | ((v ^ turn) >> b & 1)
    return key


def curve_keys(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hilbert places of documents given their token ids, one after another, and their token counts."""
    bucket = (ids.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    owner = np.repeat(np.arange(len(counts)), counts)
    vectors = np.bincount(owner * BUCKETS + bucket, minlength=len(counts) * BUCKETS).reshape(len(counts), BUCKETS)
    vectors = np.log1p(vectors)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    # the part all documents share says nothing about neighbours
    projection = np.random.default_rng(11).standard_normal((BUCKETS, DIMENSIONS))
    projection -= projection.mean(axis=0)
    spread = 2.5
    cells = ((vectors @ projection + spread) / (2 * spread) * (1 << BITS)).clip(0, (1 << BITS) - 1)
    return hilbert_keys(cells.astype(np.int64))


class WordIds(dict):
    """Token ids by word (its UTF-8 bytes) as packed bytes. The tokenizer drops white space, so words are independent.

    A new word of Latin-1 characters is split by the tokenizer's pattern here, and only its new parts go
    to the tokenizer's model, as a whole call costs several times as much; every other word is encoded whole.
    Words, and parts as the words they would be, are kept up to ``cache_bytes``: once half of it is full, what is kept becomes the older half
    and the one before is dropped, so frequent words stay. A long word is never kept.
    """

    #: the tokenizer's pattern for lower-case Latin-1 without spaces: contractions, letters, a digit, the rest
    LETTERS, DIGITS = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe"
    PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\x85\xa0{LETTERS}{DIGITS}]+")
    LATIN = re.compile(r"[\x00-\xff]*")

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, specials)) or r"(?!)").search
        self.older: dict[bytes, bytes] = {}
        self.cache_bytes, self.held = cache_bytes, 0
        shown = ByteLevel(add_prefix_space=False, use_regex=False)
        # how the model writes the bytes of the Latin-1 characters
        self.written = {c: "".join(x for x, _ in shown.pre_tokenize_str(chr(c))) for c in range(256)}

    def __missing__(self, raw: bytes) -> bytes:
        ids = self.older.get(raw)
        if ids is None:
            ids = self._encoded(raw)
        if len(raw) <= LONG_WORD:
            self[raw] = ids
            self.held += len(raw) + len(ids) + ENTRY_BYTES
        return ids

    def _encoded(self, raw: bytes) -> bytes:
        if raw.isalpha():  # ASCII letters are one part
            low = raw.lower()
            return self._tokenised(raw.decode()) if low == raw else self[low]
        word = raw.decode()
        if not self.LATIN.fullmatch(word) or self.special(word):
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.dtype).tobytes()
        parts = self.PARTS.findall(word.lower())
        if len(parts) == 1 and parts[0] == word:
            return self._tokenised(word)
        # a part is looked up like the word that it would be
        return b"".join([self[p.encode()] for p in parts])

    def _tokenised(self, part: str) -> bytes:
        return np.array([t.id for t in self.model.tokenize(part.translate(self.written))], self.dtype).tobytes()

    def of(self, data: np.ndarray, bounds: np.ndarray, end: int) -> list[bytes]:
        """Ids of the texts of a slice. ``bytes.split`` cuts at the six ASCII spaces and nothing else."""
        last = np.array([end], self.dtype).tobytes()
        raw, at, out = data.tobytes(), bounds.tolist(), []
        for a, z in zip(at[:-1], at[1:]):
            # in steps, so that a text of many new words cannot outgrow the cache's bound
            words = raw[a:z].split()
            ids = []
            for k in range(0, len(words), CACHE_STEP):
                if self.held > self.cache_bytes // 2:
                    self.older, self.held = dict(self), 0
                    self.clear()
                ids.append(b"".join(map(self.__getitem__, words[k:k + CACHE_STEP])))
            out.append(b"".join(ids) + last)
        return out


@cache
def word_ids(path: str, cache_bytes: int = CACHE_BYTES) -> WordIds:
    """The tokenizer of a Python worker, kept with its words from task to task."""
    return WordIds(path, cache_bytes)


def tokenised(docs: DataFrame, tokenizer: str, end: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, curve, ids): ids as packed bytes, two or four each, closed by ``end``."""
    bounded_batches(docs.sparkSession)
    id_type = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(tokenizer)
        for batch in batches:
            for part, data, bounds in bw.slices(batch, "text"):
                ids = known.of(data, bounds, end)
                counts = np.array([len(x) // known.dtype.itemsize for x in ids])
                curve = curve_keys(np.frombuffer(b"".join(ids), known.dtype), counts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(curve), pa.array(ids, pa.binary()),
                                                  pa.array(np.full(len(ids), known.dtype.itemsize, np.int32))],
                                                 names=["doc_id", "curve", "ids", "width"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type}, curve long, ids binary, width int")


def powers_of_two(n: int) -> list[int]:
    """The powers of two that add up to ``n``, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def fill(documents: Iterator[tuple[object, np.ndarray]], length: int) -> Iterator[list[tuple]]:
    """Sequences as lists of pieces (doc, start, ids, doc_tokens), in the order of the documents."""
    held, room = [], length
    for doc, ids in documents:
        at = 0
        while at < len(ids):
            take = min(room, len(ids) - at)
            held.append((doc, at, ids[at:at + take], len(ids)))
            at, room = at + take, room - take
            if not room:
                yield held
                held, room = [], length
    for size in powers_of_two(length - room):
        piece_list = []
        while size:
            doc, at, ids, total = held.pop(0)
            if len(ids) > size:
                held.insert(0, (doc, at + size, ids[size:], total))
                ids = ids[:size]
            piece_list.append((doc, at, ids, total))
            size -= len(ids)
        yield piece_list


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: (doc_id, start, length, ids, doc_tokens, sequence_id, offset, curve).

    ``ids`` are the piece's token ids as little-endian unsigned 32-bit numbers; ``start`` is its place in
    its document, ``offset`` that in its sequence. Sequences hold ``length`` tokens, or a power of two at
    the end of a partition, so nothing is padded when ``length`` is one itself. A null or empty text is
    the end token alone. Every row is packed, repeated rows and ids too; other columns are ignored.
    """
    spark = docs.sparkSession
    id_type = dict(docs.dtypes)[doc_id]
    path = scratch_path(spark, "tokens")
    # written once: the range sort looks at its input twice, and a lost executor re-reads instead of encoding again
    tokenised(docs, tokenizer, end, doc_id, text).write.option("compression", "zstd").parquet(path)
    ordered = spark.read.parquet(path).repartitionByRange("curve", "doc_id", F.xxhash64("ids")).sortWithinPartitions("curve", "doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() * PER_PARTITION

        def documents():
            for batch in batches:
                for doc, curve, ids, width in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    yield (doc, curve), np.frombuffer(ids, f"<u{width}").astype("<u4")

        out: list[tuple] = []
        size = 0
        for number, pieces in enumerate(fill(documents(), length)):
            offset = 0
            for (doc, curve), at, ids, total in pieces:
                out.append((doc, at, len(ids), ids.tobytes(), total, base + number, offset, curve))
                offset += len(ids)
            size += offset
            if size > 1 << 20:
                yield rows(out)
                out, size = [], 0
        if out:
            yield rows(out)

    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "curve"]

    def rows(out: list[tuple]) -> pa.RecordBatch:
        types = [None, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return ordered.mapInArrow(run, f"doc_id {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, curve long")
