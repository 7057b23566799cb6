"""Token ids of a corpus in bit-packed files, and reading them back whole or in parts.

A folder holds ``blocks``, raw files in the order of the corpus, and ``manifest``, a Parquet table with one
row per file: its place in the order, its counts, and how many ids come before it. A file is

    header      64 bytes, big-endian: mark, bits of an id, ids of a block, part, ordinal, documents,
                ids, bytes of the directory, bytes of the blocks
    directory   an Arrow stream of (doc_id, n_ids), one row per document
    offsets     where each block begins, and where the last one ends, as little-endian 64-bit numbers
    blocks      each ``block`` ids of ``width`` bits, lowest bits first, from a byte border on
    line feed   the end

``width`` is the least number of bits that holds the vocabulary, so a reader unpacks a block with a few
numpy operations, and finds any id without reading what comes before its block. A document lies in one
file; a file ends after the document that fills it.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.llm import bytewords as bw
from tablewright.llm.packing import word_ids
from tablewright.llm.streams import bounded_batches

MARK = b"IDBLOCK1"
HEADER = ">8sIIQQQQQQ"
HEADER_BYTES = struct.calcsize(HEADER)
BLOCK_IDS = 4096
#: a file ends after the document with which it reaches so many bytes of packed ids
FILE_BYTES = 16 << 20
#: words kept by a Python worker, less than in packing, as the texts are sorted beside it
CACHE_BYTES = 112 << 20


def bits_for(vocabulary: int) -> int:
    """The least number of bits that holds the ids 0 to ``vocabulary`` - 1."""
    return max(1, (vocabulary - 1).bit_length())


def _lanes(width: int) -> Iterator[tuple[int, int, int]]:
    """Eight ids fill ``width`` bytes. For each: the byte it begins in, its bit there, and the bytes it touches."""
    for k in range(8):
        at, bit = divmod(k * width, 8)
        yield at, bit, (bit + width + 7) // 8


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """Ids one after another with ``width`` bits each (1 to 32), lowest bits first; the last byte is filled with zeros."""
    if len(ids) and int(ids.max()) >> width:
        raise ValueError(f"an id has more than {width} bits")
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}", copy=False).tobytes()
    eights = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    eights.reshape(-1)[:len(ids)] = ids
    out = np.zeros((len(eights), width), np.uint8)
    for k, (at, bit, touched) in enumerate(_lanes(width)):
        value = eights[:, k] << np.uint64(bit)
        for j in range(touched):
            out[:, at + j] |= (value >> np.uint64(8 * j)).astype(np.uint8)
    return out.tobytes()[:(len(ids) * width + 7) // 8]


def unpack_bits(raw: bytes | memoryview, n: int, width: int) -> np.ndarray:
    """The first ``n`` ids that :func:`pack_bits` wrote, as 32-bit numbers."""
    if width in (8, 16, 32):
        return np.frombuffer(raw, f"<u{width // 8}", n).astype("<u4")
    rows = -(-n // 8)
    data = np.zeros(rows * width, np.uint8)
    given = np.frombuffer(raw, np.uint8, (n * width + 7) // 8)
    data[:len(given)] = given
    data = data.reshape(rows, width)
    out = np.empty((rows, 8), "<u4")
    mask = np.uint64((1 << width) - 1)
    for k, (at, bit, touched) in enumerate(_lanes(width)):
        value = np.zeros(rows, np.uint64)
        for j in range(touched):
            value |= data[:, at + j].astype(np.uint64) << np.uint64(8 * j)
        out[:, k] = value >> np.uint64(bit) & mask
    return out.reshape(-1)[:n]


def image(doc_ids: pa.Array, counts: np.ndarray, ids: np.ndarray, width: int, part: int, ordinal: int, block: int = BLOCK_IDS) -> bytes:
    """The bytes of a file, without the line feed at its end."""
    directory = io.BytesIO()
    rows = pa.RecordBatch.from_arrays([doc_ids, pa.array(counts, pa.uint64())], names=["doc_id", "n_ids"])
    with pa.ipc.new_stream(directory, rows.schema) as out:
        out.write_batch(rows)
    packed = [pack_bits(ids[at:at + block], width) for at in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, packed)]).astype("<u8")
    head = struct.pack(HEADER, MARK, width, block, part, ordinal, len(counts), len(ids), directory.tell(), int(offsets[-1]))
    return b"".join([head, directory.getvalue(), offsets.tobytes(), *packed])


class IdFile:
    """A file's bytes (or a memory map of it), read at random."""

    def __init__(self, raw):
        self.raw = memoryview(raw)
        mark, self.width, self.block, self.part, self.ordinal, self.n_docs, self.n_ids, directory, size = struct.unpack_from(HEADER, self.raw)
        if mark != MARK:
            raise ValueError("not a file of token ids")
        at = HEADER_BYTES + directory
        with pa.ipc.open_stream(pa.py_buffer(self.raw[HEADER_BYTES:at])) as rows:
            table = rows.read_all()
        self.doc_ids = table.column("doc_id").combine_chunks()
        self.bounds = np.zeros(self.n_docs + 1, np.int64)
        np.cumsum(table.column("n_ids").to_numpy(), out=self.bounds[1:])
        n_blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(self.raw, "<u8", n_blocks + 1, at).astype(np.int64)
        self.blocks = self.raw[at + 8 * (n_blocks + 1):at + 8 * (n_blocks + 1) + size]
        if len(self.blocks) != size or self.bounds[-1] != self.n_ids:
            raise ValueError("a file of token ids is cut off or damaged")

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of this file, from the blocks that hold them."""
        start, stop = max(start, 0), min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, "<u4")
        out = []
        for b in range(start // self.block, (stop - 1) // self.block + 1):
            first = b * self.block
            held = unpack_bits(self.blocks[self.offsets[b]:self.offsets[b + 1]], min(self.block, self.n_ids - first), self.width)
            out.append(held[max(start - first, 0):stop - first])
        return np.concatenate(out)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.bounds[k]), int(self.bounds[k + 1]))


def _images(tokenizer: str, end: int, block: int, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(tokenizer, CACHE_BYTES)
        width = bits_for(max(known.tokenizer.get_vocab_size(), end + 1))
        part, ordinal = TaskContext.get().partitionId(), 0
        docs: list[pa.Array] = []
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            counts = np.array([len(x) for x in held]) // known.dtype.itemsize
            ids = np.frombuffer(b"".join(held), known.dtype)
            held.clear()  # before the next copies are made
            whole = image(pa.concat_arrays(docs), counts, ids, width, part, ordinal, block)
            return pa.RecordBatch.from_arrays([pa.array([whole], pa.binary())], names=["image"])

        for batch in batches:
            for rows, data, bounds in bw.slices(batch, "text"):
                ids = known.of(data, bounds, end)
                at = 0
                for k, one in enumerate(ids):
                    held.append(one)
                    size += len(one) // known.dtype.itemsize
                    if size * width >= 8 * file_bytes:
                        docs.append(rows.column(0).slice(at, k + 1 - at))
                        yield close()
                        docs, size, at, ordinal = [], 0, k + 1, ordinal + 1
                if at < len(ids):
                    docs.append(rows.column(0).slice(at))
        if held:
            yield close()

    return run


def write_id_files(docs: DataFrame, path: str, tokenizer: str, end: int = 1, doc_id: str = "doc_id", text: str = "text",
                   block: int = BLOCK_IDS, file_bytes: int = FILE_BYTES) -> None:
    """Encode every row of ``docs`` and write its ids, closed by ``end``, in ascending order of ``doc_id`` below ``path``.

    Rows without an id come first; rows of one id are ordered by a hash of their text, so a hot id is dealt
    over many partitions. A null or empty text is the end id alone. Rows that repeat are written each; other
    columns are ignored. No rows give an empty manifest. ``path`` must not exist. Ids may be of any type that sorts.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    id_type = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # equal rows may lie in any order, so a running number may deal them
    keyed = rows.withColumns({"_hash": F.xxhash64("text"), "_number": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange("doc_id", "_hash", "_number").sortWithinPartitions("doc_id", "_hash").select("doc_id", "text")
    images = ordered.mapInArrow(_images(tokenizer, end, block, file_bytes), "image binary")
    # the text sink writes the bytes of a value as they are, and works on every store that Spark writes to
    images.select(F.col("image").cast("string").alias("value")).write.options(maxRecordsPerFile=1, compression="none", lineSep="\n").text(f"{path}/blocks")

    def field(at: int, size: int):
        return F.conv(F.hex(F.expr(f"substring(content, {at + 1}, {size})")), 16, 10).cast("long")

    files = spark.read.format("binaryFile").load(f"{path}/blocks").where("length > 0").select(
        F.element_at(F.split("path", "/"), -1).alias("file"), field(16, 8).alias("part"), field(24, 8).alias("ordinal"),
        field(32, 8).alias("n_docs"), field(40, 8).alias("n_ids"))
    # one row per part: no more than the range sort has partitions
    before, total = [], 0
    for part, n in files.groupBy("part").agg(F.sum("n_ids")).orderBy("part").collect():
        before.append((part, total))
        total += n
    parts = spark.createDataFrame(before, "part long, before long")
    earlier = Window.partitionBy("part").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("before") + F.coalesce(F.sum("n_ids").over(earlier), F.lit(0))
    files.join(parts, "part").select(
        "file", "part", "ordinal", first.alias("first"), "n_ids", F.col("n_docs").alias("n_docs", metadata={"doc_id": id_type})).write.parquet(f"{path}/manifest")


def _manifest(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    manifest = spark.read.parquet(f"{path}/manifest")
    return manifest, manifest.schema["n_docs"].metadata["doc_id"]


def _contents(spark: SparkSession, path: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.format("binaryFile").load(f"{path}/blocks").where("length > 0")


def _documents(spark: SparkSession, path: str, column: str, value) -> DataFrame:
    """(doc_id, start, n_tokens, ``column``) of every document; ``value`` makes the column's entry from its ids."""
    manifest, id_type = _manifest(spark, path)
    name, kind = column.split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                file = IdFile(raw.as_buffer())
                for at in range(0, file.n_docs, 1024):
                    to = min(at + 1024, file.n_docs)
                    bounds = file.bounds[at:to + 1]
                    ids = file.ids(int(bounds[0]), int(bounds[-1]))
                    cut = (bounds - bounds[0]).tolist()
                    values = pa.array([value(ids[a:z]) for a, z in zip(cut[:-1], cut[1:])], pa.binary() if kind == "binary" else pa.int64())
                    n = to - at
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, file.part)), pa.array(np.full(n, file.ordinal)), file.doc_ids.slice(at, n), pa.array(bounds[:-1]),
                         pa.array(np.diff(bounds)), values], names=["part", "ordinal", "doc_id", "inside", "n_tokens", name])

    rows = _contents(spark, path).select("content").mapInArrow(
        run, f"part long, ordinal long, doc_id {id_type}, inside long, n_tokens long, {column}")
    return rows.join(manifest.select("part", "ordinal", "first"), ["part", "ordinal"]).select(
        "doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", name)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document: ids before it in the corpus, its ids, their CRC-32 as 32-bit numbers."""
    return _documents(spark, path, "ids_crc32 long", lambda ids: zlib.crc32(ids.tobytes()))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document; ids as little-endian unsigned 32-bit numbers."""
    return _documents(spark, path, "ids binary", lambda ids: ids.tobytes())


def read_range(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """(start, ids): ids ``start`` to ``stop`` of the whole corpus, one row per file that holds some of them; no other file is read."""
    manifest, _ = _manifest(spark, path)
    hit = manifest.where((F.col("first") < stop) & (F.col("first") + F.col("n_ids") > start)).select("part", "ordinal", "file", "first")
    at = {(r["part"], r["ordinal"]): r for r in hit.collect()}  # the range as the caller bounds it
    firsts = {k: r["first"] for k, r in at.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                file = IdFile(raw.as_buffer())
                first = firsts[file.part, file.ordinal]
                ids = file.ids(start - first, stop - first)
                yield pa.RecordBatch.from_arrays([pa.array([max(first, start)]), pa.array([ids.tobytes()], pa.binary())], names=["start", "ids"])

    if not at:
        return spark.createDataFrame([], "start long, ids binary")
    bounded_batches(spark)
    files = spark.read.format("binaryFile").load([f"{path}/blocks/{r['file']}" for r in at.values()])
    return files.select("content").mapInArrow(run, "start long, ids binary")
