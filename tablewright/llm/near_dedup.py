"""Near-duplicate classes by MinHash signatures and a multi-index Hamming join.

1. ``sketches``: each text becomes its set of word shingles, a 128-bit digest of the set, and a signature
   of b-bit MinHash values. Texts with equal sets collapse to one representative.
2. ``index_keys``: a signature of ``size`` values is split into chunks. Two signatures that differ in at
   most ``errors`` values must, by the pigeonhole principle, agree on some chunk up to its share of
   errors (0 or 1). The allowed errors are enumerated by masking: a chunk gives one key per value left
   out. Signatures within the distance therefore always share a key.
3. Buckets with the same members are merged by a digest of the members, then compared inside tasks.
   Only pairs that hold what the distance connects leave a task: at most one row per member.
4. The components so found are small neighbourhoods that hold every possible link. Their full shingle
   sets are compared exactly, block against block, and the confirmed links give the classes.

Buckets and neighbourhoods of any size are split into pairs of bounded blocks, so no task or group holds
a hot key whole, and nothing is capped. A pair at exactly the similarity misses the signature distance
with a probability below ``MISS``; at higher similarity far less.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import bytewords as bw
from tablewright.llm.links import connected_components, spanning_pairs
from tablewright.llm.streams import binary_column, binary_rows, bounded_batches, groups, together
from tablewright.session import materialise

MISS = 1e-5
BUCKET_BLOCK = 4096
CHECK_BLOCK = 256
CHECK_SHINGLES = 500_000
_STEP = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


@dataclass(frozen=True)
class NearRule:
    """What counts as near: ``percent`` is the smallest 100 * intersection / union of shingle sets."""

    shingle: int = 5
    percent: int = 80
    size: int = 64
    seed: int = 7

    @property
    def errors(self) -> int:
        """Smallest distance that two texts at the similarity exceed with a probability below MISS."""
        p = 1 - self.percent / 100
        tail, d = 1.0, -1
        while tail > MISS:
            d += 1
            tail -= math.comb(self.size, d) * p**d * (1 - p) ** (self.size - d)
        return d

    @property
    def chunks(self) -> list[tuple[np.ndarray, int]]:
        """(positions, allowed errors); the allowed errors plus one add up to ``errors + 1``."""
        share = [1] * ((self.errors + 1) // 2) + [0] * ((self.errors + 1) % 2)
        bounds = np.linspace(0, self.size, len(share) + 1).round().astype(int)
        return [(np.arange(a, z), e) for a, z, e in zip(bounds[:-1], bounds[1:], share)]


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word windows, text after text, and their bounds; fewer words give one window of all."""
    counts = np.diff(first)
    windows = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(windows)])
    out = np.zeros(bounds[-1], np.uint64)
    full = counts >= size
    if full.any():
        n = len(words) - size + 1
        total = np.zeros(n, np.uint64)
        for k in range(size):
            total = bw.mix(total * _STEP[0] + words[k:k + n]) if k else words[:n] * _STEP[1]
        start = np.repeat(first[:-1][full] - bounds[:-1][full], windows[full])
        to = np.flatnonzero(np.repeat(full, windows))
        out[to] = total[to + start]
    for i in np.flatnonzero((counts > 0) & ~full):
        value = np.full(1, counts[i], np.uint64)
        for w in words[first[i]:first[i + 1]]:
            value = bw.mix(value * _STEP[0] + w)
        out[bounds[i]] = value[0]
    return out, bounds


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    found = bw.runs(data, bounds, bw.WORD_BYTES, bw.LOWER_ASCII)
    values, at = shingle_hashes(found.hashes(), found.first, size)
    for i in range(len(bounds) - 1):
        yield np.unique(values[at[i]:at[i + 1]])


def _families(rule: NearRule) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(rule.seed)
    flips = rng.integers(0, 1 << 32, rule.size, dtype=np.uint32)[:, None]
    factors = (rng.integers(0, 1 << 32, rule.size, dtype=np.uint32) | np.uint32(1))[:, None]
    return flips, factors


def signature(shingles: np.ndarray, flips: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """16-bit MinHash values of a non-empty set."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(flips), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 65536):
        part = short[at:at + 65536]
        np.minimum(low, ((part[None, :] ^ flips) * factors).min(axis=1), out=low)
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def sketches(docs: DataFrame, rule: NearRule, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, sig); sig is null for texts without words."""
    bounded_batches(docs.sparkSession)
    id_type = dict(docs.dtypes)[doc_id]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips, factors = _families(rule)
        for batch in batches:
            for part, data, bounds in bw.slices(batch, "text"):
                rows = part.num_rows
                n, set_a, set_b = (np.zeros(rows, np.int64) for _ in range(3))
                sigs: list[bytes | None] = [None] * rows
                for i, s in enumerate(shingle_sets(data, bounds, rule.shingle)):
                    if len(s):
                        n[i], set_a[i] = len(s), s.sum(dtype=np.uint64).astype(np.int64)
                        set_b[i] = np.bitwise_xor.reduce(bw.mix(s)).astype(np.int64)
                        sigs[i] = signature(s, flips, factors).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n), pa.array(set_a), pa.array(set_b), pa.array(sigs, pa.binary())],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "sig"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(sketch, f"doc_id {id_type}, n_shingles long, set_a long, set_b long, sig binary")


def index_keys(representatives: DataFrame, rule: NearRule) -> DataFrame:
    """(key, doc_id): one row for each chunk and each way to leave out its allowed errors."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = binary_rows(batch.column(1), np.uint16, rule.size).astype(np.uint64)
            out = []
            for c, (positions, errors) in enumerate(rule.chunks):
                for left_out in positions if errors else [-1]:
                    value = np.full(len(sigs), (c << 16) + left_out + 1, np.uint64)
                    for p in positions:
                        if p != left_out:
                            value = bw.mix(value * _STEP[0] + sigs[:, p])
                    out.append(value.astype(np.int64))
            flat = np.stack(out, 1).ravel() if len(sigs) else np.zeros(0, np.int64)
            offsets = (np.arange(len(sigs) + 1) * len(out)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["doc_id", "keys"])

    listed = representatives.select("doc_id", "sig").mapInArrow(keys, "doc_id long, keys array<long>")
    return listed.select(F.explode("keys").alias("key"), "doc_id")


def _units(df: DataFrame, by: str, blocks: str) -> DataFrame:
    """Deal each row to the pairs of blocks that its block takes part in; ``unit`` names the pair."""
    own = F.pmod(F.xxhash64("doc_id"), F.col(blocks))
    df = df.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1)))
    return df.withColumn("unit", F.xxhash64(by, F.least("block", "other"), F.greatest("block", "other"))).drop("other")


def _bucket_pairs(rows: DataFrame, rule: NearRule) -> DataFrame:
    """Pairs that connect, within each unit, what lies within the signature distance."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in groups(batches, "unit"):
            ids = unit.column("doc_id").to_numpy()
            order = np.argsort(ids)
            ids, sigs = ids[order], binary_rows(unit.column("sig"), np.uint16, rule.size)[order]
            a, b = spanning_pairs(len(ids), lambda i: (sigs != sigs[i]).sum(axis=1) <= rule.errors)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

    return together(rows.select("unit", "doc_id", "sig"), "unit").mapInArrow(compare, "a long, b long").distinct()


def similar_matrix(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets reach the similarity; exact counts from products of membership matrices."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), sizes)
    shared = np.bincount(column, minlength=len(values)) > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((n, n), np.float64)
    width = 4096
    edges = np.searchsorted(column, np.arange(0, int(shared.sum()) + width, width))
    for k, (at, to) in enumerate(zip(edges[:-1], edges[1:])):
        held = np.zeros((n, width), np.float32)
        held[row[at:to], column[at:to] - k * width] = 1
        both += held @ held.T
    both = both.astype(np.int64)
    return 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)


def _confirmed_pairs(rows: DataFrame, rule: NearRule) -> DataFrame:
    """Pairs that connect, within each unit, what the full sets confirm."""
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in groups(batches, "unit"):
            ids = unit.column("doc_id").to_numpy()
            order = np.argsort(ids)
            sets = [np.frombuffer(x, np.uint64) for x in unit.column("shingles").to_pylist()]
            linked = similar_matrix([sets[i] for i in order], rule.percent)
            ids = ids[order]
            a, b = spanning_pairs(len(ids), lambda i: linked[i].copy())
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

    return together(rows.select("unit", "doc_id", "shingles"), "unit").mapInArrow(confirm, "a long, b long").distinct()


def _with_sets(rows: DataFrame, rule: NearRule) -> DataFrame:
    """Replace ``text`` by the full shingle set as sorted 64-bit values."""
    kept = [c for c in rows.columns if c != "text"]
    types = dict(rows.dtypes)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, bounds in bw.slices(batch, "text"):
                found = pa.array([s.tobytes() for s in shingle_sets(data, bounds, rule.shingle)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in kept] + [found], names=[*kept, "shingles"])

    return rows.mapInArrow(sets, ", ".join(f"{c} {types[c]}" for c in kept) + ", shingles binary")


def candidate_components(representatives: DataFrame, rule: NearRule) -> DataFrame:
    """(id, root): components of the graph of signatures within the distance."""
    keys = materialise(index_keys(representatives, rule), "keys")
    buckets = keys.groupBy("key").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(doc_id))").alias("members"))
    # buckets with the same members give the same pairs; one of them is enough
    buckets = buckets.where("n > 1").groupBy("n", "members").agg(F.min("key").alias("key"))
    blocks = buckets.select("key", F.ceil(F.col("n") / BUCKET_BLOCK).alias("blocks"))
    met = materialise(keys.join(blocks, "key"), "met")
    met = met.join(representatives.select("doc_id", "sig"), "doc_id")
    return connected_components(_bucket_pairs(_units(met, "key", "blocks"), rule))


def near_duplicates(docs: DataFrame, rule: NearRule = NearRule(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per row of ``docs``.

    Texts are linked when 100 * intersection >= percent * union of their shingle sets; ``component_id``
    is the smallest doc_id reachable over links and ``kept`` marks that document. Null and empty texts,
    and texts of spaces only, have no shingles and are linked with nothing; a text with fewer words than
    a shingle is one shingle of all its words. Rows with an equal doc_id share a class and are all
    returned. A null doc_id keeps its row, with a null class, kept. Other columns are ignored.
    """
    sketch = materialise(sketches(docs, rule, doc_id, text).withColumn("doc_id", F.col("doc_id").cast("long")), "sketch")
    worded = sketch.where("n_shingles > 0 and doc_id is not null")
    alike = worded.groupBy("set_a", "set_b").agg(
        F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
    alike = materialise(alike, "alike")
    # a repeated doc_id with different texts stays one node
    nodes = alike.dropDuplicates(["doc_id", "sig"])
    near = materialise(candidate_components(nodes, rule), "near")
    sizes = near.join(alike, near["id"] == alike["doc_id"]).groupBy("root").agg(
        F.count("*").alias("n"), F.sum("n_shingles").alias("shingles")).where("n > 1")
    blocks = F.greatest(F.ceil(F.col("n") / CHECK_BLOCK), F.ceil(F.col("shingles") / CHECK_SHINGLES))
    asked = near.join(sizes, "root").select(F.col("id").alias("doc_id"), "root", blocks.alias("blocks"))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    held = _with_sets(texts.join(asked, "doc_id"), rule)
    links = materialise(_confirmed_pairs(_units(held, "root", "blocks"), rule), "links")
    # rows that repeat a doc_id are one document: they tie their sets together
    ties = worded.groupBy("set_a", "set_b", "doc_id").count().join(alike.select("set_a", "set_b", F.col("doc_id").alias("low")), ["set_a", "set_b"])
    repeated = worded.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1")
    ties = ties.join(repeated, "doc_id").select(F.col("low").alias("a"), F.col("doc_id").alias("b"))
    roots = connected_components(links.union(ties))
    classes = alike.join(roots, alike["doc_id"] == roots["id"], "left").select(
        "set_a", "set_b", F.coalesce("root", "doc_id").alias("found"))
    out = sketch.join(classes, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("found")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
