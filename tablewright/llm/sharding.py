"""Shards of near-equal bytes that keep groups of equal texts whole.

Groups are ordered by a digest of their text, and a shard is a contiguous range of that order. The
smallest feasible capacity is found by binary search: a greedy pass fills shard after shard up to the
capacity and sees whether the shards suffice. The passes run over at most ``PIECES`` sums. A piece of
the order that holds several groups is opened up, by further bits of the digest, only where a cut could
fall into it; the search ends when the answer no longer depends on what closed pieces hold.

DataFrame functions only; the driver holds ``PIECES`` numbers at most, whatever the input.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.session import materialise

PIECES = 65_536
DIGEST_BITS = 63
#: the first pieces share so many bits; the rest of PIECES is room for opening some of them
FIRST_BITS = 14
#: rows that are numbered in one go
SLOT_ROWS = 200_000


@dataclass(frozen=True)
class Piece:
    """A range of the order: its first and last digest, and its bytes."""

    low: int
    high: int
    size: int

    @property
    def single(self) -> bool:
        return self.low == self.high


def digest(text: Column) -> Column:
    """63 bits that order the groups of equal texts; equal texts are equal, null is like empty."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 1)


def _pieces(sized: DataFrame, shift: int) -> list[Piece]:
    """Sums of the ranges of the order that share their bits above ``shift``."""
    rows = sized.groupBy(F.shiftright("digest", shift).alias("piece")).agg(
        F.sum("size").alias("size"), F.min("digest").alias("low"), F.max("digest").alias("high")).orderBy("piece").collect()
    return [Piece(r["low"], r["high"], r["size"]) for r in rows]


def _greedy(pieces: list[Piece], ends: list[int], capacity: int, shards: int, hopeful: bool,
            at: int = 0) -> list[tuple[int, int]] | None:
    """(position, index of the piece there) of each cut, or None if the shards do not suffice.

    A closed piece may hide a group boundary anywhere: ``hopeful`` takes it exactly at the capacity,
    otherwise the cut falls to the last boundary that is known.
    """
    cuts = []
    for _ in range(shards):
        reach = at + capacity
        done = bisect_right(ends, reach)
        if done == len(pieces):
            return cuts
        known = ends[done - 1] if done else 0
        at = reach if hopeful and not pieces[done].single else known
        cuts.append((at, done))
    return None


def _smallest(pieces: list[Piece], ends: list[int], shards: int, low: int, high: int, hopeful: bool) -> int:
    while low < high:
        middle = (low + high) // 2
        if _greedy(pieces, ends, middle, shards, hopeful) is None:
            low = middle + 1
        else:
            high = middle
    return low


def minimax_cuts(sized: DataFrame, shards: int) -> tuple[int, list[int]]:
    """(capacity, first digests of the shards after the first) for rows with ``digest`` and ``size``.

    The capacity is the smallest for which contiguous shards of whole groups exist.
    """
    pieces = _pieces(sized, DIGEST_BITS - FIRST_BITS)
    while True:
        ends = list(accumulate(p.size for p in pieces))
        total = ends[-1] if ends else 0
        surest = _smallest(pieces, ends, shards, 0, total, hopeful=False)
        best = _smallest(pieces, ends, shards, 0, surest, hopeful=True)
        closed = set()
        if best < surest:
            # every closed piece into which a cut can fall for a capacity between the two bounds
            near = [_greedy(pieces, ends, best, shards, True), _greedy(pieces, ends, surest, shards, True),
                    _greedy(pieces, ends, surest, shards, False)]
            first, at = [], 0
            for _ in range(shards):  # how far the least capacity reaches at worst
                first.append(bisect_right(ends, at + best))
                at = ends[first[-1] - 1] if first[-1] else 0
            for k in range(shards):
                last = max((cuts[k][1] for cuts in near if cuts and k < len(cuts)), default=first[k])
                closed |= {i for i in range(first[k], min(last, len(pieces) - 1) + 1) if not pieces[i].single}
        if not closed:
            return surest, [pieces[i].low for i in _even_cuts(pieces, ends, surest, shards)]
        # open them as finely as the bound on collected sums allows
        bits = max(1, (max(2, (PIECES - len(pieces)) // len(closed))).bit_length() - 1) if len(pieces) < PIECES else 1
        pieces = _open(sized, pieces, sorted(closed), min(bits, 16))


def _even_cuts(pieces: list[Piece], ends: list[int], capacity: int, shards: int) -> list[int]:
    """Pieces at which new shards begin: where the capacity leaves room, at even shares of what is left."""
    cuts, at, total = [], 0, ends[-1] if ends else 0
    for left in range(shards, 1, -1):
        share = at + (total - at) / left
        i = bisect_right(ends, share)
        if i < len(ends) and (i == 0 or ends[i] - share < share - ends[i - 1]):
            i += 1
        farthest = bisect_right(ends, at + capacity)
        i = min(i, farthest)
        if _greedy(pieces, ends, capacity, left - 1, False, ends[i - 1] if i else 0) is None:
            i = farthest
        if i >= len(pieces):
            break
        cuts.append(i)
        at = ends[i - 1] if i else 0
    return cuts


def _open(sized: DataFrame, pieces: list[Piece], closed: list[int], bits: int) -> list[Piece]:
    """Replace closed pieces by finer ones, each split into up to 2^bits equal ranges of its digests."""
    starts = F.array(*(F.lit(pieces[i].low) for i in closed))
    stops = F.array(*(F.lit(pieces[i].high) for i in closed))
    # the last start not above the digest; the starts are few, they lie at the cuts
    place = F.size(F.filter(starts, lambda x: x <= F.col("digest")))
    inside = sized.where(F.col("digest").between(pieces[closed[0]].low, pieces[closed[-1]].high))
    inside = inside.withColumn("place", place).withColumn("start", F.get(starts, F.col("place") - 1))
    inside = inside.withColumn("stop", F.get(stops, F.col("place") - 1)).where(F.col("digest") <= F.col("stop"))
    step = F.greatest(F.expr("1L"), F.shiftright(F.col("stop") - F.col("start") + 1, bits))
    part = F.expr("(digest - start) div step")
    rows = inside.withColumn("step", step).groupBy("place", part.alias("part")).agg(
        F.sum("size").alias("size"), F.min("digest").alias("low"), F.max("digest").alias("high")).collect()
    gone = set(closed)
    finer = [Piece(r["low"], r["high"], r["size"]) for r in rows]
    return sorted([p for i, p in enumerate(pieces) if i not in gone] + finer, key=lambda p: p.low)


def with_slots(placed: DataFrame, rows: int, shards: int) -> DataFrame:
    """Number the rows of each shard from 0 without gaps; no window holds more than about SLOT_ROWS rows."""
    bins = max(1, -(-rows // (shards * SLOT_ROWS)))
    binned = placed.withColumn("bin", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(bins)))
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = binned.groupBy("shard", "bin").agg(F.count("*").alias("n")).select(
        "shard", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inner = F.row_number().over(Window.partitionBy("shard", "bin").orderBy("doc_id", "digest"))
    numbered = binned.withColumn("row", inner)
    return numbered.join(starts, ["shard", "bin"]).withColumn("slot", F.col("start") + F.col("row") - 1).drop("bin", "row", "start")


def shard_by_bytes(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", overhead: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): contiguous shards of least largest size, equal texts together.

    ``size`` is the UTF-8 bytes of the text plus ``overhead``. A null text counts as an empty one. Every
    row is returned, repeated rows too; other columns are ignored. An empty table gives no rows. Shards
    can stay empty where one group is larger than an even share.
    """
    plain = F.coalesce(F.col(text), F.lit(""))
    sized = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(plain).cast("long") + overhead).alias("size"),
                        F.crc32(plain.cast("binary")).alias("text_crc32"), digest(F.col(text)).alias("digest"))
    sized = materialise(sized, "sizes")
    _, cuts = minimax_cuts(sized, shards)
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + F.when(F.col("digest") >= F.lit(cut), 1).otherwise(0)
    placed = sized.withColumn("shard", shard)
    return with_slots(placed, sized.count(), shards).select("doc_id", "size", "text_crc32", "shard", "slot")
