"""Words and lines of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow batch.

A task sees a batch of texts as one byte buffer. Runs of "inside" bytes (words, or the lines between
line breaks) are found by a table lookup, and each run gets a 64-bit hash from prefix sums of a
polynomial, so no Python object is made per word. Hashes depend on the bytes of the run only: they are
equal on every executor, in every batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

#: spaces of the word pattern [^\x20\x09-\x0D]+
SPACES = (9, 10, 11, 12, 13, 32)


def byte_table(values, inside: bool = True) -> np.ndarray:
    """A table over the 256 bytes: ``inside`` for the given values, the opposite for the others."""
    out = np.full(256, not inside)
    out[list(values)] = inside
    return out


WORD_BYTES = byte_table(SPACES, inside=False)
LINE_BYTES = byte_table([10], inside=False)
#: letters and digits of ASCII, and every byte of a longer code point
ALNUM_BYTES = byte_table([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
KEEP_CASE = np.arange(256, dtype=np.uint8)
LOWER_ASCII = KEEP_CASE.copy()
LOWER_ASCII[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


@dataclass
class Runs:
    """Runs of inside bytes of a slice of texts; ``first[i]:first[i + 1]`` are those of text i."""

    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    case: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash per run."""
        n = len(self.data)
        if not len(self.start):
            return np.zeros(0, np.uint64)
        up, down = _power_tables(n)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE_VALUES[self.case[self.data]] * up[:n], out=total[1:])
        value = (total[self.end] - total[self.start]) * down[self.start]
        return mix(value + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def runs(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray = WORD_BYTES, case: np.ndarray = KEEP_CASE) -> Runs:
    """The maximal runs of inside bytes; a run never crosses from one text into the next."""
    held = inside[data]
    starts, stops = held.copy(), held.copy()
    starts[1:] &= ~held[:-1]
    stops[:-1] &= ~held[1:]
    edge = bounds[(bounds > 0) & (bounds < len(data))]
    starts[edge] = held[edge]
    stops[edge - 1] = held[edge - 1]
    start = np.flatnonzero(starts)
    return Runs(data, bounds, start, np.flatnonzero(stops) + 1, np.searchsorted(start, bounds), case)


def code_points(data: np.ndarray) -> np.ndarray:
    """Prefix counts of code points: element i is the number that begins before byte i."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the ranges that ``first`` bounds; empty ranges give 0."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of an Arrow string column, without a copy; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    bounds = bounds.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:  # a null may own bytes; they are no text
        sizes = np.diff(bounds) * column.is_valid().to_numpy(zero_copy_only=False)
        if sizes.sum() != bounds[-1] - bounds[0]:
            return text_buffer(column.fill_null(""))
    return raw[bounds[0]:bounds[-1]], bounds - bounds[0]


def slices(batch: pa.RecordBatch, text: str, size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with at most ``size`` bytes of text each, or one text where that is longer."""
    data, bounds = text_buffer(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at), data[bounds[at]:bounds[to]], bounds[at:to + 1] - bounds[at]
        at = to
