"""Arrow helpers: bounded batches, and the groups of a sorted partition as a stream."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches end at 16 MB as well as at the row limit, unless the session says otherwise.

    The row limit alone lets a batch of very long texts grow without bound.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, "2147483647")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of rows with an equal 64-bit ``key``; rows must come with equal keys next to each other."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), batch.num_rows]
        for at, to in zip(cuts[:-1], cuts[1:]):
            if held and values[at] != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, to - at))
            held_key = values[at]
    if held:
        yield pa.Table.from_batches(held)


def together(df: DataFrame, key: str) -> DataFrame:
    """Rows with an equal key next to each other in one partition."""
    return df.repartition(key).sortWithinPartitions(key)


def binary_rows(column: pa.Array, dtype, width: int) -> np.ndarray:
    """A column of equally long byte strings as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, dtype).reshape(len(column), width)


def binary_column(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as byte strings."""
    matrix = np.ascontiguousarray(matrix)
    size = matrix.shape[1] * matrix.itemsize
    offsets = (np.arange(len(matrix) + 1) * size).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(matrix.tobytes())])
