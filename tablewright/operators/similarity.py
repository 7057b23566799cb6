"""Nearest neighbours and similarity pairs over vector tables.

Scores are ranked, and held against thresholds, at full precision; equal scores go by id. Both are
exact and need every pair to be looked at once, so the work is cut into blocks of rows:
a task holds two blocks and compares them as one matrix product. No pair is ever a row unless it
is part of the answer. Block sizes are bounded by construction, as rows are dealt out by hash.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from tablewright.session import materialise

BLOCK_BYTES = 32 << 20
BROADCAST_BYTES = 64 << 20
#: scores that a task holds at once
SCORE_CELLS = 4 << 20
#: pairs that a task holds at once
PAIRS = 1 << 16
#: numbers of the two sides of pairs that are scored at once, as few as a core's cache holds
PAIR_CELLS = 1 << 16
#: blocks smaller than BLOCK_BYTES are made no more than this many, as rows are sent once for each
SMALL_BLOCKS = 12
METRICS = ("cosine", "squared_l2")


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def _unit_rows(m: np.ndarray) -> np.ndarray:
    lengths = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, lengths, out=np.zeros_like(m), where=lengths > 0)


def _product_error(width: int) -> float:
    """A bound of the error of a product of unit rows in single precision."""
    return 1.2e-7 * (width + 8)


def _close(q: np.ndarray, c: np.ndarray, metric: str) -> tuple[np.ndarray, float]:
    """Score matrix by products, larger is nearer, and a bound of its error."""
    if metric == "cosine":
        # products of unit rows in single precision; what their error leaves in question is scored again
        return _unit_rows(q).astype(np.float32) @ _unit_rows(c).astype(np.float32).T, _product_error(q.shape[1])
    own, other = (q * q).sum(axis=1), (c * c).sum(axis=1)
    error = 1e-14 * (q.shape[1] + 8) * (own.max(initial=0.0) + other.max(initial=0.0))
    return 2.0 * (q @ c.T) - own[:, None] - other[None, :], error


def _exact(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Scores of row i of ``q`` and row i of ``c``, element by element, so near and equal rows are told apart."""
    if metric == "cosine":
        scale = np.sqrt((q * q).sum(axis=1)) * np.sqrt((c * c).sum(axis=1))
        return np.divide((q * c).sum(axis=1), scale, out=np.zeros(len(q)), where=scale > 0)
    gap = q - c
    return -(gap * gap).sum(axis=1)


def _pair_cosines(left: np.ndarray, right: np.ndarray, lengths: tuple[np.ndarray, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``_exact`` cosines of rows ``x`` of one side and ``y`` of the other, whose lengths are known."""
    step = max(1, PAIR_CELLS // max(1, left.shape[1]))
    score = np.zeros(len(x))
    for i in range(0, len(x), step):
        some, other = x[i:i + step], y[i:i + step]
        scale = lengths[0][some] * lengths[1][other]
        np.divide((left[some] * right[other]).sum(axis=1), scale, out=score[i:i + step], where=scale > 0)
    return score


def _best(q: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, score) of the k nearest rows of ``c`` per row of ``q``: best score first, then smallest id.

    A slice of queries and one of rows at a time are scored by products. Every row that the error of the products leaves
    in question beside the k best so far is scored again exactly, and the exact scores are ranked. A pair of slices holds
    SCORE_CELLS scores.
    """
    parts = []
    wide = max(1, min(len(c), 4096, SCORE_CELLS))
    step = max(1, SCORE_CELLS // wide)
    width = max(1, SCORE_CELLS // max(1, q.shape[1]))
    for at in range(0, len(q), step):
        some = q[at:at + step]
        held = np.empty(0, np.int64), ids[:0], np.empty(0)
        least = np.full(len(some), -np.inf)
        for begin in range(0, len(c), wide):
            near = c[begin:begin + wide]
            scores, error = _close(some, near, metric)
            floor = least - 2 * error
            if near.shape[0] > k and (begin == 0 or np.count_nonzero(scores >= floor[:, None]) > 4 * k * len(some)):
                floor = np.maximum(floor, -np.partition(-scores, k - 1, axis=1)[:, k - 1] - 2 * error)
            row, column = np.nonzero(scores >= floor.astype(scores.dtype)[:, None] - scores.dtype.type(error))
            del scores
            exact = np.empty(len(row))
            for i in range(0, len(row), width):
                exact[i:i + width] = _exact(some[row[i:i + width]], near[column[i:i + width]], metric)
            held = _leading(np.concatenate([held[0], row]), np.concatenate([held[1], ids[begin + column]]), np.concatenate([held[2], exact]), k)
            number = np.bincount(held[0], minlength=len(some))
            full = number >= k
            least[full] = held[2][np.cumsum(number)[full] - 1]
        parts.append((at + held[0], held[1], held[2]))
    return tuple(np.concatenate(p) for p in zip(*parts))


def _leading(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of each row by score and id."""
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], ids[place < k], score[place < k]


def _vector_rows(df: DataFrame, id_col: str, vector_col: str, prefix: str) -> DataFrame:
    return df.select(F.col(id_col).alias(f"{prefix}id"),
                     F.col(vector_col).cast("array<double>").alias(f"{prefix}v"))


def _size_of(df: DataFrame, column: str) -> tuple[int, int]:
    row = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(column)).alias("d")).first()
    return row.n, row.d or 0


def _small_enough(queries: DataFrame, limit_bytes: int) -> list | None:
    """The query rows when they fit the broadcast limit, found by reading no more than the limit."""
    width = queries.select(F.max(F.size("qv"))).first()[0] or 1
    most = max(1, limit_bytes // (8 * width))
    rows = queries.limit(most + 1).collect()
    return rows if len(rows) <= most else None


def nearest(queries: DataFrame, corpus: DataFrame, k: int = 5, id_col: str = "id", vector_col: str = "vector",
            metric: str = "cosine", broadcast_bytes: int = BROADCAST_BYTES,
            block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, id, score, rank): the k nearest corpus rows of every query.

    ``score`` is the cosine similarity, or the squared distance. Queries that fit the broadcast
    limit go to the corpus, which then is not shuffled; more queries go through cells around pivots
    (``pivots.nearest_by_pivots``), block by block. Either way a task sends on at most k rows per query it saw.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    q = _vector_rows(queries, id_col, vector_col, "q")
    c = _vector_rows(corpus, id_col, vector_col, "c")
    small = _small_enough(q, broadcast_bytes)
    if small is None:
        from tablewright.operators.pivots import nearest_by_pivots

        return nearest_by_pivots(queries, corpus, k, id_col, vector_col, metric, block_bytes)
    if not small:
        return _ranked(q.sparkSession.createDataFrame([], _partial_schema(q, c)), k, metric)
    return _ranked(_by_broadcast(q, c, small, k, metric), k, metric)


def _partial_schema(q: DataFrame, c: DataFrame) -> str:
    return f"query_id {q.schema['qid'].dataType.simpleString()}, " \
           f"id {c.schema['cid'].dataType.simpleString()}, score double"


def _ranked(partial: DataFrame, k: int, metric: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    top = partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    shown = F.col("score") if metric == "cosine" else F.abs("score")
    return top.select("query_id", "id", shown.alias("score"), "rank")


def _by_broadcast(q: DataFrame, c: DataFrame, rows: list, k: int, metric: str) -> DataFrame:
    ids = np.array([r.qid for r in rows], dtype=object)
    shared = c.sparkSession.sparkContext.broadcast(
        (ids, np.array([r.qv for r in rows], dtype=np.float64)))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, matrix = shared.value
        held = None
        for batch in batches:
            if batch.empty:
                continue
            found = _best(matrix, _matrix(batch["cv"]), batch["cid"].to_numpy(), k, metric)
            held = found if held is None else _leading(*(np.concatenate(pair) for pair in zip(held, found)), k)
        if held is not None:
            yield pd.DataFrame({"query_id": query_ids[held[0]], "id": held[1], "score": held[2]})

    return c.mapInPandas(best, _partial_schema(q, c))


def _block_bytes(n: int, width: int, block_bytes: int) -> int:
    """The bytes of a block: those wished for, but as small blocks no fewer than a share of all rows, so that copies of rows stay few."""
    return max(block_bytes, min(BLOCK_BYTES, math.ceil(n * max(width, 1) * 8 / SMALL_BLOCKS)))


def _grid(n: int, width: int, block_bytes: int) -> int:
    """Blocks needed so that one holds at most ``block_bytes`` of vectors."""
    return max(1, math.ceil(n * max(width, 1) * 8 / block_bytes))


def similar_pairs(df: DataFrame, threshold: float = 0.7, id_col: str = "id", vector_col: str = "vector",
                  block_bytes: int = BLOCK_BYTES, parallelism: int | None = None) -> DataFrame:
    """(a, b, similarity) of all pairs a < b with cosine similarity of at least ``threshold``. Exact.

    Rows are dealt to blocks by hash; every pair of blocks meets in one task. Memory per task is
    two blocks; with g blocks each row is sent g times. A task compares slices of a block at a
    time, so its score matrix stays small as well.
    """
    v = _vector_rows(df, id_col, vector_col, "c")
    n, width = _size_of(v, "cv")
    # enough block pairs to use every core, and blocks small enough for one task
    cores = parallelism or df.sparkSession.sparkContext.defaultParallelism
    g = max(_grid(n, width, _block_bytes(n, width, block_bytes)), math.ceil(math.sqrt(2 * cores)))
    own = F.pmod(F.xxhash64("cid"), F.lit(g)).cast("int")
    sent = v.withColumn("own", own).select(
        F.explode(F.sequence(F.lit(0), F.lit(g - 1))).alias("other"), "own", "cid", "cv")
    sent = sent.withColumn("cell", F.struct(F.least("own", "other").alias("i"),
                                            F.greatest("own", "other").alias("j")))
    flat = sent.select(F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), "own", "cid", "cv")
    return flat.groupBy("i", "j").applyInPandas(pairs_of_blocks(threshold), _pair_schema(v))


def _pair_schema(v: DataFrame) -> str:
    id_type = v.schema["cid"].dataType.simpleString()
    return f"a {id_type}, b {id_type}, similarity double"


def pairs_of_blocks(threshold: float, wanted: Callable[[pd.DataFrame, pd.DataFrame], Callable[[np.ndarray, np.ndarray], np.ndarray]] | None = None):
    """A function of the rows (i, j, own, cid, cv) of one pair of blocks: its pairs a < b of at least ``threshold``.

    Rows of block i meet those of block j, or each other where both are the same. Pairs are given away as they are
    found, no more than PAIRS at a time. ``wanted`` makes of the rows of both sides a function that tells of places in them
    which pairs count.
    """
    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = pd.concat(parts, ignore_index=True)
        first, last = part["i"].iloc[0], part["j"].iloc[0]
        rows = part if first == last else part[part["own"] == first]
        cols = part if first == last else part[part["own"] == last]
        del part
        if not (len(rows) and len(cols)):
            return
        left, left_ids = _matrix(rows["cv"]), rows["cid"].to_numpy()
        right, right_ids = (left, left_ids) if first == last else (_matrix(cols["cv"]), cols["cid"].to_numpy())
        counts = wanted(rows, cols) if wanted else None
        del rows, cols
        # a row's length and its unit row serve all of its pairs; in the order of ``_close`` and ``_exact``, so scores are theirs
        lengths = tuple(np.sqrt((m * m).sum(axis=1)) for m in (left, right))
        units = tuple(_unit_rows(m).astype(np.float32) for m in (left, right))
        error = _product_error(left.shape[1])
        least = np.float32(threshold - 2 * error)
        wide = max(1, min(len(right), 2048, SCORE_CELLS))
        step = max(1, min(SCORE_CELLS // wide, 2048))
        for at, begin in product(range(0, len(left), step), range(0, len(right), wide)):
            if first == last and begin + wide <= at:
                continue  # the rows of these places meet the other way round
            scores = units[0][at:at + step] @ units[1][begin:begin + wide].T
            found = np.flatnonzero(scores >= least)
            width = scores.shape[1]
            del scores
            for i in range(0, len(found), PAIRS):
                x, y = np.divmod(found[i:i + PAIRS], width)
                x, y = at + x, begin + y
                a, b = left_ids[x], right_ids[y]
                # inside one block a pair may show up twice and each row meets itself
                keep = (a != b) & (x < y) if first == last else a != b
                if not keep.all():
                    x, y, a, b = x[keep], y[keep], a[keep], b[keep]
                score = _pair_cosines(left, right, lengths, x, y)
                near = score >= threshold
                if counts:
                    near &= counts(x, y)
                if not near.all():
                    a, b, score = a[near], b[near], score[near]
                if len(a):
                    yield pd.DataFrame({"a": np.where(a < b, a, b), "b": np.where(a < b, b, a), "similarity": score})

    return compare


def similar_pairs_lsh(df: DataFrame, threshold: float = 0.7, id_col: str = "id", vector_col: str = "vector",
                      tables: int = 5, bucket_length: float = 2.0) -> DataFrame:
    """As ``similar_pairs``, by locality-sensitive hashing. Opt-in: may miss pairs, never adds wrong ones.

    Rows that share a bucket meet there as blocks of bounded bytes; no pair is a row unless it is part of the answer.
    """
    v = _vector_rows(df, id_col, vector_col, "c")
    length = F.sqrt(F.aggregate("cv", F.lit(0.0), lambda acc, x: acc + x * x))
    # a zero vector is like no other; the guarded division matters, as filters may run after it
    filled = F.when(length > 0, F.col("cv")).otherwise(F.transform("cv", lambda x: F.lit(1.0)))
    numbers = F.forall("cv", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    unit = v.where((length > 0) & numbers).withColumn("cv", filled).select(
        "cid", F.transform("cv", lambda x: F.try_divide(x, length)).alias("cv")).dropDuplicates()
    unit = unit.withColumn("unit", array_to_vector("cv"))
    lsh = BucketedRandomProjectionLSH(inputCol="unit", outputCol="hashes", numHashTables=tables,
                                      bucketLength=bucket_length, seed=7)
    schema = _pair_schema(v)
    if unit.isEmpty():
        return df.sparkSession.createDataFrame([], schema)
    codes = F.array(*[vector_to_array(F.col("hashes")[i])[0].cast("bigint") for i in range(tables)])
    hashed = materialise(lsh.fit(unit).transform(unit).select("cid", "cv", codes.alias("codes")), "hashed")
    n, width = _size_of(hashed, "cv")
    held = hashed.select(F.posexplode("codes").alias("table", "bucket")).groupBy("table", "bucket").agg(F.count("*").alias("n"))
    if held.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] >= float(n) * n:
        # buckets hold more pairs than there are: all meet once, and those that share a bucket count
        g = max(_grid(n, width, BLOCK_BYTES), math.ceil(math.sqrt(2 * df.sparkSession.sparkContext.defaultParallelism)))
        placed = hashed.select(F.lit(-1).alias("table"), F.lit(0).cast("bigint").alias("bucket"), "cid", "cv", "codes", F.lit(g).alias("blocks"))
    else:
        most = max(1, BLOCK_BYTES // (8 * max(width, 1)))
        # at most a few for each block of all rows; every other bucket is one block
        large = held.where(F.col("n") > most).select("table", "bucket", F.ceil(F.col("n") / most).cast("int").alias("blocks"))
        placed = hashed.select(F.posexplode("codes").alias("table", "bucket"), "cid", "cv", "codes").join(
            F.broadcast(large), ["table", "bucket"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    sent = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.select("table", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cid", "cv", "codes")
    return sent.groupBy("table", "bucket", "i", "j").applyInPandas(pairs_of_blocks(threshold, _met_here), schema)


def _met_here(rows: pd.DataFrame, cols: pd.DataFrame) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Pairs that share a bucket, each in the first table where they do; in the table -1 wherever that is."""
    table, a, b = rows["table"].iloc[0], np.stack(rows["codes"].to_numpy()), np.stack(cols["codes"].to_numpy())
    if table < 0:
        return lambda x, y: (a[x] == b[y]).any(axis=1)
    return lambda x, y: ~(a[x, :table] == b[y, :table]).any(axis=1)


def both_ways(pairs: DataFrame) -> DataFrame:
    """Directed edges (node, neighbour, similarity): each pair in both directions."""
    ends = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("neighbour")),
                   F.struct(F.col("b").alias("node"), F.col("a").alias("neighbour")))
    return pairs.select(F.explode(ends).alias("e"), "similarity").select("e.node", "e.neighbour", "similarity")


def undirected(edges: DataFrame, a: str = "node", b: str = "neighbour") -> DataFrame:
    """Each connection once, smaller id first."""
    return edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
