"""Attaching a keyed lookup to a big table when a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.operators.clean import quoted

# a key holding more than total/HOT_SHARE rows is hot, so there are at most HOT_SHARE hot keys
HOT_SHARE = 2000
BROADCAST_ROWS = 500_000


def attach_by_number(big: DataFrame, lookup: DataFrame, key: str, count: str, spread: Column,
                     total: int, lookup_rows: int) -> DataFrame:
    """Left join of ``lookup`` (unique DOUBLE ``key`` >= 0, its row count in ``count``) onto ``big``.

    A lookup of at most ``BROADCAST_ROWS`` rows is broadcast. A larger one is split: keys so
    frequent that one task would drown are few (at most ``HOT_SHARE``) and are broadcast; the rest
    is a shuffle join in which no key holds more than total/HOT_SHARE rows. Rows whose key is
    NULL or already served are sent to spread-out dummy keys below zero, which match nothing.
    """
    values = [c for c in lookup.columns if c not in (key, count)]
    slim = lookup.drop(count)
    if lookup_rows <= BROADCAST_ROWS:
        return big.join(F.broadcast(slim), key, "left").select(*[quoted(c) for c in big.columns], *values)
    hot = lookup.where(F.col(count) > total / HOT_SHARE).drop(count)
    cold = lookup.where(F.col(count) <= total / HOT_SHARE).drop(count)
    hot = hot.select(F.col(key), *[F.col(v).alias(f"__hot_{v}") for v in values],
                     F.lit(True).alias("__served"))
    step = big.join(F.broadcast(hot), key, "left")
    dummy = F.lit(-1.0) - F.pmod(F.xxhash64(spread), F.lit(65536)).cast("double")
    step = step.withColumn(
        "__key", F.when(F.col("__served").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(dummy))
    cold = cold.select(F.col(key).alias("__key"), *[F.col(v).alias(f"__cold_{v}") for v in values])
    joined = step.join(cold, "__key", "left")
    return joined.select(
        *[quoted(c) for c in big.columns],
        *[F.coalesce(f"__hot_{v}", f"__cold_{v}").alias(v) for v in values])
