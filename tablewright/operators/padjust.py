"""Adjustment of p-values for multiple testing: Benjamini-Hochberg, Benjamini-Yekutieli,
Bonferroni, Holm.

All four need the rank of a p-value among all of them. Equal values share a rank, so the work is
done on distinct p-values with counts. They are cut into range buckets; running totals inside a
bucket are a window over that bucket only, and one row per bucket carries them across buckets.
No window ever spans the whole table unless the distinct values fit one bucket.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.functions import lenient
from tablewright.functions.numbers import clamp
from tablewright.operators.clean import quoted
from tablewright.operators.keyed import attach_by_number
from tablewright.session import materialise

METHODS = ["bh", "by", "bonferroni", "holm"]
BUCKET_ROWS = 500_000
MAX_BUCKETS = 4096


def prepared_p(df: DataFrame, column: str) -> Column:
    """Lenient number limited to [0, 1]; NULL is kept out of the test and stays NULL."""
    dtype = df.schema[column].dataType
    # adding 0.0 turns -0.0 into 0.0, so both are one distinct value
    return clamp(lenient.to_number(quoted(column), dtype), 0.0, 1.0) + F.lit(0.0)


def harmonic(m: int) -> float:
    """1 + 1/2 + ... + 1/m; beyond a million terms by the asymptotic series (error < 1e-16)."""
    if m <= 1_000_000:
        return math.fsum(1.0 / k for k in range(1, m + 1))
    return math.log(m) + 0.57721566490153286 + 1 / (2 * m) - 1 / (12 * m * m)


@dataclass(frozen=True)
class Adjusted:
    """Distinct p-values with counts and adjusted values, and the totals found on the way."""

    table: DataFrame  # p, n, bh, by, bonferroni, holm
    tests: int
    distinct: int


def adjusted_values(p_values: DataFrame, bucket_rows: int = BUCKET_ROWS) -> Adjusted:
    """Adjusted values per distinct p of a table with one DOUBLE column ``p``."""
    # the NULL group counts no values; testing the count keeps the test above the aggregate
    distinct = p_values.groupBy("p").agg(F.count("p").alias("n")).where(F.col("n") > 0)
    shares = [k / MAX_BUCKETS for k in range(1, MAX_BUCKETS)]
    totals = distinct.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("tests"), F.count(F.lit(1)).alias("distinct")).first()
    m, d = totals.tests, totals.distinct
    if d > bucket_rows:
        distinct = materialise(distinct, "distinct-p")
        want = min(MAX_BUCKETS, math.ceil(2 * d / bucket_rows))
        step = max(1, MAX_BUCKETS // want)
        inner = distinct.approxQuantile("p", shares[step - 1::step], 1 / (4 * want))
        splits = [-math.inf, *sorted({x for x in inner if 0 < x < 1}), math.inf]
        bucketed = Bucketizer(splits=splits, inputCol="p", outputCol="bucket").transform(distinct)
    else:
        bucketed = distinct.withColumn("bucket", F.lit(0.0))
    return Adjusted(_scan(bucketed, m, single=d <= bucket_rows), m, d)


def _scan(bucketed: DataFrame, m: int, single: bool) -> DataFrame:
    upto = Window.partitionBy("bucket").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    onward = Window.partitionBy("bucket").orderBy(F.col("p").desc()).rowsBetween(
        Window.unboundedPreceding, 0)
    if single:
        ranked = bucketed.withColumn("upto", F.sum("n").over(upto))
    else:
        # one row per bucket: bounded by MAX_BUCKETS, so the window over it is small
        totals = bucketed.groupBy("bucket").agg(F.sum("n").alias("in_bucket"))
        before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(
            "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("offset"))
        ranked = (bucketed.join(F.broadcast(offsets), "bucket")
                  .withColumn("upto", F.sum("n").over(upto) + F.col("offset")))
    tests = F.lit(float(m))
    ranked = (ranked
              .withColumn("step_up", F.col("p") * tests / F.col("upto"))
              # ties are left out of Holm's rank: the first of equal values counts
              .withColumn("step_down", F.col("p") * (tests - (F.col("upto") - F.col("n")))))
    low = F.min("step_up").over(onward)
    high = F.max("step_down").over(upto)
    if not single:
        edges = ranked.groupBy("bucket").agg(
            F.min("step_up").alias("lowest"), F.max("step_down").alias("highest"))
        after = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
        before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        edges = edges.select("bucket", F.min("lowest").over(after).alias("later_low"),
                             F.max("highest").over(before).alias("earlier_high"))
        ranked = ranked.join(F.broadcast(edges), "bucket")
        # least and greatest skip the NULL of the first and last bucket, as wanted here
        low, high = F.least(low, F.col("later_low")), F.greatest(high, F.col("earlier_high"))
    one = F.lit(1.0)
    scaled = ranked.select("p", "n", low.alias("low"), high.alias("high"))
    return scaled.select(
        "p", "n",
        F.least("low", one).alias("bh"),
        F.least(F.col("low") * F.lit(harmonic(m)), one).alias("by"),
        F.least(F.col("p") * tests, one).alias("bonferroni"),
        F.least("high", one).alias("holm"))


def adjust(df: DataFrame, source: str, outputs: dict[str, str], reject_at: float | None = None,
           bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add adjusted columns ``{output: method}`` computed from ``source`` in one go.

    With ``reject_at``, a BOOLEAN ``<output>_reject`` is added per output.
    """
    unknown = set(outputs.values()) - set(METHODS)
    if unknown:
        raise ValueError(f"unknown methods {sorted(unknown)}; known: {METHODS}")
    work = df.withColumn("__p", prepared_p(df, source))
    found = adjusted_values(work.select(F.col("__p").alias("p")), bucket_rows)
    methods = sorted(set(outputs.values()))
    lookup = found.table.select(
        F.col("p").alias("__p"), F.col("n").alias("__n"), *[F.col(k).alias(f"__{k}") for k in methods])
    spread = F.struct(*[quoted(c) for c in df.columns])
    joined = attach_by_number(work, lookup, "__p", "__n", spread, found.tests, found.distinct)
    added = []
    for out, method in outputs.items():
        added.append(F.col(f"__{method}").alias(out))
        if reject_at is not None:
            added.append((F.col(f"__{method}") <= reject_at).alias(f"{out}_reject"))
    return joined.select(*[quoted(c) for c in df.columns if c not in outputs], *added)
