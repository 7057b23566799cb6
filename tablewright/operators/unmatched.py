"""What became of the columns of a table that was rewritten, without a key and whatever the order of its rows.

Each column of either table gets, in one pass, a signature of its values as a multiset, and a sketch: the
smallest hashes of its distinct values. Equal signatures are the same column, under whatever name; sketches tell
how many of a column's values another one holds, exactly while both have no more values than a sketch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.operators.clean import quoted
from tablewright.plans.schema import ROW_ID

SKETCH = 1024
FATES = ("kept", "renamed", "changed", "missing", "new")


def _value(df: DataFrame, name: str) -> Column:
    """The value as text; numbers that are written differently are the same value, and so are spaces around a text."""
    text = F.trim(quoted(name).cast("string"))
    number = text.try_cast("double")
    return F.coalesce(F.when(~F.isnan(number), (number + F.lit(0.0)).cast("string")), text)


def column_values(df: DataFrame, key: str | None = ROW_ID, sketch: int = SKETCH) -> tuple[DataFrame, DataFrame]:
    """((column, position, rows, nulls, signature), (column, hash)): signatures, and the sketches one hash a row.

    Tasks keep the ``sketch`` smallest hashes of a column; those of all tasks are cut again in two steps, so no task
    receives more than the square root of them for a column.
    """
    names = [c for c in df.columns if c != key]
    hashes = [F.when(quoted(c).isNotNull(), F.xxhash64(_value(df, c))).alias(f"h{i}") for i, c in enumerate(names)]
    rows = [F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col(f"h{i}").isNull()).alias("nulls"),
                     F.coalesce(F.sum(F.col(f"h{i}").cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)")).alias("signature")) for i, c in enumerate(names)]
    hashed = df.select(*hashes)
    signatures = hashed.agg(F.array(*rows).alias("all")).select(F.inline("all"))

    def smallest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [np.zeros(0, np.int64)] * len(names)
        for batch in batches:
            for i in range(len(names)):
                held[i] = np.union1d(held[i], batch[f"h{i}"].dropna().to_numpy(np.int64))[:sketch]
        for i, values in enumerate(held):
            yield pd.DataFrame({"column": names[i], "hash": values})

    # NULLs would make floats of the hashes, so a hash travels as a text of digits
    texts = hashed.select(*[F.col(f"h{i}").cast("string").alias(f"h{i}") for i in range(len(names))])
    parts = texts.mapInPandas(smallest, "column string, hash long").withColumn("part", F.spark_partition_id() % 64)
    for by in (["column", "part"], ["column"]):
        parts = parts.groupBy(*by).agg(F.slice(F.array_sort(F.collect_set("hash")), 1, sketch).alias("hashes")).select(*by, F.explode("hashes").alias("hash"))
    return signatures, parts


def column_fates(before: DataFrame, after: DataFrame, key: str | None = ROW_ID, least: float = 0.5, sketch: int = SKETCH) -> DataFrame:
    """(column, fate, found, share): one row per column of ``before``, and one per column of ``after`` that none of those became.

    ``kept``: the same values under the same name. ``renamed``: the same values under another name; of several, the
    first that is not a column of its own. ``changed``: ``found`` holds at least ``least`` of its distinct values, the
    same name first, then the largest share. ``missing``: none does. ``share`` is that of distinct values found.
    """
    left, left_sketch = column_values(before, key, sketch)
    right, right_sketch = column_values(after, key, sketch)
    # a few rows per column from here on
    a = left.select(F.col("column"), "position", "rows", "nulls", "signature")
    b = right.select(F.col("column").alias("found"), F.col("position").alias("place"), F.col("rows").alias("found_rows"),
                     F.col("nulls").alias("found_nulls"), F.col("signature").alias("found_signature"))
    same = a.join(b, (F.col("rows") == F.col("found_rows")) & (F.col("nulls") == F.col("found_nulls")) & (F.col("signature") == F.col("found_signature")))
    own = same.where(F.col("column") == F.col("found")).select(F.col("found").alias("taken"))
    free = same.join(own, F.col("found") == F.col("taken"), "left_anti")
    exact = same.where(F.col("column") == F.col("found")).unionByName(free).groupBy("column").agg(
        F.min_by("found", F.struct((F.col("column") != F.col("found")).alias("other"), "place")).alias("found"))
    exact = exact.select("column", F.when(F.col("column") == F.col("found"), "kept").otherwise("renamed").alias("fate"), "found", F.lit(1.0).alias("share"))
    open_ = a.join(exact, "column", "left_anti").select("column")
    shares = _shares(left_sketch.join(open_, "column"), right_sketch.join(exact.select(F.col("found").alias("column")), "column", "left_anti"), sketch)
    best = Window.partitionBy("column").orderBy((F.col("column") == F.col("found")).desc(), F.col("share").desc(), "found")
    near = shares.where(F.col("share") >= least).withColumn("n", F.row_number().over(best)).where("n = 1").select(
        "column", F.lit("changed").alias("fate"), "found", "share")
    gone = open_.join(near, "column", "left_anti").select("column", F.lit("missing").alias("fate"), F.lit(None).cast("string").alias("found"), F.lit(0.0).alias("share"))
    matched = exact.unionByName(near).unionByName(gone)
    new = b.join(matched.select("found"), "found", "left_anti").select(F.col("found").alias("column"), F.lit("new").alias("fate"), F.col("found"), F.lit(0.0).alias("share"))
    return matched.unionByName(new)


def _shares(left: DataFrame, right: DataFrame, sketch: int) -> DataFrame:
    """(column, found, share): the estimated share of the distinct values of a column that another one holds."""
    ends = lambda df, name: df.groupBy("column").agg(F.count("hash").alias(f"{name}_n"), F.max("hash").alias(f"{name}_last"))
    common = left.join(right.withColumnRenamed("column", "found"), "hash")
    pairs = common.join(ends(left, "a"), "column").join(ends(right, "b").withColumnRenamed("column", "found"), "found")
    # below the smaller end of the two sketches both are complete; a sketch that is not full has no end
    limit = F.least(F.when(F.col("a_n") == sketch, F.col("a_last")), F.when(F.col("b_n") == sketch, F.col("b_last")))
    seen = pairs.withColumn("limit", F.coalesce(limit, F.lit(2 ** 63 - 1))).where(F.col("hash") <= F.col("limit"))
    counted = seen.groupBy("column", "found", "limit").agg(F.count(F.lit(1)).alias("both"))
    within = counted.join(left, "column").where(F.col("hash") <= F.col("limit")).groupBy("column", "found").agg(
        F.first("both").alias("both"), F.count(F.lit(1)).alias("all"))
    return within.select("column", "found", (F.col("both") / F.col("all")).alias("share"))
