"""Column profiles as stored state that merges: parts of a table, snapshots and batches are read once each.

The state of a column is one row: counts and extremes, central moments, a HyperLogLog sketch of the distinct
values, a KLL sketch of the numbers, and a frequent-items sketch of the values as text. States of any parts merge to the
state of the whole; counts, extremes and moments exactly, sketches within their stated errors:

    distinct    1.04 / sqrt(2^precision), 0.8 % at the default of 14; nearly exact below some thousand values
    quantiles   rank error of about 1.33 % at k = 200, falling almost as 1 / k: 0.04 % at the default of 8192
    top values  counts are exact while a column has at most 3/4 ``tracked`` values
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewright.operators.clean import data_columns, quoted

PRECISION = 14
KLL_K = 8192
TRACKED = 10_000


def _numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def profile_state(df: DataFrame, part: str, columns: list[str] | None = None, precision: int = PRECISION, kll_k: int = KLL_K,
                  tracked: int = TRACKED) -> DataFrame:
    """(part, column, dtype, rows, nulls, least, largest, n, mean, m2, m3, distinct, numbers, frequent) of each column.

    Everything comes from one aggregation over ``df`` that reads only these columns. NaN counts as missing.
    ``least`` and ``largest`` are texts of the column's own order; numbers have moments and ``numbers``, other columns NULL.
    """
    names = columns or data_columns(df)
    for c in names:
        if not isinstance(df.schema[c].dataType, T.AtomicType):
            raise ValueError(f"column {c} is no plain value")
    values = []
    for i, c in enumerate(names):
        value = quoted(c)
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            value = F.when(~F.isnan(value), value + F.lit(0.0))
        values += [value.alias(f"v{i}"), value.cast("string").alias(f"t{i}")]
        if _numeric(df, c):
            values.append(value.cast("double").alias(f"d{i}"))
    dtypes = dict(df.dtypes)
    states = []
    for i, c in enumerate(names):
        v, t, number = F.col(f"v{i}"), F.col(f"t{i}"), _numeric(df, c)
        d = F.col(f"d{i}") if number else None
        n = F.count(v)
        # power sums around the mean, by the engine's own stable moments
        variance = F.var_pop(d) * n if number else F.lit(None).cast("double")
        third = F.when(F.stddev_pop(d) > 0, F.skewness(d) * F.pow(F.stddev_pop(d), 3) * n).otherwise(F.when(n > 0, 0.0)) if number else F.lit(None).cast("double")
        states.append(F.struct(
            F.lit(part).alias("part"), F.lit(c).alias("column"), F.lit(dtypes[c]).alias("dtype"), F.count(F.lit(1)).alias("rows"),
            (F.count(F.lit(1)) - n).alias("nulls"), F.min(v).cast("string").alias("least"), F.max(v).cast("string").alias("largest"), n.alias("n"),
            (F.avg(d) if number else F.lit(None).cast("double")).alias("mean"), variance.alias("m2"), third.alias("m3"),
            F.hll_sketch_agg(t, precision).alias("distinct"),
            (F.kll_sketch_agg_double(d, kll_k) if number else F.lit(None).cast("binary")).alias("numbers"),
            F.expr(f"approx_top_k_accumulate(t{i}, {tracked})").alias("frequent")))
    return df.select(*values).agg(F.array(*states).alias("all")).select(F.inline("all"))


def _ordered(kind: Column, text: Column) -> Column:
    """A text of a column in a form that sorts as the column does: numbers as numbers, everything else as text."""
    number = kind.rlike(r"^(tinyint|smallint|int|bigint|float|double|decimal.*)$")
    # whole numbers of 64 bits and decimals keep their digits
    exact = F.when(number, F.coalesce(text.try_cast("decimal(38,18)").cast("double"), text.try_cast("double")))
    return F.struct(exact.alias("number"), F.when(number, text.try_cast("decimal(38,0)")).alias("digits"), text.alias("text"))


def merge_states(states: DataFrame, part: str = "all") -> DataFrame:
    """One state per column, of all the parts together. Parts must not overlap; merged states merge again."""
    key = ["column", "dtype"]
    means = states.groupBy(*key).agg((F.sum(F.col("n") * F.col("mean")) / F.nullif(F.sum(F.when(F.col("mean").isNotNull(), F.col("n"))), F.lit(0))).alias("centre"))
    # a row per column and part; the centre is one row per column
    around = states.join(means, key).withColumn("off", F.col("mean") - F.col("centre"))
    off, n = F.col("off"), F.col("n")
    bounded = around.withColumns({c: F.when(F.col(c).isNotNull(), _ordered(F.col("dtype"), F.col(c))) for c in ("least", "largest")})
    return bounded.groupBy(*key).agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.min("least")["text"].alias("least"), F.max("largest")["text"].alias("largest"),
        F.sum("n").alias("n"), F.first("centre").alias("mean"), F.sum(F.col("m2") + n * off * off).alias("m2"),
        F.sum(F.col("m3") + 3 * off * F.col("m2") + n * off * off * off).alias("m3"), F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_double("numbers").alias("numbers"), F.expr("approx_top_k_combine(frequent)").alias("frequent")
    ).select(F.lit(part).alias("part"), "column", "dtype", "rows", "nulls", "least", "largest", "n", "mean", "m2", "m3", "distinct", "numbers", "frequent")


def read_profile(states: DataFrame, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75), top: int = 3, tracked: int = TRACKED) -> DataFrame:
    """(part, column, dtype, rows, nulls, distinct_values, least, largest, mean, std, skew, quantiles, top_values).

    ``std`` divides by n - 1 and ``skew`` is corrected for the sample, as in the exact profile; both are NULL for too few values.
    ``tracked`` is that of the states; equal counts go by value as long as a column has no more values than 3/4 of it.
    """
    n, m2, m3 = F.col("n"), F.col("m2"), F.col("m3")
    std = F.when(n > 1, F.sqrt(m2 / (n - 1)))
    skew = F.when((n > 2) & (m2 > 0), F.sqrt(n * (n - 1)) / (n - 2) * (m3 / n) / F.pow(m2 / n, 1.5))
    # a column without numbers has an empty sketch after a merge
    points = F.when(F.col("mean").isNotNull(), F.kll_sketch_get_quantile_double("numbers", F.lit(list(quantiles))))
    # all that is tracked is asked for, as ties of a count go by value
    best = F.array_sort(F.expr(f"approx_top_k_estimate(frequent, {tracked})"), lambda a, b: F.when(
        a["count"] != b["count"], F.when(a["count"] > b["count"], -1).otherwise(1)).otherwise(F.when(a["item"] < b["item"], -1).when(a["item"] > b["item"], 1).otherwise(0)))
    return states.select("part", "column", "dtype", "rows", "nulls", F.hll_sketch_estimate("distinct").alias("distinct_values"), "least", "largest", "mean",
                         std.alias("std"), skew.alias("skew"), points.alias("quantiles"), F.slice(F.filter(best, lambda x: x["item"].isNotNull()), 1, top).alias("top_values"))
