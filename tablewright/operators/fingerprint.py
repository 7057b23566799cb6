"""Structural fingerprints: tokens that describe each column of a table, and the table itself.

Works for one table, or for many variants of one table at once (``by`` names the variant key):
all variants share the same passes, so a sweep of hundreds of variants is still a few jobs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tablewright.functions.text import matches_from_start
from tablewright.operators.clean import quoted
from tablewright.plans.schema import ROW_ID
from tablewright.session import materialise

# Substrings of column names and the name token they give.
NAME_WORDS = {
    "GENE": ["gene", "symbol", "name", "id"],
    "PVALUE": ["pval", "p_val", "p-val", "pvalue", "p_value", "significance"],
    "FOLDCHANGE": ["fold", "fc", "log2fc", "logfc", "ratio", "change"],
    "EXPRESSION": ["expr", "expression", "level", "count", "fpkm", "tpm", "rpkm"],
    "SAMPLE": ["sample", "patient", "subject", "case"],
}
ONE_TABLE = "table"


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.IntegralType):
        return "INT"
    if isinstance(dtype, (T.FractionalType, T.DecimalType)):
        return "FLOAT"
    if isinstance(dtype, T.BooleanType):
        return "BOOL"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "DATETIME"
    if isinstance(dtype, T.DayTimeIntervalType):
        return "TIMEDELTA"
    return "STRING" if isinstance(dtype, T.StringType) else "UNKNOWN"


def name_tokens(name: str) -> list[str]:
    lowered = name.lower()
    return [f"NAME_{token}" for token, words in NAME_WORDS.items() if any(w in lowered for w in words)]


def _long(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """(by, key, position, x DOUBLE, s STRING, t STRING): every cell once, in ``x`` or in ``s``.

    ``t`` repeats ``s`` for text columns only. NaN and NULL both have no value.
    """
    cells = []
    for i, name in enumerate(_columns(df, by, key)):
        dtype = df.schema[name].dataType
        c = quoted(name)
        x, s = F.lit(None).cast("double"), F.lit(None).cast("string")
        if isinstance(dtype, (T.NumericType, T.BooleanType)):
            x = c.cast("double")
            if isinstance(dtype, (T.DoubleType, T.FloatType)):
                x = F.when(~F.isnan(x), x + F.lit(0.0))
        else:
            s = c.cast("string")
        cells.append(F.struct(F.lit(i).alias("position"), x.alias("x"), s.alias("s"),
                              (s if isinstance(dtype, T.StringType) else F.lit(None).cast("string")).alias("t")))
    keys = [F.col(k) for k in by] + ([F.col(key)] if key in df.columns else [])
    return df.select(*keys, F.inline(F.array(*cells)))


def _columns(df: DataFrame, by: list[str], key: str) -> list[str]:
    return [c for c in df.columns if c != key and c not in by]


def column_facts(df: DataFrame, by: list[str] | None = None, key: str = ROW_ID, sample_rows: int | None = None) -> DataFrame:
    """Measured facts per (by, column): counts, distinct values, moments, lengths, shares of the texts.

    The shares look at all texts. With ``sample_rows`` they look at that many non-null texts from the
    start, in the order of ``key``, which then has to be there.
    """
    by = list(by or [])
    names = _columns(df, by, key)
    long = _long(df, by, key)
    group = [*by, "position"]
    x, s, t = F.col("x"), F.col("s"), F.col("t")
    n = F.count(x) + F.count(s)
    nx = F.count(x).cast("double")
    stats = long.groupBy(*group).agg(
        F.count(F.lit(1)).alias("rows"), n.alias("n"),
        F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        # Spark's skewness is the biased one; this is the bias-corrected estimate
        F.when(nx > 2, F.skewness(x) * F.sqrt(nx * (nx - 1)) / (nx - 2)).alias("skew"),
        F.avg((x < 0.05).cast("double")).alias("small_share"),
        F.avg(F.length(t)).alias("mean_length"), *([] if sample_rows else _text_shares(t)))
    filled = long.where(x.isNotNull() | s.isNotNull())
    distinct = (filled.groupBy(*group, "x", "s").agg(F.lit(1).alias("seen"))
                .groupBy(*group).agg(F.count(F.lit(1)).alias("distinct_values")))
    facts = stats.join(distinct, group, "left")
    if sample_rows:
        order = Window.partitionBy(*group).orderBy(key)
        first = long.where(t.isNotNull()).withColumn("at", F.row_number().over(order)).where(F.col("at") <= sample_rows)
        facts = facts.join(first.groupBy(*group).agg(*_text_shares(t)), group, "left")
    labels = F.create_map(*[v for i, c in enumerate(names) for v in (F.lit(i), F.lit(c))])
    kinds = F.create_map(*[v for i, c in enumerate(names)
                           for v in (F.lit(i), F.lit(kind_of(df.schema[c].dataType)))])
    nulls = F.col("rows") - F.col("n")
    kind = F.element_at(kinds, F.col("position"))
    return facts.select(
        *by, "position", F.element_at(labels, F.col("position")).alias("column"),
        # an integer column with gaps is a float column in the reader this mirrors
        F.when((kind == "INT") & (nulls > 0), F.lit("FLOAT")).otherwise(kind).alias("kind"),
        "rows", "n", (nulls / F.col("rows")).alias("null_ratio"),
        F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"),
        F.when(F.col("n") > 0, F.coalesce("distinct_values", F.lit(0)) / F.col("n")).alias("unique_ratio"),
        "min", "max", "mean", "std", "skew", "small_share", "mean_length",
        "upper_share", "digit_share", "special_share", "symbol_share")


def _text_shares(t: Column) -> list[Column]:
    """Shares of the non-null texts."""
    tests = {"upper_share": (t == F.upper(t)) & (t != F.lower(t)), "digit_share": t.rlike(r"\d"),
             "special_share": t.rlike(r"[^A-Za-z0-9\s]"), "symbol_share": matches_from_start(t, r"^[A-Z][A-Z0-9]{1,10}$")}
    return [F.avg(test.cast("double")).alias(name) for name, test in tests.items()]


def null_token(ratio: Column) -> Column:
    return (F.when(ratio == 0, "NO_NULLS").when(ratio < 0.1, "FEW_NULLS")
            .when(ratio < 0.5, "SOME_NULLS").otherwise("MANY_NULLS"))


def cardinality_token(ratio: Column) -> Column:
    return F.when(ratio.isNotNull(), F.when(ratio < 0.01, "CONSTANT").when(ratio < 0.1, "LOW_CARD")
                  .when(ratio < 0.5, "MED_CARD").when(ratio < 0.95, "HIGH_CARD").otherwise("UNIQUE"))


def sign_token(low: Column, high: Column) -> Column:
    return F.when(low.isNotNull(), F.when((low >= 0) & (high <= 1), "RANGE_0_1").when(low >= 0, "POSITIVE")
                  .when(high <= 0, "NEGATIVE").otherwise("MIXED_SIGN"))


def spread_token(low: Column, high: Column) -> Column:
    return F.when(high - low > 1_000_000, "LARGE_RANGE").when(high - low < 1, "SMALL_RANGE")


def skew_token(std: Column, skew: Column) -> Column:
    # two values have no skew estimate; the comparison chain then ends at the last token
    return F.when(std > 0, F.when(F.abs(skew) < 0.5, "SYMMETRIC").when(skew > 0, "RIGHT_SKEW")
                  .otherwise("LEFT_SKEW"))


def p_value_token(low: Column, high: Column, small: Column) -> Column:
    return F.when((low >= 0) & (high <= 1) & (small > 0.1), "PVALUE_PATTERN")


def length_token(mean: Column) -> Column:
    return F.when(mean.isNotNull(), F.when(mean < 5, "SHORT_STR").when(mean < 20, "MED_STR").otherwise("LONG_STR"))


def case_token(upper: Column) -> Column:
    return F.when(upper.isNotNull(), F.when(upper > 0.8, "UPPERCASE").when(upper < 0.2, "LOWERCASE")
                  .otherwise("MIXEDCASE"))


def content_tokens(digit: Column, special: Column, symbol: Column) -> list[Column]:
    return [F.when(digit > 0.5, "HAS_NUMBERS"), F.when(special > 0.3, "HAS_SPECIAL"),
            F.when(symbol > 0.5, "GENE_PATTERN")]


def column_tokens(facts: DataFrame, names: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, position, column, tokens ARRAY<STRING>), tokens in their fixed order."""
    f = F.col
    measured = [
        f("kind"), null_token(f("null_ratio")), cardinality_token(f("unique_ratio")),
        sign_token(f("min"), f("max")), spread_token(f("min"), f("max")), skew_token(f("std"), f("skew")),
        p_value_token(f("min"), f("max"), f("small_share")),
        length_token(f("mean_length")), case_token(f("upper_share")),
        *content_tokens(f("digit_share"), f("special_share"), f("symbol_share")),
    ]
    named = F.create_map(*[v for i, c in enumerate(names) for v in (
        F.lit(i), F.array(*[F.lit(t) for t in name_tokens(c)]).cast("array<string>"))])
    prefix = F.concat(F.lit("COL_"), f("position").cast("string"), F.lit("_"))
    bare = F.concat(F.array_compact(F.array(*measured)), F.element_at(named, f("position")))
    return facts.select(*(by or []), "position", "column",
                        F.transform(bare, lambda t: F.concat(prefix, t)).alias("tokens"))


def table_tokens(facts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, tokens): size, type mix and missing share of the whole table."""
    by = list(by or [])
    rows, cols = F.max("rows"), F.count(F.lit(1))
    numeric = F.avg(F.col("kind").isin("INT", "FLOAT").cast("double"))
    missing = F.sum(F.col("rows") - F.col("n")) / F.sum("rows")
    measured = facts.groupBy(*by).agg(
        rows.alias("rows"), cols.alias("cols"), numeric.alias("numeric"), missing.alias("missing"))
    f = F.col
    return measured.select(*by, F.array(
        F.when(f("rows") < 100, "DF_SMALL_ROWS").when(f("rows") < 10000, "DF_MED_ROWS").otherwise("DF_LARGE_ROWS"),
        F.when(f("cols") < 5, "DF_FEW_COLS").when(f("cols") < 20, "DF_MED_COLS").otherwise("DF_MANY_COLS"),
        F.when(f("numeric") > 0.8, "DF_MOSTLY_NUMERIC").when(f("numeric") < 0.2, "DF_MOSTLY_STRING")
        .otherwise("DF_MIXED_TYPES"),
        F.when(f("missing") < 0.01, "DF_CLEAN").when(f("missing") < 0.1, "DF_SOME_MISSING")
        .otherwise("DF_MANY_MISSING")).alias("tokens"))


def table_shape(facts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, rows, columns, numeric_ratio, null_ratio)."""
    return facts.groupBy(*(by or [])).agg(
        F.max("rows").alias("rows"), F.count(F.lit(1)).alias("columns"),
        F.avg(F.col("kind").isin("INT", "FLOAT").cast("double")).alias("numeric_ratio"),
        (F.sum(F.col("rows") - F.col("n")) / F.sum("rows")).alias("null_ratio"))


def fingerprint(df: DataFrame, by: list[str] | None = None, key: str = ROW_ID) -> DataFrame:
    """(by, tokens, token_string): column tokens in column order, then the table tokens.

    The gathered list has a few tokens per column, never anything per row.
    """
    by = list(by or [])
    # a row per column; both kinds of tokens read it
    facts = materialise(column_facts(df, by, key), "facts")
    names = _columns(df, by, key)
    per_column = column_tokens(facts, names, by).select(*by, "position", "tokens")
    overall = table_tokens(facts, by).select(*by, F.lit(len(names)).alias("position"), "tokens")
    both = per_column.unionByName(overall)
    ordered = F.sort_array(F.collect_list(F.struct("position", "tokens")))
    tokens = both.groupBy(*by).agg(F.flatten(F.transform(ordered, lambda s: s["tokens"])).alias("tokens"))
    return tokens.select(*by, "tokens", F.array_join("tokens", " ").alias("token_string"))


def first_tokens(tokens: Column, n: int = 100) -> Column:
    return F.slice(tokens, 1, n)
