"""Exact quantiles without gathering a column in one task.

A sketch gives a narrow bracket around each wanted rank. Plain passes count what lies below, at and
between its bounds and sketch the inside again, until so few values are left that they can be ordered.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tablewright.operators.clean import quoted

SKETCH_ACCURACY = 10_000
#: values that one task orders at most, per quantile
FINISH_ROWS = 200_000


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def clean_double(df: DataFrame, name: str) -> Column:
    """Column as DOUBLE with NaN as NULL."""
    c = quoted(name).cast("double")
    return F.when(~F.isnan(c), c)


def bracket_aggregates(x: Column, probs: list[float], margin: float) -> Column:
    """Sketch quantiles just below and just above each probability, as one array aggregate."""
    shares = [s for q in probs for s in (max(q - margin, 0.0), min(q + margin, 1.0))]
    return F.percentile_approx(x, shares, SKETCH_ACCURACY)


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float],
                    sketch: dict[str, tuple[int, list[float]]] | None = None) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column. A handful of numbers per column reach the driver.

    ``sketch`` may carry (non-null count, bracket bounds) per column from an earlier pass.
    """
    margin = 2.0 / SKETCH_ACCURACY
    if sketch is None:
        sketch = _sketch(df, columns, probs, margin)
    brackets: dict[tuple[str, int], tuple[float, float]] = {}
    for c in columns:
        n, bounds = sketch[c]
        for i, q in enumerate(probs if n else []):
            for rank in (math.floor(q * (n - 1)), math.ceil(q * (n - 1))):
                brackets[c, rank] = (bounds[2 * i], bounds[2 * i + 1])
    values = _order_statistics(df, brackets, {c: sketch[c][0] for c in columns})
    out: dict[str, list[float | None]] = {}
    for c in columns:
        n = sketch[c][0]
        places = [q * (n - 1) for q in probs]
        out[c] = [values[c, math.floor(p)] + (values[c, math.ceil(p)] - values[c, math.floor(p)]) * (p - math.floor(p)) if n else None for p in places]
    return out


def _sketch(df: DataFrame, columns: list[str], probs: list[float], margin: float):
    aggs = []
    for i, c in enumerate(columns):
        x = clean_double(df, c)
        aggs += [F.count(x).alias(f"n{i}"), bracket_aggregates(x, probs, margin).alias(f"b{i}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"n{i}"], row[f"b{i}"] or []) for i, c in enumerate(columns)}


@dataclass(frozen=True)
class _Open:
    """What is known of a wanted value: it lies strictly between ``floor`` and ``ceil`` (None: unbounded).

    ``base`` values are not above the floor and ``top`` values are below the ceiling.
    """

    floor: float | None
    base: int
    ceil: float | None
    top: int

    def holds(self, x: Column) -> Column:
        test = x.isNotNull()
        if self.floor is not None:
            test = test & (x > F.lit(self.floor))
        return test & (x < F.lit(self.ceil)) if self.ceil is not None else test


def _order_statistics(df: DataFrame, brackets: dict[tuple[str, int], tuple[float, float]],
                      totals: dict[str, int]) -> dict[tuple[str, int], float]:
    """The value at each (column, rank), given a bracket of values around it.

    Each round counts exactly what lies below, at and between the bounds of the brackets, which settles a
    value or narrows the range it can lie in. A range of more than FINISH_ROWS values gets a new bracket from
    a sketch of those values alone; a smaller one is ordered. No task gets more.
    """
    names = {c: f"__x{i}" for i, c in enumerate(dict.fromkeys(c for c, _ in brackets))}
    numbers = df.select(*[clean_double(df, c).alias(x) for c, x in names.items()])
    values: dict[tuple[str, int], float] = {}
    known = {key: _Open(None, 0, None, totals[key[0]]) for key in brackets}
    while brackets:
        for key, (below, at_low, between, at_high) in _counts(numbers, names, brackets).items():
            (low, high), rank, range_ = brackets[key], key[1], known[key]
            upto_low, below_high = below + at_low, below + at_low + between
            if rank < below:
                known[key] = _Open(range_.floor, range_.base, low, below)
            elif rank < upto_low:
                values[key] = low
            elif rank < below_high:
                known[key] = _Open(low, upto_low, high, below_high)
            elif rank < below_high + at_high:
                values[key] = high
            else:
                known[key] = _Open(high, below_high + at_high, range_.ceil, range_.top)
        left = {k: r for k, r in known.items() if k in brackets and k not in values}
        small = {k: r for k, r in left.items() if r.top - r.base <= FINISH_ROWS}
        values |= _inside(numbers, names, small)
        brackets = _narrowed(numbers, names, {k: r for k, r in left.items() if k not in small})
    return values


def _counts(numbers: DataFrame, names: dict[str, str], brackets: dict) -> dict:
    """(below, at low, between, at high) of each bracket, in one pass."""
    tests, keys = [], list(brackets)
    for t, key in enumerate(keys):
        x, (low, high) = F.col(names[key[0]]), brackets[key]
        parts = (x < F.lit(low), x == F.lit(low), (x > F.lit(low)) & (x < F.lit(high)), (x == F.lit(high)) & F.lit(high > low))
        tests += [F.count_if(test).alias(f"c{t}_{j}") for j, test in enumerate(parts)]
    row = numbers.agg(*tests).first()
    return {key: tuple(row[f"c{t}_{j}"] for j in range(4)) for t, key in enumerate(keys)}


def _narrowed(numbers: DataFrame, names: dict[str, str], ranges: dict[tuple[str, int], _Open]) -> dict[tuple[str, int], tuple[float, float]]:
    """Brackets from a sketch of the values inside the ranges, in one pass."""
    if not ranges:
        return {}
    keys, sketches, margin = list(ranges), [], 2.0 / SKETCH_ACCURACY
    for t, key in enumerate(keys):
        r, x = ranges[key], F.col(names[key[0]])
        share = (key[1] - r.base + 0.5) / (r.top - r.base)
        sketches.append(F.percentile_approx(F.when(r.holds(x), x), [max(share - margin, 0.0), min(share + margin, 1.0)], SKETCH_ACCURACY).alias(f"s{t}"))
    row = numbers.agg(*sketches).first()
    return {key: tuple(row[f"s{t}"]) for t, key in enumerate(keys)}


def _inside(numbers: DataFrame, names: dict[str, str], ranges: dict[tuple[str, int], _Open]) -> dict[tuple[str, int], float]:
    """The values at their ranks, from ranges of at most FINISH_ROWS values each."""
    if not ranges:
        return {}
    keys = list(ranges)
    tests = [ranges[k].holds(F.col(names[k[0]])) for k in keys]
    near = tests[0]
    for test in tests[1:]:
        near = near | test
    slots = F.array(*[F.when(test, F.struct(F.lit(t).alias("slot"), F.col(names[k[0]]).alias("value")))
                      for t, (test, k) in enumerate(zip(tests, keys))])
    long = numbers.where(near).select(F.inline(F.filter(slots, lambda s: s.isNotNull())))
    counted = long.groupBy("slot", "value").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("slot").orderBy("value"))
    ranks = F.element_at(F.array(*[F.lit(k[1] - ranges[k].base).cast("bigint") for k in keys]), F.col("slot") + 1)
    hits = counted.withColumn("upto", upto).where((ranks < F.col("upto")) & (ranks >= F.col("upto") - F.col("n")))
    return {keys[r.slot]: r.value for r in hits.select("slot", "value").collect()}
