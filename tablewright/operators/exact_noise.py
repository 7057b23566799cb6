"""Noise that touches an exact number of cells, chosen without replacement by a digest of their place.

Each cell has a priority, -ln(u) / weight, u being a digest of seed, row key and column: the cells of the n least
priorities are a weighted sample without replacement, the same on every cluster. The n-th priority is found by
narrowing: a count by 65 536 ranges, then by as many parts of the range that it falls into. A few passes over the keys
find it, and no cell is ever sorted or sent anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.operators.noise import NoiseSettings, inject, noise_log, noisy_columns
from tablewright.plans.schema import ROW_ID

RANGES = 1 << 16
#: priorities are counted in parts of this
UNIT = float(1 << 40)
DIGITS = 13
#: cells of one priority that may be told apart by row key; more mean that the key repeats
TIES = 10_000


@dataclass(frozen=True)
class Choice:
    """Which cells are touched: those below ``limit``, and of those at it the listed ones."""

    wanted: int
    weights: dict[str, float]
    limit: int
    at_limit: tuple[str, ...]

    def condition(self) -> Callable[[Column, Column, Column], Column]:
        names = list(self.weights)
        if not names or not self.wanted:
            return lambda prefix, column, position: F.lit(False)
        shares = F.create_map(*[F.lit(x) for kv in self.weights.items() for x in kv])

        def chosen(prefix: Column, column: Column, position: Column) -> Column:
            p = priority(prefix, column, F.element_at(shares, column))
            ties = F.concat_ws("|", prefix, column).isin(list(self.at_limit)) if self.at_limit else F.lit(False)
            return (p < self.limit) | ((p == self.limit) & ties)

        return chosen


def priority(prefix: Column, column: Column, weight: Column) -> Column:
    """A whole number, smaller for cells that go first."""
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", prefix, column, F.lit("choice"))), 1, DIGITS), 16, 10).cast("double")
    return F.floor(-F.log((digest + 1.0) / float(1 << 4 * DIGITS)) / weight * UNIT)


def exact_weights(settings: NoiseSettings, columns: list[str]) -> dict[str, float]:
    """Relative weights of the columns whose cells may be touched; the largest is 1."""
    if settings.mode == "targeted":
        return {c: 1.0 for c in columns if c in settings.targets}
    if settings.mode == "weighted":
        weights = {c: settings.weights.get(c, 1.0) for c in columns}
        most = max(weights.values(), default=0.0)
        return {c: w / most for c, w in weights.items() if w > 0}
    return {c: 1.0 for c in columns}


def choose(df: DataFrame, settings: NoiseSettings, key: str = ROW_ID) -> Choice:
    """The cells that a ratio of all cells touches: floor(ratio * rows * columns), or all that may be touched where these are fewer.

    The key must tell rows apart.
    """
    columns = noisy_columns(df, key, None, None)
    weights = exact_weights(settings, columns)
    rows = df.count()
    # the ratio as it is written: 0.1 of 30 is 3
    wanted = min(math.floor(round(settings.ratio * rows * len(columns), 6)), rows * len(weights))
    if not wanted:
        return Choice(0, weights, 0, ())
    prefix = F.concat_ws("|", F.lit(str(settings.seed)), F.col(key).cast("string"))
    listed = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(w).alias("weight")) for c, w in weights.items()])
    cells = df.select(prefix.alias("prefix"), F.explode(listed).alias("c")).select(
        "prefix", "c.column", priority(F.col("prefix"), F.col("c.column"), F.col("c.weight")).alias("p"))
    low, high, left = 0, int(4 * DIGITS * math.log(2) / min(weights.values()) * UNIT) + 2, wanted
    while high - low > 1:
        width = max(1, -(-(high - low) // RANGES))
        found = cells.where((F.col("p") >= low) & (F.col("p") < high)).groupBy(F.floor((F.col("p") - low) / F.lit(width)).alias("at")).count().orderBy("at")
        for r in found.collect():  # at most RANGES rows
            if left <= r["count"]:
                low, high = low + r["at"] * width, min(high, low + (r["at"] + 1) * width)
                break
            left -= r["count"]
        if left == r["count"]:  # the whole range is taken, so it need not be cut further
            return Choice(wanted, weights, high, ())
    ties = [f"{r.prefix}|{r.column}" for r in cells.where(F.col("p") == low).orderBy("prefix", "column").limit(TIES + 1).collect()]
    if len(ties) > TIES or len(set(ties)) < len(ties):
        raise ValueError(f"{key} does not tell rows apart")
    return Choice(wanted, weights, low, tuple(ties[:left]))


def inject_exact(df: DataFrame, settings: NoiseSettings, key: str = ROW_ID, choice: Choice | None = None) -> DataFrame:
    """The corrupted table, with exactly the chosen cells touched. Columns that may be touched become STRING."""
    return inject(df, settings, key, chosen=(choice or choose(df, settings, key)).condition())


def exact_log(df: DataFrame, settings: NoiseSettings, key: str = ROW_ID, choice: Choice | None = None) -> DataFrame:
    """One row per touched cell, as ``noise_log``."""
    return noise_log(df, settings, key, chosen=(choice or choose(df, settings, key)).condition())
