"""Arithmetic expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LOG_FLOOR = 1e-10


def _floored(x: Column) -> Column:
    # greatest() skips NULL, so the guard keeps NULL as NULL
    return F.when(x.isNotNull(), F.greatest(x, F.lit(LOG_FLOOR)))


def log2(x: Column) -> Column:
    return F.log2(_floored(x))


def log10(x: Column) -> Column:
    return F.log10(_floored(x))


def round_half_even(x: Column) -> Column:
    return F.rint(x)


def clamp(x: Column, low: float | None, high: float | None) -> Column:
    """Limit to [low, high]; NULL stays NULL."""
    out = x
    if high is not None:
        out = F.when(x > F.lit(float(high)), F.lit(float(high))).otherwise(out)
    if low is not None:
        out = F.when(x < F.lit(float(low)), F.lit(float(low))).otherwise(out)
    return out
