"""Repeatable random draws taken from an MD5 digest of the cell's address.

A digest gives four independent 32-bit lanes. A draw depends on the key only, so a retried
task, another partitioning or another engine gets the same value.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LANES = 4
SPAN = 1 << 32


def digest(*parts: Column | str | int) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def lane(hexed: Column, i: int) -> Column:
    """Lane ``i`` (0-3) of a digest as an integer in [0, 2^32)."""
    return F.conv(F.substring(hexed, 8 * i + 1, 8), 16, 10).cast("bigint")


def unit(hexed: Column, i: int) -> Column:
    """Lane ``i`` as a number in [0, 1)."""
    return lane(hexed, i) / F.lit(float(SPAN))


def pick(n: Column | int, hexed: Column, i: int) -> Column:
    """Lane ``i`` as an integer in [0, n)."""
    return F.pmod(lane(hexed, i), F.lit(n) if isinstance(n, int) else n).cast("int")
