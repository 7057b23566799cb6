import datetime as dt
import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tablewright.operators.profile_state import merge_states, profile_state, read_profile

SCHEMA = "k bigint, x double, big bigint, t string, d date, ok boolean, money decimal(20,2)"


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, None if i % 11 == 0 else float("nan") if i % 13 == 0 else (i * 37 % 101) / 4 - 9, 2 ** 62 + i, None if i % 5 == 0 else f"v{i % 9}",
             dt.date(2024, 1, 1) + dt.timedelta(days=i % 40), i % 3 == 0, Decimal(i * 3)) for i in range(900)]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def shown(states):
    return {r["column"]: r for r in read_profile(states, (0.1, 0.5, 0.9), top=4).collect()}


def test_parts_merge_to_the_whole(rows):
    whole = shown(profile_state(rows, "whole"))
    parts = [profile_state(rows.where(f"k % 4 = {p}"), f"p{p}") for p in range(4)]
    pairs = merge_states(parts[0].unionByName(parts[1])), merge_states(parts[2].unionByName(parts[3]))
    for merged in (shown(merge_states(pairs[0].unionByName(pairs[1]))), shown(merge_states(profile_state(rows, "whole")))):
        assert merged.keys() == whole.keys()
        for c, w in whole.items():
            m = merged[c]
            assert all(m[f] == w[f] for f in ("dtype", "rows", "nulls", "least", "largest", "quantiles", "top_values"))
            assert m["distinct_values"] == pytest.approx(w["distinct_values"], rel=0.01)
            # doubles hold no difference between numbers of this size
            assert c == "big" or all((m[f] is None) == (w[f] is None) and (m[f] is None or m[f] == pytest.approx(w[f], rel=1e-9, abs=1e-9)) for f in ("mean", "std", "skew"))


def test_values_of_the_profile(rows):
    got = shown(merge_states(profile_state(rows.where("k < 500"), "a").unionByName(profile_state(rows.where("k >= 500"), "b"))))
    xs = sorted(v for v in (r["x"] for r in rows.collect()) if v is not None and not math.isnan(v))
    x, n = got["x"], len(xs)
    mean = sum(xs) / n
    m2, m3 = (sum((v - mean) ** p for v in xs) for p in (2, 3))
    assert (x["rows"], x["nulls"]) == (900, 900 - n)
    assert (float(x["least"]), float(x["largest"])) == (xs[0], xs[-1])
    assert x["mean"] == pytest.approx(mean) and x["std"] == pytest.approx(math.sqrt(m2 / (n - 1)))
    assert x["skew"] == pytest.approx(math.sqrt(n * (n - 1)) / (n - 2) * (m3 / n) / (m2 / n) ** 1.5)
    # fewer values than the sketch holds: every quantile is exact
    assert x["quantiles"] == [xs[math.ceil(p * n) - 1] for p in (0.1, 0.5, 0.9)]
    assert got["big"]["least"] == str(2 ** 62) and got["big"]["largest"] == str(2 ** 62 + 899)
    assert got["d"]["least"] == "2024-01-01" and got["t"]["mean"] is None and got["t"]["quantiles"] is None
    assert got["money"]["largest"] == "2697.00"
    assert [(v["item"], v["count"]) for v in got["ok"]["top_values"]] == [("false", 600), ("true", 300)]


def test_error_of_many_values(spark):
    """Beyond what sketches hold exactly they stay within the stated errors."""
    many = spark.range(200_000).select(((F.col("id") * 7919) % 150_001).alias("v"))
    parts = [profile_state(many.where(f"v % 3 = {p}"), f"p{p}") for p in range(3)]
    (r,) = read_profile(merge_states(parts[0].unionByName(parts[1]).unionByName(parts[2])), (0.25, 0.5, 0.99)).collect()
    assert r["distinct_values"] == pytest.approx(150_001, rel=4 * 1.04 / math.sqrt(1 << 14))
    for p, q in zip((0.25, 0.5, 0.99), r["quantiles"]):
        assert abs(many.where(F.col("v") <= q).count() / 200_000 - p) < 0.001


def test_empty_parts_and_odd_columns(spark, rows):
    none, some = profile_state(rows.where("k < 0"), "none"), profile_state(rows, "some")
    got, want = shown(merge_states(none.unionByName(some))), shown(some)
    assert all(got[c]["rows"] == 900 and got[c]["quantiles"] == want[c]["quantiles"] for c in want)
    empty = shown(merge_states(none))
    assert all(r["rows"] == 0 and r["mean"] is None and r["least"] is None and r["top_values"] == [] for r in empty.values())
    with pytest.raises(ValueError):
        profile_state(spark.createDataFrame([(["a"],)], "a array<string>"), "p")
