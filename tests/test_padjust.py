import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import keyed, padjust


def by_hand(p: np.ndarray) -> dict[str, np.ndarray]:
    m = len(p)
    order = np.argsort(p, kind="stable")
    s = p[order]
    i = np.arange(1, m + 1)
    bh = np.minimum.accumulate((s * m / i)[::-1])[::-1]
    out = {"bh": np.minimum(bh, 1), "by": np.minimum(bh * sum(1 / k for k in range(1, m + 1)), 1),
           "bonferroni": np.minimum(s * m, 1), "holm": np.minimum(np.maximum.accumulate(s * (m - i + 1)), 1)}
    back = np.empty(m, dtype=int)
    back[order] = np.arange(m)
    return {k: v[back] for k, v in out.items()}


def sample(n=1500):
    rng = np.random.default_rng(3)
    p = np.round(rng.beta(0.5, 3, n), 3)
    p[:n // 3] = 0.25  # one value holds a third of all rows
    return p


@pytest.mark.parametrize("bucket_rows", [100_000, 40, 7])
def test_equals_numpy_whatever_the_buckets(spark, bucket_rows):
    p = sample()
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "row_id bigint, p double").repartition(5)
    out = padjust.adjust(df, "p", {m: m for m in padjust.METHODS}, bucket_rows=bucket_rows).orderBy("row_id").toPandas()
    for method, want in by_hand(p).items():
        assert np.abs(out[method].to_numpy() - want).max() < 1e-12
        assert (out[method] >= p - 1e-12).all() and (out[method] <= 1).all()


def test_hot_keys_take_their_own_way(spark, monkeypatch):
    monkeypatch.setattr(keyed, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(keyed, "HOT_SHARE", 20)
    p = sample()
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)] + [(9999, None)], "row_id bigint, p double")
    out = padjust.adjust(df, "p", {"bh": "bh"}).orderBy("row_id").collect()
    assert len(out) == len(p) + 1 and out[-1].bh is None
    assert np.abs(np.array([r.bh for r in out[:-1]]) - by_hand(p)["bh"]).max() < 1e-12


def test_preparation_and_decision(spark):
    df = spark.createDataFrame([("0.01",), ("-1",), ("7",), ("x",), (None,)], "p string")
    out = padjust.adjust(df, "p", {"q": "bonferroni"}, reject_at=0.05)
    assert {(r.p, r.q, r.q_reject) for r in out.collect()} == {
        ("0.01", 0.03, True), ("-1", 0.0, True), ("7", 1.0, False), ("x", None, None), (None, None, None)}


def test_harmonic_series_agrees_at_the_switch():
    exact = math.fsum(1 / k for k in range(1, 1_000_002))
    assert abs(padjust.harmonic(1_000_001) - exact) < 1e-12


def test_empty_input(spark):
    df = spark.createDataFrame([(None,)], "p double")
    assert padjust.adjust(df, "p", {"q": "holm"}).first().q is None
    assert padjust.adjust(df.where(F.lit(False)), "p", {"q": "bh"}).count() == 0
