import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tablewright.operators import graph, similarity, tfidf


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(120, 8))
    m[40:60] = m[40] + rng.normal(scale=0.05, size=(20, 8))  # a dense group
    m[7] = 0.0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id bigint, vector array<double>")
    return m, df.repartition(3).cache()


def cosines(m):
    lengths = np.linalg.norm(m, axis=1, keepdims=True)
    u = np.divide(m, lengths, out=np.zeros_like(m), where=lengths > 0)
    # element by element, so equal rows give equal scores
    return (u[:, None] * u[None]).sum(2)


@pytest.mark.parametrize("limits", [{}, {"broadcast_bytes": 100, "block_bytes": 1500}])
@pytest.mark.parametrize("metric", similarity.METRICS)
def test_nearest_equals_brute_force(points, limits, metric):
    m, df = points
    score = cosines(m) if metric == "cosine" else ((m[:, None] - m[None]) ** 2).sum(2)
    got = similarity.nearest(df, df, 4, metric=metric, **limits).collect()
    rows = {(r.query_id, r["rank"]): (r.id, r.score) for r in got}
    assert len(rows) == 120 * 4
    sign = -1 if metric == "cosine" else 1
    for q in range(120):
        want = sorted(range(120), key=lambda c: (sign * score[q, c], c))[:4]
        assert [rows[(q, k)][0] for k in range(1, 5)] == want
        assert rows[(q, 1)][1] == pytest.approx(score[q, want[0]], abs=1e-6)


@pytest.mark.parametrize("limits", [{}, {"broadcast_bytes": 100, "block_bytes": 1500}])
def test_small_slices_and_near_rows(spark, monkeypatch, limits):
    """Scores held at once are bounded whatever the limits, and distances far below the lengths are told apart."""
    monkeypatch.setattr(similarity, "SCORE_CELLS", 50)
    m = 1000 + np.array([[0, 0], [4e-4, 0], [3e-4, 0], [0, 0], [1, 1]] + [[i, -i] for i in range(5, 40)], float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id bigint, vector array<double>").repartition(3)
    got = similarity.nearest(df.where("id = 0"), df, 4, metric="squared_l2", **limits).orderBy("rank").collect()
    assert [r.id for r in got] == [0, 3, 2, 1] and got[3].score == pytest.approx(1.6e-7, rel=1e-6)


def test_nearest_with_fewer_rows_than_asked(points):
    _, df = points
    few = df.where("id < 2")
    assert similarity.nearest(few, few, 5).count() == 4
    assert similarity.nearest(df.where("id < 0"), df, 5).count() == 0


@pytest.mark.parametrize("block_bytes", [1 << 20, 1000])
def test_pairs_equal_brute_force(points, block_bytes):
    m, df = points
    c = cosines(m)
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if c[i, j] >= 0.7}
    got = similarity.similar_pairs(df, 0.7, block_bytes=block_bytes).collect()
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want
    assert all(r.similarity == pytest.approx(c[r.a, r.b]) for r in got)


def test_hashed_pairs_are_true_pairs(points):
    m, df = points
    c = cosines(m)
    got = {(r.a, r.b) for r in similarity.similar_pairs_lsh(df, 0.9).collect()}
    assert got and all(c[a, b] >= 0.9 - 1e-6 for a, b in got)


@pytest.mark.parametrize("bucket_length", [4.0, 0.02])
def test_hashed_pairs_are_those_that_share_a_bucket(points, bucket_length, monkeypatch):
    """Whether all rows meet once or bucket by bucket: each pair once, and no join makes rows of candidates."""
    m, df = points
    monkeypatch.setattr(similarity, "BLOCK_BYTES", 1_000)
    df = df.unionByName(df.where("id < 10"))
    found = similarity.similar_pairs_lsh(df, 0.3, tables=3, bucket_length=bucket_length)
    assert "Join" not in found._jdf.queryExecution().analyzed().toString() or bucket_length < 1
    got = [(r.a, r.b) for r in found.collect()]
    u = similarity._unit_rows(m)
    unit = [(i, Vectors.dense(v)) for i, v in enumerate(u) if v.any()]
    lsh = BucketedRandomProjectionLSH(inputCol="unit", outputCol="hashes", numHashTables=3, bucketLength=bucket_length, seed=7)
    rows = df.sparkSession.createDataFrame(unit, ["id", "unit"])
    codes = {r.id: [h[0] for h in r.hashes] for r in lsh.fit(rows).transform(rows).collect()}
    c = cosines(m)
    want = {(a, b) for a in codes for b in codes if a < b and c[a, b] >= 0.3 and any(x == y for x, y in zip(codes[a], codes[b]))}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_pairs_are_given_away_in_bounded_frames(monkeypatch):
    monkeypatch.setattr(similarity, "PAIRS", 100)
    rows = pd.DataFrame({"i": 0, "j": 0, "own": 0, "cid": [f"k{i:03}" for i in range(120)], "cv": [np.array([1.0, i / 500]) for i in range(120)]})
    frames = list(similarity.pairs_of_blocks(0.5)(iter([rows[:50], rows[50:]])))
    assert sum(map(len, frames)) == 120 * 119 // 2 and max(map(len, frames)) <= 100


def test_rows_of_a_block_are_measured_once(monkeypatch):
    """Lengths and unit rows are not made anew for slices and pairs, and scores are those of ``_exact``, bit by bit."""
    rng, calls = np.random.default_rng(5), []
    monkeypatch.setattr(similarity, "SCORE_CELLS", 400)
    monkeypatch.setattr(similarity, "PAIR_CELLS", 60, raising=False)
    units = similarity._unit_rows
    monkeypatch.setattr(similarity, "_unit_rows", lambda m: calls.append(len(m)) or units(m))
    m = np.concatenate([rng.normal(size=(60, 6)), np.zeros((1, 6))])
    m[7] = m[8]
    for own in (np.zeros(61, int), np.arange(61) % 2):
        rows = pd.DataFrame({"i": 0, "j": own.max(), "own": own, "cid": rng.permutation(61), "cv": list(m)})
        calls.clear()
        found = pd.concat(similarity.pairs_of_blocks(0.3)(iter([rows])))
        assert len(calls) == 2 and not found.duplicated(["a", "b"]).any()
        of = {r.cid: (r.own, r.cv) for r in rows.itertuples()}
        for r in found.itertuples():
            assert r.a < r.b and r.similarity == similarity._exact(of[r.a][1][None], of[r.b][1][None], "cosine")[0]
        c = cosines(np.stack([of[i][1] for i in range(61)]))
        assert len(found) == sum(c[i, j] >= 0.3 and (own.max() == 0 or of[i][0] != of[j][0]) for i in range(61) for j in range(i + 1, 61)) > 50


def test_scores_are_rounded_as_by_decimals(spark):
    from checks.queries_vectors import _shown

    rng = np.random.default_rng(2)
    ties = [i / 2e6 + d for i in range(-40, 40) for d in (0.0, 1e-17, -1e-12, 1e-10)] + [0.1234565, 0.9999995, 1.0000005, 2.5e-7, -5e-7]
    values = [None, math.nan, math.inf, -math.inf, -0.0, 1e30, -1e17 / 3, 123456789.1234567, *ties, *rng.uniform(-1, 1, 3000).tolist()]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", F.round("x", 6).alias("want"))
    assert _shown(df, "x").where(~F.col("x").eqNullSafe(F.col("want"))).count() == 0


def test_axes_equal_a_singular_value_decomposition(points):
    m, df = points
    centred = m - m.mean(0)
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    for k in range(2):
        vt[k] *= np.sign(vt[k][np.abs(vt[k]).argmax()])
    p = centred @ vt[:2].T
    want = (p - p.min()) / (p.max() - p.min()) * 2 - 1
    got = np.array([r.position for r in graph.principal_axes(df).orderBy("id").collect()])
    assert np.abs(got - want).max() < 1e-8


def test_edges_degrees_and_removal(spark, points):
    _, df = points
    pairs = similarity.similar_pairs(df, 0.9)
    edges = similarity.both_ways(pairs)
    assert similarity.undirected(edges).exceptAll(pairs.select("a", "b")).count() == 0
    total = graph.totals(df, edges).first()
    assert (total.nodes, total.connections) == (120, pairs.count())
    nodes, left = graph.remove_nodes(df, edges, df.where("id between 40 and 49"))
    assert nodes.count() == 110 and left.where("node between 40 and 49 or neighbour between 40 and 49").count() == 0


def test_search_puts_prefix_matches_first(spark):
    df = spark.createDataFrame([(1, "xab"), (2, "Abz"), (3, "aba"), (4, "q")], "id int, label string")
    assert [r.id for r in graph.search_labels(df, " AB ").collect()] == [3, 2, 1]
    assert graph.search_labels(df, "  ").count() == 0


TEXTS = ["The cat sat on the mat", "the dog", "", "cat cat cat Hund_1 é-x", None]


def grams(text):
    import re

    w = re.findall("[a-z0-9_]+", (text or "").lower())
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def test_tfidf_equals_the_formula(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    model = tfidf.fit(df, "text", max_features=8)
    total, docs = Counter(), Counter()
    for t in TEXTS:
        total.update(grams(t))
        docs.update(set(grams(t)))
    terms = sorted(sorted(total, key=lambda t: (-total[t], t))[:8])
    assert model.terms == terms and model.totals == [total[t] for t in terms]
    want = {}
    for i, t in enumerate(TEXTS):
        tf = Counter(g for g in grams(t) if g in terms)
        raw = {g: n * (math.log((1 + len(TEXTS)) / (1 + docs[g])) + 1) for g, n in tf.items()}
        length = math.sqrt(sum(x * x for x in raw.values()))
        want.update({(i, g): x / length for g, x in raw.items()})
    got = {(r.id, r.term): r.weight for r in model.weights(df, "text", ["id"]).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    dense = model.transform_dense(df, "text").orderBy("id").first().vector
    assert len(dense) == 8 and math.fsum(x * x for x in dense) == pytest.approx(1.0)
    assert model.vocabulary(spark).where(F.col("term") == terms[0]).first().position == 0
