"""Vector functions, neighbours and the similarity graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.catalog import query, table
from checks.fixtures import LIBRARY, library
from tablewright.functions import vectors
from tablewright.operators import graph, pivots, similarity

LOW = 0.3


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


def _shown(df, column):
    """Scores as the comparison prints them; ranks and thresholds were decided at full precision."""
    millionths = F.col(column) * 1e6
    whole = F.floor(millionths + 0.5)
    # rounding by decimal text costs more than all else of a pair; it is left to values that lie near a tie, or are no small numbers
    plain = (F.abs(millionths) < 1e9) & (F.abs(millionths + 0.5 - whole - 0.5) < 0.499)
    return df.withColumn(column, F.when(plain, whole / F.lit(1e6)).otherwise(F.round(column, 6)))


EMB = "emb AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
PAIRS = EMB + """,
pairs AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS similarity
          FROM emb a JOIN emb b ON a.id < b.id)
"""
DIRECTED = PAIRS + f""",
edges AS (SELECT a AS node, b AS neighbour, similarity FROM pairs WHERE similarity >= {LOW}
          UNION ALL SELECT b, a, similarity FROM pairs WHERE similarity >= {LOW})
"""


@query(f"""WITH {EMB}, s AS (SELECT q.id AS query_id, c.id AS id, list_cosine_similarity(q.v, c.v) AS score FROM emb q, emb c)
SELECT query_id, id, round(score, 6) AS score, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM s)
WHERE k <= 5""")
def knn_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _shown(similarity.nearest(v, v, 5), "score")


@query(f"""WITH {EMB}, s AS (SELECT q.id AS query_id, c.id AS id, list_cosine_similarity(q.v, c.v) AS score FROM emb q, emb c)
SELECT query_id, id, round(score, 6) AS score, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM s)
WHERE k <= 3""")
def knn_topk_by_blocks(spark, sf_dir):
    """Tiny limits, so that the block way is taken on this data."""
    v = _vectors(spark, sf_dir)
    return _shown(similarity.nearest(v, v, 3, broadcast_bytes=4096, block_bytes=64 * 1024), "score")


@query(f"WITH {PAIRS} SELECT a, b, round(similarity, 6) AS similarity FROM pairs WHERE similarity >= {LOW}")
def similarity_pairs(spark, sf_dir):
    return _shown(similarity.similar_pairs(_vectors(spark, sf_dir), LOW), "similarity")


@query(f"WITH {PAIRS} SELECT a, b, round(similarity, 6) AS similarity FROM pairs WHERE similarity >= 0.7")
def similarity_pairs_close(spark, sf_dir):
    return _shown(similarity.similar_pairs(_vectors(spark, sf_dir), 0.7), "similarity")


@query(f"""WITH {PAIRS} SELECT 'low' AS kind, a, b, round(similarity, 6) AS similarity FROM pairs WHERE similarity >= {LOW}
UNION ALL SELECT 'close', a, b, round(similarity, 6) FROM pairs WHERE similarity >= 0.7
UNION ALL SELECT 'moved', a.id, b.id, round(list_cosine_similarity(a.v, b.v), 6)
FROM (SELECT id, list_transform(v, lambda x, i: CASE WHEN i = 1 + label THEN x + 3 ELSE x END) AS v FROM emb) a
JOIN (SELECT id, list_transform(v, lambda x, i: CASE WHEN i = 1 + label THEN x + 3 ELSE x END) AS v FROM emb) b ON a.id < b.id
WHERE list_cosine_similarity(a.v, b.v) >= 0.9""")
def similarity_pairs_pivots(spark, sf_dir):
    """Cells around pivots: at two thresholds over the rows as they are, and over rows moved apart by label, where cells keep rows from each other."""
    v = _vectors(spark, sf_dir)
    moved = v.withColumn("vector", F.transform("vector", lambda x, i: F.when(i == F.col("label"), x + 3).otherwise(x)))
    kinds = {"low": (v, LOW), "close": (v, 0.7), "moved": (moved, 0.9)}
    found = [pivots.similar_pairs_pivots(rows, threshold, block_bytes=64 * 1024).select(F.lit(kind).alias("kind"), "a", "b", "similarity")
             for kind, (rows, threshold) in kinds.items()]
    return _shown(found[0].unionByName(found[1]).unionByName(found[2]), "similarity")


@query(f"""WITH {EMB}, s AS (SELECT q.id AS query_id, c.id AS id, list_cosine_similarity(q.v, c.v) AS score FROM emb q, emb c)
SELECT query_id, id, round(score, 6) AS score, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM s)
WHERE k <= 5""")
def knn_join_bounded(spark, sf_dir):
    """All vectors ask: first in their own cell, then in those within the distance found there."""
    v = _vectors(spark, sf_dir)
    return _shown(pivots.nearest_by_pivots(v, v, 5, block_bytes=64 * 1024), "score")


@query(f"WITH {PAIRS} SELECT count(*) AS exact_pairs, 0::BIGINT AS wrong, true AS enough FROM pairs WHERE similarity >= {LOW}")
def similarity_pairs_hashed(spark, sf_dir):
    """Hashing may miss pairs: none that it finds is wrong, and it finds at least nine of ten."""
    v = _vectors(spark, sf_dir)
    exact = similarity.similar_pairs(v, LOW).select("a", "b", F.lit(1).alias("exact"))
    found = similarity.similar_pairs_lsh(v, LOW, tables=12, bucket_length=4.0).select("a", "b", F.lit(1).alias("found"))
    return exact.join(found, ["a", "b"], "full").agg(
        F.count("exact").alias("exact_pairs"), F.count_if(F.col("exact").isNull()).alias("wrong"),
        (F.count("found") >= 0.9 * F.count("exact")).alias("enough"))


@query(f"""WITH near AS (SELECT vec_id * 4 + k AS id, list_transform(list_resize(CAST(embedding AS DOUBLE[]), 65, 0.0), lambda x, i: CASE WHEN i = 65 THEN k * 1e-4 ELSE x END) AS v
  FROM embeddings, range(0, 4) r(k)),
s AS (SELECT q.id AS query_id, c.id AS id, list_sum(list_transform(range(1, 66), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i]))) AS d FROM near q JOIN near c ON q.id // 4 = c.id // 4)
SELECT query_id, id, CAST(k AS INTEGER) AS rank, round(d * 1e8, 3) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d * 1e8, 3), id) AS k FROM s) WHERE k <= 4""")
def knn_near_ties(spark, sf_dir):
    """Four rows around each vector, at squared distances below 1e-6: all are told apart."""
    v = _vectors(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    near = v.select((F.col("id") * 4 + F.col("k")).alias("id"), F.concat("vector", F.array(F.col("k") * 1e-4)).alias("vector"))
    found = similarity.nearest(near, near, 4, metric="squared_l2")
    return found.select("query_id", "id", "rank", F.round(F.col("score") * 1e8, 3).alias("distance"))


@query(f"WITH {DIRECTED} SELECT node, neighbour, round(similarity, 6) AS similarity FROM edges")
def similarity_edges(spark, sf_dir):
    return _shown(similarity.both_ways(similarity.similar_pairs(_vectors(spark, sf_dir), LOW)), "similarity")


@query(f"WITH {DIRECTED} SELECT DISTINCT least(node, neighbour) AS a, greatest(node, neighbour) AS b FROM edges")
def undirected_edges(spark, sf_dir):
    return similarity.undirected(similarity.both_ways(similarity.similar_pairs(_vectors(spark, sf_dir), LOW)))


@query(f"WITH {DIRECTED} SELECT emb.id, count(node) AS degree FROM emb LEFT JOIN edges ON node = emb.id GROUP BY emb.id")
def node_degrees(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return graph.degrees(v, similarity.both_ways(similarity.similar_pairs(v, LOW)))


@query(f"WITH {DIRECTED} SELECT (SELECT count(*) FROM emb) AS nodes, (SELECT count(*) FROM edges) // 2 AS connections")
def map_totals(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return graph.totals(v, similarity.both_ways(similarity.similar_pairs(v, LOW)))


@query(f"""WITH {DIRECTED} SELECT emb.id, count(node) AS degree FROM emb LEFT JOIN
  (SELECT * FROM edges WHERE node % 7 <> 0 AND neighbour % 7 <> 0) ON node = emb.id WHERE emb.id % 7 <> 0 GROUP BY emb.id""")
def remove_nodes(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    edges = similarity.both_ways(similarity.similar_pairs(v, LOW))
    return graph.degrees(*graph.remove_nodes(v, edges, v.where(F.col("id") % 7 == 0)))


@query(f"""WITH {DIRECTED} SELECT node, neighbour FROM edges WHERE node % 5 <> 0
UNION ALL SELECT id, id + 1 FROM emb WHERE id % 5 = 0""")
def replace_edges(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    edges = similarity.both_ways(similarity.similar_pairs(v, LOW)).select("node", "neighbour")
    new = v.where(F.col("id") % 5 == 0).select(F.col("id").alias("node"), (F.col("id") + 1).alias("neighbour"))
    return graph.replace_edges(edges, new)


@query(f"WITH {EMB} SELECT id, CASE WHEN id % 3 = 0 THEN label + 100 ELSE label END AS label FROM emb UNION ALL SELECT id + 1000000, label FROM emb WHERE id % 4 = 0")
def upsert_nodes(spark, sf_dir):
    v = _vectors(spark, sf_dir).select("id", "label")
    new = v.where(F.col("id") % 3 == 0).select("id", (F.col("label") + 100).alias("label")).unionByName(
        v.where(F.col("id") % 4 == 0).select((F.col("id") + 1000000).alias("id"), "label"))
    return graph.upsert_nodes(v, new)


@query(f"WITH {EMB} SELECT id, CAST(len(v) AS INTEGER) AS dims, list_min(v) AS \"min\", list_max(v) AS \"max\", round(list_avg(v), 9) AS mean FROM emb")
def vector_summary(spark, sf_dir):
    return graph.vector_summary(_vectors(spark, sf_dir)).withColumn("mean", F.round("mean", 9))


@query(f"""WITH {EMB} SELECT id, CAST(len(v) AS INTEGER) AS dims, v[1] + 10 * v[3] AS first_three, round(list_dot_product(v, v), 6) AS own,
round(list_cosine_similarity(v, list_reverse(v)), 6) AS cosine, round(pow(list_distance(v, list_reverse(v)), 2), 6) AS squared FROM emb""")
def vector_functions(spark, sf_dir):
    v, r = F.col("vector"), F.reverse("vector")
    return _vectors(spark, sf_dir).select(
        "id", F.size(v).alias("dims"), (vectors.fit_length(v, 3, cut=True)[0] + vectors.fit_length(v, 3, cut=True)[2] * 10).alias("first_three"), F.round(vectors.dot(v, v), 6).alias("own"),
        F.round(vectors.cosine(v, r), 6).alias("cosine"), F.round(vectors.squared_l2(v, r), 6).alias("squared"))


@query(f"""WITH {EMB} SELECT id, CAST(k AS INTEGER) AS pos, coalesce(v[k + 1], 0.0) AS element FROM emb, range(0, 1000) r(k)""")
def pad_vectors(spark, sf_dir):
    return _vectors(spark, sf_dir).select("id", F.posexplode(vectors.fit_length(F.col("vector"), 1000)).alias("pos", "element"))


@query(f"""WITH {LIBRARY} SELECT id, error_type FROM lib WHERE contains(error_type, 'error_1')
ORDER BY CASE WHEN starts_with(error_type, 'error_1') THEN 0 ELSE 1 END, error_type, id LIMIT 5""")
def label_search(spark, sf_dir):
    return graph.search_labels(library(spark, sf_dir), " Error_1", label="error_type").select("id", "error_type")


def principal_axes(spark, sf_dir):
    """Solver output: tested against numpy, no SQL."""
    return graph.principal_axes(_vectors(spark, sf_dir))


def similarity_map(spark, sf_dir):
    """Nodes with positions and connections."""
    nodes, _ = graph.build_map(library(spark, sf_dir), LOW)
    return nodes


def map_box(spark, sf_dir):
    """Bounds of the node positions."""
    nodes, _ = graph.build_map(library(spark, sf_dir), LOW)
    return graph.bounding_box(nodes)


for _fn in (principal_axes, similarity_map, map_box):
    query()(_fn)


@query(f"""WITH {LIBRARY}, near AS (SELECT a.id, b.id AS other FROM lib a JOIN lib b ON a.id <> b.id AND list_cosine_similarity(a.vector, b.vector) >= {LOW}),
linked AS (SELECT id, string_agg(other, ',' ORDER BY other) AS connections FROM near GROUP BY id)
SELECT lib.id, error_type AS label, status, 'COL_0_INT DF_CLEAN' AS tokens, coalesce(connections, '') AS connections FROM lib LEFT JOIN linked USING (id)""")
def similarity_map_links(spark, sf_dir):
    """What the nodes of the map say, positions aside."""
    nodes, _ = graph.build_map(library(spark, sf_dir), LOW)
    return nodes.select("id", "label", "status", F.array_join("tokens", " ").alias("tokens"), F.array_join("connections", ",").alias("connections"))


@query("SELECT count(*) AS nodes, -200.0::DOUBLE AS low, 200.0::DOUBLE AS high, true AS centred, true AS ordered FROM embeddings")
def map_properties(spark, sf_dir):
    """Positions fill the square, share one centre, and the first axis carries most."""
    nodes, _ = graph.build_map(library(spark, sf_dir), LOW)
    return nodes.agg(
        F.count(F.lit(1)).alias("nodes"), F.round(F.least(F.min("x"), F.min("y")), 6).alias("low"),
        F.round(F.greatest(F.max("x"), F.max("y")), 6).alias("high"),
        (F.abs(F.avg("x") - F.avg("y")) < 1e-6).alias("centred"), (F.var_pop("x") >= F.var_pop("y")).alias("ordered"))
