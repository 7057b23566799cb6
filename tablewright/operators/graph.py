"""The similarity map: nodes with positions, edges, degrees, search and edits."""

from __future__ import annotations

from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from tablewright.functions import vectors
from tablewright.operators.similarity import both_ways, similar_pairs

SCALE = 200.0


def principal_axes(df: DataFrame, dims: int = 2, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, position ARRAY<DOUBLE>): projection on the main axes, all values scaled to [-1, 1] together.

    Spark's PCA does not centre, so vectors are centred first. The sign of an axis is free; it is
    fixed so that the loading of largest size is positive.
    """
    v = df.select(F.col(id_col).alias("id"), array_to_vector(F.col(vector_col).cast("array<double>")).alias("raw"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="raw", outputCol="centred").fit(v).transform(v)
    model = PCA(k=dims, inputCol="centred", outputCol="axes").fit(centred)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, j]).argmax(), j] >= 0 else -1.0 for j in range(dims)]
    placed = model.transform(centred).select("id", vector_to_array("axes").alias("p")).select(
        "id", F.array(*[F.col("p")[j] * F.lit(signs[j]) for j in range(dims)]).alias("p"))
    edge = placed.agg(F.min(F.array_min("p")).alias("low"), F.max(F.array_max("p")).alias("high")).first()
    if edge.low is None or edge.low == edge.high:
        return placed.select("id", F.col("p").alias("position"))
    span = edge.high - edge.low
    return placed.select("id", F.transform(
        "p", lambda x: (x - F.lit(edge.low)) / F.lit(span) * 2 - 1).alias("position"))


def map_nodes(library: DataFrame, edges: DataFrame, dims: int = 2) -> DataFrame:
    """Nodes (id, x, y[, z], label, status, tokens, connections) of a fix library.

    ``edges`` are directed (node, neighbour). Neighbours are listed per node, as the map shows them.
    """
    positions = principal_axes(library, dims)
    linked = edges.groupBy("node").agg(F.sort_array(F.collect_list("neighbour")).alias("connections"))
    axes = [(F.col("position")[i] * SCALE).alias(name) for i, name in enumerate("xyz"[:dims])]
    nodes = library.join(positions, "id").join(linked, library["id"] == linked["node"], "left")
    return nodes.select(
        library["id"], *axes,
        F.substring(F.coalesce("error_type", F.lit("unknown")), 1, 15).alias("label"),
        F.coalesce("status", F.lit("PENDING")).alias("status"),
        F.slice(F.split("fingerprint_tokens", r"\s+"), 1, 20).alias("tokens"),
        F.coalesce("connections", F.array().cast(linked.schema["connections"].dataType)).alias("connections"))


def build_map(library: DataFrame, threshold: float = 0.7, dims: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes, directed edges) of a fix library."""
    edges = both_ways(similar_pairs(library, threshold))
    return map_nodes(library, edges, dims), edges


def degrees(nodes: DataFrame, edges: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, degree), nodes without edges included."""
    counted = edges.groupBy(F.col("node").alias(id_col)).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select(id_col).join(counted, id_col, "left").select(
        id_col, F.coalesce("degree", F.lit(0).cast("bigint")).alias("degree"))


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes and undirected connections."""
    return degrees(nodes, edges).agg(
        F.count(F.lit(1)).alias("nodes"), F.floor(F.coalesce(F.sum("degree"), F.lit(0)) / 2).alias("connections"))


def bounding_box(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"),
                     F.min("y").alias("min_y"), F.max("y").alias("max_y"))


def search_labels(nodes: DataFrame, text: str, k: int = 5, label: str = "label", id_col: str = "id") -> DataFrame:
    """The k best nodes whose label contains the text: prefix matches first, then by label."""
    wanted = F.lit(text.strip().lower())
    lowered = F.lower(F.col(label))
    hits = nodes.where(F.contains(lowered, wanted) & (wanted != ""))
    first = F.when(F.startswith(lowered, wanted), 0).otherwise(1)
    return hits.orderBy(first, lowered, id_col).limit(k)


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Nodes without those listed in ``gone``, and edges without any end there."""
    ids = gone.select(F.col(id_col).alias("__gone")).distinct()
    kept = nodes.join(ids, nodes[id_col] == ids["__gone"], "left_anti")
    left = (edges.join(ids, edges["node"] == ids["__gone"], "left_anti"))
    return kept, left.join(ids, left["neighbour"] == ids["__gone"], "left_anti")


def upsert_nodes(nodes: DataFrame, new: DataFrame, id_col: str = "id") -> DataFrame:
    """New nodes added; nodes with a known id replaced."""
    return nodes.join(new.select(id_col), id_col, "left_anti").unionByName(new, allowMissingColumns=True)


def replace_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges of every node listed in ``new`` replaced, the others kept."""
    touched = new.select(F.col("node").alias("__node")).distinct()
    kept = edges.join(touched, edges["node"] == touched["__node"], "left_anti")
    return kept.unionByName(new)


def vector_summary(df: DataFrame, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, dims, min, max, mean) of every vector."""
    v = F.col(vector_col).cast("array<double>")
    return df.select(F.col(id_col), F.size(v).alias("dims"), vectors.vector_min(v).alias("min"),
                     vectors.vector_max(v).alias("max"), vectors.vector_mean(v).alias("mean"))
