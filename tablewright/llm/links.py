"""Connected components of a graph given as a DataFrame of edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.session import materialise


def _minimum(edges: DataFrame) -> DataFrame:
    """The smallest of each node and its neighbours; partial aggregation merges hubs before the shuffle."""
    return edges.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(id, root) for every node of ``edges``; root is the smallest node id of its component.

    Alternates large-star and small-star steps until nothing changes. Each step writes its edges to the
    shared folder, so a lost executor costs one step. Empty edges give an empty table; loops and
    repeated edges do no harm; edges with a null end are ignored.
    """
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    nodes = materialise(now.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "nodes")
    now = materialise(now.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_minimum(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = materialise(large.where("a != b").distinct(), "edges")
        low = _minimum(large)
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        small = small.union(low.select("a", F.col("low").alias("b"))).where("a != b").distinct()
        now = materialise(small, "edges")
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if state == before or state[0] == 0:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.groupBy("a").agg(F.min("b").alias("low"))
    return nodes.join(roots, nodes["id"] == roots["a"], "left").select("id", F.coalesce("low", "id").alias("root"))


def spanning_pairs(n: int, near) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (root, member) of positions that connect what ``near`` connects; ``near(i)`` masks the neighbours of i.

    Every pair with an end outside the anchor's component is looked at from that end, so pairs inside
    the component that has swallowed most positions cost nothing.
    """
    label = np.arange(n)

    def join(i: int) -> None:
        mask = near(i)
        mask[i] = True
        met = np.unique(label[mask])
        if len(met) > 1:
            label[np.isin(label, met)] = met[0]

    if n > 8:
        anchor = max(range(0, n, max(1, n // 8)), key=lambda i: int(near(i).sum()))
        join(anchor)
    else:
        anchor = 0
        join(0)
    for i in range(n):
        if label[i] != label[anchor]:
            join(i)
    member = np.flatnonzero(label != np.arange(n))
    return label[member], member
