"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from clausegrid.llm.common import Rounds


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the edges a-b: (member, smallest member), members other than the smallest.

    It links the same nodes with fewer rows, at most one less than there are nodes.
    """
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _stars(e: DataFrame) -> bool:
    """Whether every edge (u, v) leads from a centre: each v has one u and is no u itself."""
    ends = e.select(F.col("v").alias("x"), F.lit(1).alias("low"), F.lit(0).alias("high")).unionByName(e.select(F.col("u").alias("x"), F.lit(0).alias("low"), F.lit(1).alias("high")))
    seen = ends.groupBy("x").agg(F.sum("low").alias("low"), F.max("high").alias("high"))
    return seen.agg(F.count_if((F.col("low") > 1) | (F.col("low") == 1) & (F.col("high") == 1)).alias("n")).first()["n"] == 0


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 64) -> DataFrame:
    """(node, component) for each node of an edge; component is the smallest node reachable.

    Alternates large and small stars until the edges are stars, which many inputs are from the start; the number of rounds grows
    with the logarithm of the longest path. Each round keeps at most one edge per input edge, uses a
    partial minimum before every shuffle and is stored in the shared checkpoint folder in place of the one before; the joins with a large star's centre are
    split by adaptive execution. Self loops and repeated edges are allowed; edges with a null end are ignored.
    """
    e = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    stored = Rounds(edges.sparkSession, "components")
    e = stored.store(e.distinct())
    for _ in range(rounds):
        if _stars(e):
            break
        # large star: each neighbour above a node moves to the smallest of the node and its neighbours
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.join(low, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        # small star: each node and its lower neighbours move to the smallest of them
        low = e.groupBy("v").agg(F.min("u").alias("m"))
        joined = e.join(low, "v")
        e = joined.select("m", F.col("u").alias("x")).unionByName(joined.select("m", F.col("v").alias("x")))
        e = stored.store(e.where("m <> x").select(F.col("m").alias("u"), F.col("x").alias("v")).distinct())
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(e.select(F.col("u").alias("node"), F.col("u").alias("component"))).distinct()
