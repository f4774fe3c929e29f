"""Connected components of a graph that is given as edges, by repeated star contraction.

Every round writes its edges to the shared folder; no node's neighbours are gathered anywhere, only minima are taken.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodetide.llm.common import discard, staged

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbours and itself."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("m").alias("u"), "v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("m").alias("u"), "v")
    return moved.union(least.select(F.col("m").alias("u"), F.col("u").alias("v"))).distinct()


def _unsettled(pairs: DataFrame) -> int:
    """Nodes that keep the edges from being stars: linked to a smaller node, and part of a further edge. No round is needed to see it."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(0).alias("below")), F.struct(F.col("v").alias("node"), F.lit(1).alias("below")))).alias("end"))
    nodes = ends.groupBy("end.node").agg(F.count("*").alias("edges"), F.max("end.below").alias("below"))
    return nodes.agg(F.count_if(F.expr("below = 1 and edges > 1"))).first()[0]


def spanning(n: int, pairs) -> np.ndarray:
    """The smallest index that each of n nodes is linked with through the pairs."""
    root = np.arange(n)
    for x, y in pairs:
        while True:
            a, b = root[x], root[y]
            differ = a != b
            if not differ.any():
                break
            a, b = a[differ], b[differ]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(root, short := root[root]):
                root = short
    return root


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Columns node, root: for every node of an edge the smallest node that it is connected with.

    Null ends, loops and repeated edges are ignored. Nodes without edges are not returned. The result is a written table;
    those of the rounds before are deleted.
    """
    pairs = edges.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v"))
    pairs = staged(pairs.where("u is not null and v is not null and u <> v").distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        if not _unsettled(pairs):
            return pairs.select(F.col("v").alias("node"), F.col("u").alias("root")).union(
                pairs.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
        before = pairs
        pairs = staged(_small_star(_large_star(before)), "edges")
        discard(before)
    raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
