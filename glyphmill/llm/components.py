"""Connected components of links found in many places, without a driver and without hub rows in one task.

Each place that looks for links (a leaf, a block) says of each linked node which root it has there, its smallest node.
A node named in several places ties their roots together. Only roots, one for each place a component touches, enter
the iterations, by the large-star and small-star operations.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import materialize


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links a-b, each node's smallest reachable node."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        label = new[label]
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node reachable) for all nodes of ``edges`` (a, b)."""
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        # large star: each larger neighbour to the least; small star: each smaller neighbour and the node itself to the least.
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        large = materialize(large, "large-star")
        low = materialize(large.groupBy("x").agg(F.min("y").alias("m")), "low")
        small = large.join(low, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").unionByName(low.select("x", F.col("m").alias("y"))).distinct()
        edges = materialize(small.select(F.col("y").alias("a"), F.col("x").alias("b")), "edges")
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    stars = edges.select(F.col("b").alias("node"), F.col("a").alias("comp"))
    return stars.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct())


def join_roots(membership: DataFrame) -> DataFrame:
    """node, comp for ``membership`` (node, root): rows of linked nodes, of which each place names its roots too."""
    roots = materialize(membership.groupBy("node").agg(F.sort_array(F.collect_set("root")).alias("roots")), "node-roots")
    ties = roots.where("size(roots) > 1").select(F.col("roots")[0].alias("a"), F.explode("roots").alias("b")).where("a <> b")
    # a root is a node, too: where it is under another root elsewhere, its own row has both
    if ties.isEmpty():
        return roots.select("node", F.col("roots")[0].alias("comp"))
    comps = materialize(components(ties), "root-components")
    return roots.select("node", F.col("roots")[0].alias("root")).join(comps.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("comp", "root").alias("comp"))
