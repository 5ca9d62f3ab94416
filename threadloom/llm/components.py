"""Connected components of link tables by alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.storage import materialise


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars (node, least node of its component) of the links a - b; at most one row a node."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = inverse[: len(a)], inverse[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], least)
        np.minimum.at(new, root[right], least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def components(links: DataFrame) -> DataFrame:
    """(node, component): every node of ``links(a, b)`` with the least node it can reach.

    Large-star and small-star steps until nothing moves: the rounds grow with the logarithm of a
    component's size. A step is a minimum per node, combined before the shuffle, and a join with it
    that may split hot nodes; no node's neighbours are ever gathered. Null ends are no links.
    """
    edges = materialise(
        links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi > lo").distinct()
    )
    seen = None
    while True:
        # large star: every neighbour above a node moves to the least node around it
        both = edges.union(edges.select("lo", "hi")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # small star: the neighbours below a node, and the node, move to the least of them
        below = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(below, "hi")
        edges = materialise(
            small.select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .union(below.select("hi", F.col("m").alias("lo")))
            .filter("hi > lo")
            .distinct()
        )
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)
