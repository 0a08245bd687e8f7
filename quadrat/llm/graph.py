"""Connected components: inside a task with numpy, over a table with star joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.shared import written


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n nodes under the links a[i] - b[i]."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def star_edges(names: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each linked name but the smallest of its component, with that smallest name: as connected as all the links."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    order = np.argsort(names[nodes], kind="stable")  # indices in the order of names, so roots are smallest names
    rank = np.empty(len(nodes), np.int64)
    rank[order] = np.arange(len(nodes))
    label = local_components(len(nodes), rank[place[: len(a)]], rank[place[len(a) :]])
    sorted_names = names[nodes][order]
    far = label != np.arange(len(nodes))
    return sorted_names[far], sorted_names[label[far]]


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (smallest reachable node) of all nodes of ``edges`` (``a, b``, any order, repeats allowed).

    Large-star and small-star steps in turn until every node points at its
    component's smallest one; the number of rounds grows with the logarithm of
    the longest chain. Each step is a pre-aggregated minimum and an equi-join,
    whose skewed side Spark can split. No link leaves the executors.
    """
    links = written(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        # Large star: every neighbour above u moves to the smallest neighbour of u.
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        # Small star: u and its smaller neighbours move to the smallest of them.
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionByName(small_least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        new = written(moved)
        # Done when no pointed-at node points on: all stars of depth one.
        deep = new.select(F.col("v").alias("u")).distinct().join(new, "u", "left_semi").limit(1).count()
        twice = new.groupBy("u").count().where("count > 1").limit(1).count()
        links = new
        if not deep and not twice:
            break
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
