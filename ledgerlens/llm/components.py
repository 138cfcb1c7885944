"""Connected components of a table of links, by alternating star contractions on Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _large_star(links: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the smallest node it knows."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node hands itself and its smaller neighbours to the smallest of them.  Links run from larger to smaller."""
    least = cut(links.groupBy("a").agg(F.min("b").alias("m")))
    own = least.select("a", F.col("m").alias("b"))
    return links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(own).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (smallest node reachable) for every node of ``links`` (longs ``a``, ``b``) but the smallest ones.

    Null ends and loops are ignored, so an empty table gives an empty one.  A node's neighbours are never gathered: both
    steps are a grouped minimum and a join back to it.  Rounds grow with the logarithm of the longest path.
    """
    links = links.where("a is not null and b is not null and a <> b")
    links = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        seen = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if seen == state or not seen[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = seen
        links = cut(_small_star(cut(_large_star(links))))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one task thinned to stars with the same components: at most one link a node."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    linked = label != np.arange(len(nodes))
    return nodes[linked], nodes[label[linked]]
