"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.llm.common import scratch, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for every node that has a link: the smallest node it is connected to.

    Each round hangs the larger neighbours of every node, then its smaller ones, on the smallest; rounds grow with the
    logarithm of the longest path. A node's smallest neighbour is an aggregate that is joined back, so a node with very
    many links is spread over tasks. Every round is written once to the shared folder.
    """
    spark = links.sparkSession
    folder = scratch(spark, "components")
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = written(edges, f"{folder}/0")
    seen, n = None, 0
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen, n = state, n + 1
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, f"{folder}/{n}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = written(small.distinct(), f"{folder}/{n}")


class Forest:
    """Components of the rows of one block: unions of whole arrays, smallest row as root."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return up
            self.parent = up

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            root = self.roots()
            a, b = root[a], root[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
