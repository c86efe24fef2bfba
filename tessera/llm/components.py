"""Connected components of an edge table by alternating large-star and small-star steps.

Each step replaces edges by edges to a smaller neighbour and never adds any; the number of rounds grows with the logarithm
of the components' sizes. Edges stay in tables in the shared folder; the driver sees two numbers a round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import dropped, written

#: A node with more edges to nodes above it is dealt to this many places.
HEAVY, SALTS = 256, 64


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``component`` (the component's smallest node) for every node of an edge between two nodes.

    Repeated and reversed edges count once; self edges and edges with a null count for nothing; no edges give no rows.
    """
    x, y = F.col(a), F.col(b)
    now = written(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first())

    before = mark(now)
    while before[0]:
        # large star: the neighbours of v above v move to v's least neighbour m, if that is below v
        low = now.groupBy("u").agg(F.min("v").alias("m"))
        large = _heads(now, low.select(F.col("u").alias("v"), "m")).select("u", F.coalesce("m", "v").alias("v")).distinct()
        # small star: u and its neighbours below it move to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        last, now = now, written(small, "edges")
        dropped(last)
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _heads(edges: DataFrame, low: DataFrame) -> DataFrame:
    """``edges`` (u above v) with v's least neighbour m if it is below v, else null.

    A root that very many nodes have is dealt to ``SALTS`` places, each with a copy of its one row of ``low``; what is joined
    is a node's own least neighbour, so no node's edges are gathered.
    """
    salted = edges.withColumn("s", F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int"))
    many = edges.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > HEAVY).select("v")
    low = low.join(many.withColumn("heavy", F.lit(True)), "v", "left").select("v", "m", F.explode(F.when(F.col("heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))).alias("s"))
    salted = salted.join(many.withColumn("heavy", F.lit(True)), "v", "left").withColumn("s", F.when(F.col("heavy"), F.col("s")).otherwise(-1)).drop("heavy")
    return salted.join(low, ["v", "s"], "left").select("u", "v", "m")


class Forest:
    """The sets that pairs of the numbers below ``n`` make, with the smallest number of each as its root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        new = root[i] != root[j]
        if not new.any():
            return
        for x, y in zip(i[new].tolist(), j[new].tolist(), strict=True):
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            root[max(x, y)] = min(x, y)
        while (root[root] != root).any():
            root = root[root]
        self.root = root

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Each member that is no root, and its root."""
        member = np.flatnonzero(self.root != np.arange(len(self.root)))
        return member, self.root[member]
