"""Connected components of an edge table: contraction in tasks, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dasyspark.session import materialize

EDGES_PER_TASK = 400_000


class Forest:
    """Union by smaller number, within a task."""

    def __init__(self, size: int):
        self.parent = list(range(size))

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.parent[max(i, j)] = min(i, j)
        return True

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.parent))], np.int64)


def contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stars (u hangs on the smaller v) with the components of the edges (u, v) of one task."""
    held = [np.empty((0, 2), np.int64)] + [pdf[["u", "v"]].to_numpy(np.int64) for pdf in batches]
    names, at = np.unique(np.concatenate(held), return_inverse=True)
    forest = Forest(len(names))
    for u, v in at.reshape(-1, 2).tolist():
        forest.join(u, v)
    roots = forest.roots()
    hung = roots != np.arange(len(names))
    yield pd.DataFrame({"u": names[hung], "v": names[roots[hung]]})


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), root being the smallest node of its component.

    First every task contracts a bounded number of edges to stars, as long as that
    shrinks them; edges that fit one task are done with that. Then rounds: each
    hangs larger neighbours of a node, then the smaller ones, on the smallest of
    them, which ends in stars after few rounds. Their joins are equi-joins on a
    node, so that adaptive execution can split a hub. Results of rounds are written
    to the shared folder. Loops and repeated edges do no harm.
    """

    def smallest(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges"
    )
    size = now.count()
    while size:
        tasks = -(-size // EDGES_PER_TASK)
        now = materialize(now.coalesce(tasks).mapInPandas(contract, "u long, v long"), "edges")
        if tasks == 1:
            size = 0
            break
        before, size = size, now.count()
        if size > 0.7 * before:
            break
    seen = state(now) if size else (0,)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        hung = large.join(smallest(large), "u")
        small = hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            hung.select("u", F.col("m").alias("v"))
        )
        now = materialize(small.distinct(), "edges")
        after = state(now)
        if after == seen:
            break
        seen = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select("v", "v").distinct()
    )
