"""Connected components of a link table, by contraction with union-find in every task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import kept_aside


class UnionFind:
    """Disjoint sets of integers, each named by its smallest member."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one task as one link from each node to the smallest node it reaches."""
    sets = UnionFind()
    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            sets.union(a, b)
    nodes = list(sets.parent)
    for at in range(0, len(nodes), 50_000):
        part = nodes[at : at + 50_000]
        yield pa.record_batch({"a": pa.array([sets.find(x) for x in part], pa.int64()), "b": pa.array(part, pa.int64())})


def _links(df: DataFrame) -> DataFrame:
    return df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b): label is the smallest node reachable.

    Each round merges the links of every task by union-find, lets each node point to its
    smallest neighbour and replaces both ends of the remaining links by what they point to.
    A node that isn't smaller than all its neighbours vanishes, so at most half of the nodes
    that still have links stay; the smallest node of a component is never merged away. Rounds
    are kept in the shared folder; only emptiness comes to the driver. Null ends and links of
    a node to itself are ignored; without links the result is empty.
    """
    links = kept_aside(_links(edges.select(F.col("a").cast("long"), F.col("b").cast("long"))).distinct())
    levels: list[DataFrame] = []
    while not links.isEmpty():
        stars = links.repartition("a").mapInArrow(_stars, "a long, b long").distinct()
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = kept_aside(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).select("node", F.least("node", "up").alias("up")))
        levels.append(up)
        a = up.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        b = up.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        moved = links.join(a, "a").join(b, "b").select(F.col("ua").alias("a"), F.col("ub").alias("b"))
        links = kept_aside(_links(moved).distinct())
    if not levels:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    label = levels.pop().select("node", F.col("up").alias("label"))
    while levels:
        above = label.select(F.col("node").alias("up"), "label")
        label = levels.pop().join(above, "up", "left").select("node", F.coalesce("label", "up").alias("label"))
    return kept_aside(label)
