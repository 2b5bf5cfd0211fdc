"""Connected components of an edge table, by alternating large and small stars; every round is written."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.shared import written


class Forest:
    """Union-find over the vertices that a task sees."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, v: int) -> int:
        parent = self.parent
        r = v
        while parent.get(r, r) != r:
            r = parent[r]
        while parent.get(v, v) != r:
            parent[v], v = r, parent[v]
        return r

    def join(self, a: int, b: int) -> bool:
        """Joins two trees; False if they were one."""
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b

    def edges(self) -> list[tuple[int, int]]:
        return [(v, self.root(v)) for v in self.parent if self.root(v) != v]

    def batch(self) -> pa.RecordBatch:
        """The edges as columns a, b."""
        edges = self.edges()
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in range(2)], names=["a", "b"])


def _stars(edges: DataFrame, both: bool) -> DataFrame:
    """Each vertex's neighbours (both: the larger ones; else itself and the smaller ones) joined to the
    least vertex of its neighbourhood."""
    if both:
        pairs = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        out = pairs.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = pairs.groupBy("a").agg(F.min("b").alias("m"))
        out = pairs.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def contracted(edges: DataFrame, name: str) -> DataFrame:
    """Edges (a, b) that connect what ``edges`` do, after one round of stars: most vertices hang from the least
    one of their component, some still from another."""
    return written(_stars(written(_stars(edges, True), name), False), name)


def _hung(edges: DataFrame) -> bool:
    """Whether every vertex of ``edges`` (a > b, each once) hangs from one vertex that hangs from none."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("below"), F.lit(0).alias("above"))
    ends = ends.unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    each = ends.groupBy("v").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return each.where("below > 1 OR (below = 1 AND above = 1)").isEmpty()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(vertex, root) of every vertex in ``edges`` (a, b: long); the root is the component's least vertex."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    while not _hung(now):
        now = written(_stars(written(_stars(now, True), name), False), name)
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("vertex"), F.col("b").alias("root")).distinct())
