"""Connected components of a graph given by edges, without one task or the driver holding the graph.

Rounds contract the graph: each node points to the neighbour (or itself) with the least hash, and edges move to what their ends
point to. A contracted graph of at most ``ONE_TASK_EDGES`` edges, a fixed size, is finished by union-find in one task. Then the
labels run back down the rounds. Each round is cut off by a reliable checkpoint, so a lost executor costs no more than a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import use_checkpoints

ONE_TASK_EDGES = 50_000


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """edges: columns a, b (long). Returns node, root (the least node of its component) for each node of an edge.

    Defined cases: loops and repeated edges are ignored; no edge, no row; nulls must not occur.
    """
    use_checkpoints(edges.sparkSession)
    graph = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint()
    rounds = []
    while graph.count() > ONE_TASK_EDGES:
        both = graph.union(graph.select("b", "a"))
        near = both.groupBy("a").agg(F.min_by("b", F.struct(F.xxhash64("b"), "b")).alias("b"))
        own, other = F.struct(F.xxhash64("a"), "a"), F.struct(F.xxhash64("b"), "b")
        moved = near.select(F.col("a").alias("node"), F.when(own < other, F.col("a")).otherwise(F.col("b")).alias("to")).checkpoint()
        rounds.append(moved)
        ends = graph.join(moved.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
        ends = ends.join(moved.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").where("x <> y")
        graph = ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().checkpoint()
    found = graph.repartition(1).mapInArrow(_union_find, "node long, root long")
    if not rounds:
        return found
    for moved in reversed(rounds):
        below = found.select(F.col("node").alias("to"), "root")
        found = moved.join(below, "to", "left").select("node", F.coalesce("root", "to").alias("root")).checkpoint()
    least = found.groupBy("root").agg(F.min("node").alias("least")).checkpoint()
    return found.join(least, "root").select("node", F.col("least").alias("root"))
