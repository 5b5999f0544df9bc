"""Connected components by repeated contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from syllabix.session import pin, ship_package

# Edges that one task may solve alone.
FEW_EDGES = 200_000


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) for every node of ``a``, ``b`` pairs.

    A round points every node at its smallest neighbour if that is smaller, follows the
    pointers twice, and replaces both ends of every edge; edges inside a component
    vanish, so hubs lose their edges after one round. Rounds go on until ``FEW_EDGES`` are left,
    a logarithmic number in practice; these one task solves by union-find. Each round's tables are written to the shared
    folder, which cuts the lineage and lets adaptive execution split the joins on hubs.
    """
    edges = pin(_distinct(edges))
    result = None
    while edges.count() > FEW_EDGES:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = pin(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("to")))
        jumps = pin(_follow(_follow(parents, parents), parents))
        edges = pin(_distinct(_relabel(_relabel(edges, jumps, "a"), jumps, "b")))
        result = jumps if result is None else _follow(result, jumps)
    rest = pin(_solved(edges))
    result = rest if result is None else _follow(result, rest)
    return result.select("node", F.col("to").alias("component"))


def _solved(edges: DataFrame) -> DataFrame:
    """``node`` and ``to``, its component's smallest node, of at most ``FEW_EDGES`` edges, in one task."""
    ship_package(edges.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                parent.setdefault(a, a)
                parent.setdefault(b, b)
                a, b = find(a), find(b)
                parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "to": pa.array([find(x) for x in nodes], pa.int64())})

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node bigint, to bigint")


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _follow(pointers: DataFrame, parents: DataFrame) -> DataFrame:
    """Replace each ``to`` by what it points at itself."""
    step = parents.select(F.col("node").alias("_at"), F.col("to").alias("_next"))
    return pointers.join(step, F.col("to") == F.col("_at"), "left").select("node", F.coalesce("_next", "to").alias("to"))


def _relabel(edges: DataFrame, jumps: DataFrame, end: str) -> DataFrame:
    step = jumps.select(F.col("node").alias("_at"), F.col("to").alias("_next"))
    other = "b" if end == "a" else "a"
    return edges.join(step, F.col(end) == F.col("_at")).select(F.col("_next").alias(end), other)


class Forest:
    """Union-find over the rows of one task's block."""

    def __init__(self, size: int):
        self.parent = list(range(size))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """Unite two rows; False if they were united already."""
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def spanning_edges(left: np.ndarray, right: np.ndarray, size: int) -> tuple[list[int], list[int]]:
    """Those of the given edges that a forest needs: at most ``size - 1``."""
    forest = Forest(size)
    kept = [(x, y) for x, y in zip(left.tolist(), right.tolist(), strict=True) if forest.join(x, y)]
    return [x for x, _ in kept], [y for _, y in kept]
