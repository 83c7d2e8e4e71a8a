"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from trendloom.llm.common import cut_lineage

_EDGE = "a bigint, b bigint"


class Forest:
    """Union-find over places 0..n-1 whose roots are kept as one array."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        """Join the trees of each pair; pairs within one tree cost one comparison."""
        apart = self.root[left] != self.root[right]
        if not apart.any():
            return
        root = self.root
        for i, j in zip(left[apart].tolist(), right[apart].tolist(), strict=True):
            while root[i] != i:
                i = root[i]
            while root[j] != j:
                j = root[j]
            if i != j:
                root[max(i, j)] = min(i, j)
        while True:
            higher = root[root]
            if (higher == root).all():
                break
            root = higher
        self.root = root


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with one edge from each node to the least node of its own."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    forest = Forest(len(nodes))
    forest.link(places[:len(a)], places[len(a):])
    least = nodes[forest.root]
    return nodes[least != nodes], least[least != nodes]


def _contracted(edges: DataFrame) -> DataFrame:
    """Stars of the edges that happen to lie in one task, a bounded number at a time."""
    def run(batches):
        import pyarrow as pa

        kept: list = []
        rows = 0

        def flush():
            a = np.concatenate([k[0] for k in kept])
            b = np.concatenate([k[1] for k in kept])
            return pa.RecordBatch.from_arrays([pa.array(x) for x in stars(a, b)], names=["a", "b"])

        for batch in batches:
            kept.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            rows += batch.num_rows
            if rows > 1 << 18:
                yield flush()
                kept, rows = [], 0
        if kept:
            yield flush()

    return edges.select("a", "b").mapInArrow(run, _EDGE)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (the least node reachable) for every node of `edges` (a, b).

    Large-star and small-star rounds: a node's neighbours are linked to the
    least of them. Minima combine before the shuffle and are saved, so that
    the join has plain shuffles on both sides and Spark can split the edges of
    a hub; rounds end when no edge changes. Edges with a null end and loops are
    ignored; an empty table gives an empty table.
    """
    edges = cut_lineage(_contracted(edges.where("a <> b")).distinct(), "edges")
    before = _state(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("x"), F.least("a", "m").alias("m")), "least")
        # large star: greater neighbours of a node hang on its least neighbour
        large = both.where("b > a").join(least, F.col("a") == F.col("x")).select(
            F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = cut_lineage(large, "large")
        # small star: a node's lesser neighbours, and itself, hang on the least
        least = cut_lineage(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), "m"), "least")
        small = large.join(least, F.col("a") == F.col("x")).select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")),
                              F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        ).select("e.a", "e.b").where("a <> b").distinct()
        edges = cut_lineage(small, "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return nodes.unionByName(roots)
