"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step joins an edge table with one minimum per node; the minima come from partial aggregation and are written out, so
that the joins are plain equi-joins of tables, which adaptive execution can split where a node is hot. Every round is written to the shared folder,
and the rounds end when every component is a star around its smallest node, which one aggregation tells. Tasks that make
edges can contract their own first. Nothing but that answer reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize
from tessera.sources.scratch import drop, scope


def _large_star(edges: DataFrame) -> DataFrame:
    """Edges (a > b): each neighbour larger than a node moves to the smallest of the node and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = materialize(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")), "low")
    moved = both.join(low, "a")
    return moved.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges (a > b): a node and its smaller neighbours move to the smallest of them."""
    low = materialize(edges.groupBy("a").agg(F.min("b").alias("low")), "low")
    moved = edges.join(low, "a").filter(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(low.select("a", F.col("low").alias("b"))).distinct()


def contracted(edges: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The same components as stars (node, smallest node), by least labels and pointer jumping."""
    pairs = list(edges)
    if not pairs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (label[label] != label).any():
            label = label[label]
        left = label[x] != label[y]
        x, y = x[left], y[left]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


#: Edges of a task that are contracted together.
STAR_EDGES = 1 << 18


def star_blocks(edges: Iterable[tuple[np.ndarray, np.ndarray]], limit: int = STAR_EDGES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stars with the same components as the edges, of `limit` edges at a time, so that memory is bounded; stars of
    different blocks may share nodes."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0
    for a, b in edges:
        held.append((a, b))
        count += len(a)
        if count >= limit:
            held = [contracted(held)]
            count = len(held[0][0])
            if 2 * count >= limit:
                yield held.pop()
                count = 0
    yield contracted(held)


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node has one smaller neighbour at most, and none if it is one itself (edges: a > b, distinct)."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
    nodes = ends.select("e.*").groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.filter((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).take(1)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), undirected; root is the component's smallest node.

    Loops, repeated edges and edges in both directions are allowed; no edges give no rows.
    """
    edges = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "edges")
    while not _are_stars(edges):
        before = edges
        with scope(edges.sparkSession) as keep:
            edges = keep(materialize(_small_star(materialize(_large_star(edges), "edges")), "edges"))
        drop(before)
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
