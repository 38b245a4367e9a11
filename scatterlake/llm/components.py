"""Connected components by alternating large and small stars; few links are solved by one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scatterlake.llm.common import stage


#: So many links (16 bytes each) are solved by one task, which saves the rounds; more go by stars.
FEW = 1_000_000


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the links and the smallest node of its component, by hooking larger roots under smaller ones."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(flat := root[root], root):
            root = flat


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if got:
        node, root = roots(*(np.concatenate(x) for x in zip(*got, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v) with u > v.

    Large: every larger neighbour of a node is hung under the smallest node of
    its neighbourhood. Small: every smaller neighbour, and the node itself.
    Minimum by partial aggregation, then an equi-join: no neighbour list is
    ever collected. The minima are written before the join, so that both its
    sides come straight from an exchange and adaptive execution can split a
    node with a third of all links.
    """
    if large:
        around = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        least = stage(least, "least")
        out = around.join(least, around["u"] == least["w"]).where(F.col("v") > F.col("u"))
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = stage(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m"), "least")
        joined = edges.join(least, edges["u"] == least["w"])
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select(F.col("w").alias("u"), F.col("m").alias("v"))
        )
    return out.where(F.col("u") != F.col("v")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs under one root: none has two, and no root hangs under another."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up")).union(edges.select(F.col("v").alias("n"), F.lit(0).alias("up")))
    open_ = ends.groupBy("n").agg(F.sum("up").alias("above"), F.min("up").alias("all_up")).where((F.col("above") > 1) | ((F.col("above") > 0) & (F.col("all_up") == 0)))
    return open_.isEmpty()


def components(links: DataFrame, a: str, b: str, max_rounds: int = 60, few: int = FEW) -> DataFrame:
    """(node, root) of every node that has a link; root is the smallest of its component.

    ``links`` holds pairs of longs in either order; null ends and self links
    are ignored. Rounds grow with the logarithm of the longest chain.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = stage(edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))).distinct(), "links")
    if edges.count() <= few:
        return edges.select("u", "v").coalesce(1).mapInArrow(_in_one_task, "node long, root long")
    for _ in range(max_rounds):
        if _settled(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        edges = stage(_star(stage(_star(edges, True), "star"), False), "star")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
