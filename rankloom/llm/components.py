"""Distributed connected components of an edge table.

Each round, every vertex takes the smallest vertex among itself and its neighbours as its parent; parents are replaced by
their own parents until each vertex points at its tree's root, which takes steps in the logarithm of a tree's depth; then
the edges are rewritten to roots, with loops and repeats dropped. A root that no vertex took has only neighbours of other,
smaller trees, so it joins one of them in the next round: two rounds at least halve the vertices, whatever the order of the
ids. The graph shrinks until no edge is left; then roots are composed from the last round back to the first. A vertex's root
is the smallest id of its component. Minimum and deduplication are pre-aggregated on the map side, and the joins are plain
equality joins that AQE can split, so a star whose centre has a third of all edges is spread over tasks. Nothing is
collected to the driver but whether edges are left and whether a step changed anything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import Scratch, tidy


def _forest(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of stars (vertex, smallest vertex) that connect what the given edges connect."""
    ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    u, v, parent = at[: len(src)], at[len(src) :], np.arange(len(ids))
    while True:
        pu, pv = parent[u], parent[v]
        low = np.minimum(pu, pv)
        before = parent.copy()
        np.minimum.at(parent, pu, low)
        np.minimum.at(parent, pv, low)
        while not np.array_equal(parent, up := parent[parent]):
            parent = up
        if np.array_equal(parent, before):
            break
    keep = parent != np.arange(len(ids))
    return ids[keep], ids[parent[keep]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace each batch of edges by a spanning forest: fewer edges, same connections."""
    for b in batches:
        src, dst = _forest(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])


def _rooted(up: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, parent) with every parent replaced by the root of its tree."""
    while True:
        inner = up.where("id <> parent").select(F.col("id").alias("parent"), F.col("parent").alias("above"))
        step = up.join(inner, "parent", "left").select("id", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved"))
        found = scratch.table(step, "parents")
        scratch.drop(up)
        if found.where("moved").isEmpty():
            return found
        up = found


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(src long, dst long) -> (id long, root long) for every vertex that has an edge to another vertex.

    Null ends and loops are ignored. An empty edge table gives an empty result. Rounds go on until no edge is left.
    """
    clean = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src <> dst")
    left = scratch.table(clean.mapInArrow(tidy(_contract), "src long, dst long"), "edges")
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        both = left.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.*")
        up = scratch.table(both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("low")).select("id", F.least("id", "low").alias("parent")), "parents")
        up = _rooted(up, scratch)
        rounds.append(up)
        a = up.select(F.col("id").alias("src"), F.col("parent").alias("a"))
        b = up.select(F.col("id").alias("dst"), F.col("parent").alias("b"))
        moved = left.join(a, "src").join(b, "dst").where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
        rest = scratch.table(moved, "edges")
        scratch.drop(left)
        left = rest
    if not rounds:
        return left.select(F.col("src").alias("id"), F.col("dst").alias("root"))
    # A vertex that leaves the graph is a root; the later table knows where its parent went.
    roots = rounds[-1].select("id", F.col("parent").alias("root"))
    for up in reversed(rounds[:-1]):
        later = roots.select(F.col("id").alias("parent"), "root")
        roots = up.join(later, "parent", "left").select("id", F.coalesce("root", "parent").alias("root"))
    out = scratch.table(roots, "roots")
    scratch.drop(left, *rounds)
    return out
