"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import keep

#: Up to so many edges (16 bytes each) one task finds the components at once.
ONE_TASK = 2_000_000


def components_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node of each one's component, by hooking and jumping."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        differ = rx != ry
        if not differ.any():
            return nodes, nodes[root]
        x, y, rx, ry = x[differ], y[differ], rx[differ], ry[differ]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


def _one(it):
    parts = [(np.asarray(t.column(0)), np.asarray(t.column(1))) for t in it]
    if parts:
        nodes, roots = components_of(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        for lo in range(0, len(nodes), 1 << 16):
            yield pa.record_batch({"node": nodes[lo : lo + (1 << 16)], "root": roots[lo : lo + (1 << 16)]})


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", one_task: int = ONE_TASK) -> DataFrame:
    """(node, root): each node of the edges with its component's least node.

    Nodes are 64-bit integers; rows with a null and self loops give no edge. A
    small graph is one task's work. Beyond ``one_task`` edges, large-star and
    small-star rounds alternate until no edge changes, each round written to the
    shared folder; no node's neighbours are ever gathered in one row.
    """
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    e = keep(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if e.count() <= one_task:
        return keep(e.coalesce(1).mapInArrow(_one, "node long, root long"), "components")
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = keep(large, "large-star")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        small = keep(small.where("a <> b").distinct(), "small-star")
        now = small.exceptAll(e).isEmpty() and e.exceptAll(small).isEmpty()
        e = small
        if now:
            return keep(e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct(), "components")
