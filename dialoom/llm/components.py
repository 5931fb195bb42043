"""Connected components of an edge table by alternating large-star and small-star steps.

Before each round the tasks contract what lies in their own edges, a block at a time. Each round is two joins of the edges with the smallest neighbour of each node, whose partial aggregates keep hubs
small; plain equi-joins let adaptive execution split a hub's partition. Rounds are written to the shared folder,
so lineage ends there and lost executors cost no more than one round."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import stored


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Point the neighbours of each node (small: the smaller ones and itself; else the larger ones) to its least neighbour."""
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    joined = both.join(least, F.col("u") == F.col("w"))
    if small:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    else:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def spanning(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links (a, b) some that join the same rows; label (a representative of each row so far) is brought up to date."""
    left, right = [], []
    while True:
        x, y = label[a], label[b]
        apart = np.flatnonzero(x != y)
        if not len(apart):
            return tuple(np.concatenate([np.zeros(0, np.int64), *z]) for z in (left, right))
        a, b, x, y = a[apart], b[apart], np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        order = np.lexsort((x, y))
        one = order[np.concatenate([[True], np.diff(y[order]) > 0])]  # each larger label joins its least neighbour
        left.append(a[one])
        right.append(b[one])
        up = np.arange(len(label))
        up[y[one]] = x[one]
        while True:
            nxt = up[up]
            if (nxt == up).all():
                break
            up = nxt
        label[:] = up[label]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block of edges as stars (u, v): every node but the least of its component in the block, and that."""

    def stars(held: list) -> pa.RecordBatch:
        u, v = (np.concatenate(x) for x in zip(*held))
        nodes, back = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = np.arange(len(nodes))
        spanning(label, back[: len(u)], back[len(u) :])
        own = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[label[own]])], ["u", "v"])

    held, size = [], 0
    for b in batches:
        held.append((np.asarray(b.column(0)), np.asarray(b.column(1))))
        size += b.num_rows
        if size > 500_000:
            yield stars(held)
            held, size = [], 0
    if size:
        yield stars(held)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node of an edge with the least node that it reaches. Loops and repeated edges are ignored."""
    some = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v")
    now = stored(some.mapInArrow(_contracted, "u long, v long").distinct(), "edges")
    state = None
    while True:
        mark = now.select(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if mark == state or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = mark
        now = stored(_star(_star(now, small=False), small=True).mapInArrow(_contracted, "u long, v long").distinct(), "edges")
