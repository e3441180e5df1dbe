"""Connected components by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import cut, spent, spread_join

LOCAL = 200_000  # edges that a task joins at a time before the first shuffle


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) as stars over the smallest node that is reachable within a chunk of the task's edges."""

    def star(ab: list[np.ndarray]) -> pa.RecordBatch:
        edges = np.concatenate(ab)
        nodes, flat = np.unique(edges, return_inverse=True)
        x, y = flat.reshape(-1, 2).T
        root = np.arange(len(nodes))
        while True:
            least = np.minimum(root[x], root[y])
            new = root.copy()
            np.minimum.at(new, x, least)
            np.minimum.at(new, y, least)
            np.minimum.at(new, root, new)
            new = new[new]
            if (new == root).all():
                break
            root = new
        other = root != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[root[other]])], ["a", "b"])

    held, rows = [], 0
    for b in batches:
        held.append(np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1))
        rows += b.num_rows
        if rows >= LOCAL:
            yield star(held)
            held, rows = [], 0
    if rows:
        yield star(held)


def _least(rows: DataFrame) -> DataFrame:
    """(u, m, rows): the smallest v of each u of rows (u, v), and how many there are. One row a node, written so that joins know its size."""
    return cut(rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
    least = _least(both)
    joined = spread_join(both.where("v > u"), least.select("u", F.least("u", "m").alias("m")), "u", "v", least.select("u", "rows"))
    return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = _least(down)
    moved = spread_join(down, least.select("u", "m"), "u", "v", least.select("u", "rows")).where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("u", "m")).distinct()


def _step(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written, with their count and an order-free hash: equal exactly when a step changed nothing."""
    seen = Observation()
    out = cut(edges.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("hash")))
    return out, (seen.get["rows"], seen.get["hash"])


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of at least one edge.

    Null ends and loops are ignored. Tasks first join the edges that they have. A node's edges are met by min() with map-side
    combining and by joins that deal a hub's edges over copies of its row, so a hub doesn't
    end in one task. Each step is written to the shared folder; the driver
    sees only a count and a hash per step.
    """
    plain = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    now, after = _step(plain.mapInArrow(_forest, "a long, b long").distinct())
    before = None
    while after != before and after[0]:
        before, last = after, now
        now, after = _step(_small_star(_large_star(last)))
        spent(last)
    root = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return root.union(now.select("b", F.col("b").alias("component")).distinct())
