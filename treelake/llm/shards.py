"""K-d tree sharding: shards of nearly equal bytes that are boxes in the documents' metadata.

The root holds all documents and all shards. A node of s > 1 shards is split along the dimension that is widest in it (extent over the
whole table's extent) at the weighted quantile that gives floor(s / 2) / s of its bytes to the left.
All nodes of a level are split together. The quantile is found by histograms: bytes by (node, key prefix) are
summed with map-side combining, the bucket that holds the quantile is refined until it is one key, so the driver sees
at most shards * 2**BITS numbers at a time. A key is a dimension's value with a hash of the document behind it: a value that
holds a third of all rows is split like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BITS = 12  # of a key that one histogram refines
VALUE_BITS, KEY_BITS = 24, 60  # the rest of a key is the tie-breaking hash
FINE = 10_000  # a quantile needs no refinement within this part of a shard's bytes
SALTS = 64


@dataclass
class Node:
    first: int  # shard
    shards: int
    name: int
    dim: int = 0
    cut: int = 0  # keys up to it go left
    left: Node | None = None
    right: Node | None = None


def _tree(node: Node, leaf) -> Column:
    """The row's leaf as an expression that has each node once."""
    if node.left is None:
        return F.lit(leaf(node))
    return F.when(F.col(f"__{node.dim}") <= node.cut, _tree(node.left, leaf)).otherwise(_tree(node.right, leaf))


def _of(by_node: dict[int, Column]) -> Column:
    out = F.lit(None).cast("long")
    for name, value in by_node.items():
        out = F.when(F.col("node") == name, value).otherwise(out)
    return out


def _scaled(value: Column, low: float, high: float) -> Column:
    """The value as VALUE_BITS bits between the table's least and greatest; null first."""
    top = (1 << VALUE_BITS) - 2
    return F.coalesce(F.floor((value - F.lit(low)) / F.lit(max(high - low, 1e-9)) * top).cast("long") + 1, F.lit(0).cast("long"))


def _quantiles(keyed: DataFrame, nodes: list[Node], want: dict[int, float], fine: float) -> dict[int, int]:
    """For each node the key up to which its bytes come nearest to what is wanted; bytes by key prefix, refined where it falls."""
    prefix, below, done = {n.name: 0 for n in nodes}, {n.name: 0 for n in nodes}, {}
    for shift in range(KEY_BITS - BITS, -1, -BITS):
        live = [n.name for n in nodes if n.name not in done]
        if not live:
            break
        here = keyed.where(F.col("node").isin(live) & (F.shiftright("key", shift + BITS) == _of({n: F.lit(prefix[n]) for n in live})))
        by: dict[int, list] = {}
        for r in here.groupBy("node", F.shiftright("key", shift).alias("bucket")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect():
            by.setdefault(r.node, []).append(r)
        for n in live:
            for r in sorted(by.get(n, []), key=lambda r: r.bucket):
                prefix[n] = r.bucket
                if below[n] + r.bytes >= want[n]:
                    break
                below[n] += r.bytes
            else:
                done[n] = (prefix[n] + 1 << shift) - 1
                continue
            if r.rows == 1 or r.bytes <= fine or shift == 0:
                over = below[n] + r.bytes - want[n] > want[n] - below[n]
                done[n] = (prefix[n] << shift) - 1 if over else (prefix[n] + 1 << shift) - 1
    return done


def kd_shards(docs: DataFrame, dims: dict[str, Column], size: Column, shards: int) -> DataFrame:
    """The input's columns and `shard` (0 .. shards - 1) and `slot` (its place in the shard, gapless from 0).

    dims: numeric expressions over the input. Rows are cut between neighbours in key order, so that a shard's
    size differs from its share by about a row for each level of the tree. Nulls in a dimension sort first; repeated rows
    are told apart by a number. Columns named shard or slot are replaced. An empty table gives no rows.
    """
    keep = [c for c in docs.columns if c not in ("shard", "slot")]
    each = range(len(dims))
    values = [v.cast("double").alias(f"__{i}") for i, v in enumerate(dims.values())]
    rows = cut(docs.select(*[F.col(f"`{c}`") for c in keep], size.cast("long").alias("__size"), *values, F.monotonically_increasing_id().alias("__row")))
    ends = rows.agg(F.sum("__size").alias("bytes"), *[f(f"__{i}").alias(f"{k}{i}") for i in each for k, f in (("a", F.min), ("b", F.max))]).first()
    tie = F.shiftrightunsigned(F.xxhash64("__row"), 64 - KEY_BITS + VALUE_BITS)
    keys = [(_scaled(F.col(f"__{i}"), ends[f"a{i}"] or 0.0, ends[f"b{i}"] or 0.0) * (1 << KEY_BITS - VALUE_BITS) + tie).alias(f"__{i}") for i in each]
    thin = cut(rows.select("__row", F.col("__size").alias("size"), *keys))
    root = Node(0, shards, 0)
    level, named = [root] if shards > 1 else [], 1
    while level:
        placed = thin.withColumn("node", _tree(root, lambda n: n.name)).where(F.col("node").isin([n.name for n in level]))
        extent = {r.node: r for r in placed.groupBy("node").agg(F.sum("size").alias("bytes"), *[f(f"__{i}").alias(f"{k}{i}") for i in each for k, f in (("a", F.min), ("b", F.max))]).collect()}
        for n in level:
            if r := extent.get(n.name):
                n.dim = max(each, key=lambda i: ((r[f"b{i}"] >> KEY_BITS - VALUE_BITS) - (r[f"a{i}"] >> KEY_BITS - VALUE_BITS), -i))
        live = [n for n in level if n.name in extent]
        keyed = placed.select("node", "size", _of({n.name: F.col(f"__{n.dim}") for n in live}).alias("key"))
        want = {n.name: extent[n.name].bytes * (n.shards // 2) / n.shards for n in live}
        cuts = _quantiles(keyed, live, want, (ends.bytes or 0) / shards / FINE)
        below = []
        for n in level:
            n.cut = cuts.get(n.name, 0)
            n.left, n.right = Node(n.first, n.shards // 2, named), Node(n.first + n.shards // 2, n.shards - n.shards // 2, named + 1)
            named += 2
            below += [x for x in (n.left, n.right) if x.shards > 1]
        level = below
    where = thin.select("__row", _tree(root, lambda n: n.first).cast("int").alias("shard"), F.pmod(F.xxhash64("__row"), F.lit(SALTS)).cast("int").alias("salt"))
    counts = where.groupBy("shard", "salt").agg(F.count("*").alias("rows"))  # at most shards * SALTS rows
    before = counts.select("shard", "salt", (F.sum("rows").over(Window.partitionBy("shard").orderBy("salt")) - F.col("rows")).alias("before"))
    slots = where.withColumn("at", F.row_number().over(Window.partitionBy("shard", "salt").orderBy("__row")))
    slots = slots.join(F.broadcast(before), ["shard", "salt"]).select("__row", "shard", (F.col("before") + F.col("at") - 1).alias("slot"))
    return rows.join(slots, "__row").select(*[F.col(f"`{c}`") for c in keep], "shard", "slot")
