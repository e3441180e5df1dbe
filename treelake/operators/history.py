"""Commit history and reachability: closure with bounds, prune, log, ancestry, delta chains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import cut

ALL = 1 << 30  # a bound that keeps every parent


def closure(roots: DataFrame, edges: DataFrame, resets: DataFrame | None = None) -> DataFrame:
    """(node, bound): nodes reachable from roots (node, bound) over edges (src, dst), a bound falling by one with each edge.

    A node counts with the largest bound that reaches it, so it is visited again only with a larger one.
    `resets` (node, bound) replaces what a node would inherit. Works on cycles. The edges are written once; each round joins only the
    rows that changed and appends what it found, so that a lost executor costs one round; the largest bounds are taken at the end.
    """
    edges = cut(edges.select(F.col("src").alias("node"), "dst"))
    frontier = cut(roots.groupBy("node").agg(F.max("bound").alias("bound")))
    found = [frontier]
    while not frontier.isEmpty():
        step = frontier.where("bound > 0").join(edges, "node").select(F.col("dst").alias("node"), (F.when(F.col("bound") >= ALL, F.col("bound")).otherwise(F.col("bound") - 1)).alias("bound"))
        if resets is not None:
            own = resets.withColumnRenamed("bound", "own")
            step = step.join(own, "node", "left").select("node", F.coalesce("own", "bound").alias("bound"))
        step = step.groupBy("node").agg(F.max("bound").alias("bound"))
        known = reduce(DataFrame.unionByName, found).select("node", F.col("bound").alias("known"))
        frontier = cut(step.join(known, (step.node == known.node) & (step.bound <= known.known), "left_anti"))
        found.append(frontier)
    return reduce(DataFrame.unionByName, found).groupBy("node").agg(F.max("bound").alias("bound"))


def jumps(commits: DataFrame) -> list[DataFrame]:
    """(checksum, to) frames: the parents 1, 2, 4, ... steps back, as long as there are any. n rows at most in each, log2 of the longest history of them."""
    out = [cut(commits.where("parent is not null").select("checksum", F.col("parent").alias("to")))]
    while not out[-1].isEmpty():
        ahead = out[-1].select(F.col("checksum").alias("to"), F.col("to").alias("far"))
        out.append(cut(out[-1].join(ahead, "to").select("checksum", F.col("far").alias("to"))))
    return out[:-1]


def behind(nodes: DataFrame, back: list[DataFrame]) -> DataFrame:
    """(checksum): the nodes and all that lies behind them, in as many rounds as there are jumps: each covers twice as far."""
    now = nodes.select("checksum").distinct()
    for jump in back:
        now = cut(now.unionByName(now.join(jump, "checksum").select(F.col("to").alias("checksum"))).distinct())
    return now


def depths(nodes: DataFrame, back: list[DataFrame]) -> DataFrame:
    """(checksum, depth): how many parents lie behind each distinct node; the longest jumps first."""
    now = nodes.select("checksum").distinct().select("checksum", F.col("checksum").alias("at"), F.lit(0).cast("long").alias("depth"))
    for i in range(len(back) - 1, -1, -1):
        step = back[i].select(F.col("checksum").alias("at"), "to")
        now = now.join(step, "at", "left").select("checksum", F.coalesce("to", "at").alias("at"), (F.col("depth") + F.when(F.col("to").isNotNull(), 1 << i).otherwise(0)).alias("depth"))
    return cut(now.select("checksum", "depth"))


def climb(rows: DataFrame, node: str, steps: str, back: list[DataFrame]) -> DataFrame:
    """Adds `up`: the ancestor so many steps behind the node; null where there are fewer."""
    now = rows.withColumn("up", F.col(node))
    for i in range(len(back) - 1, -1, -1):
        step = back[i].select(F.col("checksum").alias("up"), "to")
        taken = F.col(steps).bitwiseAND(F.lit(1 << i).cast("long")) != 0
        now = now.join(step, "up", "left").withColumn("up", F.when(taken, F.col("to")).otherwise(F.col("up"))).drop("to")
    return now.withColumn("up", F.when(F.col(steps) < 1 << len(back), F.col("up")))


def positions(commits: DataFrame, order: list[str], by: str = "branch") -> DataFrame:
    """Distance from the tip in linear branches, without a recursive step."""
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    return commits.withColumn("depth", F.row_number().over(w) - 1)


def since(commits: DataFrame, order: list[str], ts: str, bound, by: str = "branch") -> DataFrame:
    """Keep the tip and its parents while they are not older than the bound; the first older one ends the branch."""
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    n = commits.withColumn("depth", F.row_number().over(w) - 1)
    least = F.min(F.when(F.col("depth") > 0, F.col(ts))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return n.withColumn("least", least).where((F.col("depth") == 0) | (F.col("least") >= bound)).drop("least")


def fast_forward(commits: DataFrame, updates: DataFrame) -> DataFrame:
    """Adds to (ref, old, new) whether the old tip is the new one or an ancestor of it: the new tip's ancestor at the old one's depth decides."""
    back = jumps(commits)
    deep = depths(updates.select(F.col("old").alias("checksum")).union(updates.select("new")).where("checksum is not null"), back)
    of = lambda c: deep.select(F.col("checksum").alias(c), F.col("depth").alias(f"{c}_depth"))
    rows = updates.join(of("old"), "old", "left").join(of("new"), "new", "left").withColumn("steps", F.greatest(F.col("new_depth") - F.col("old_depth"), F.lit(0)))
    at = climb(rows, "new", "steps", back)
    return at.withColumn("fast_forward", F.coalesce((F.col("up") == F.col("old")) & (F.col("old_depth") <= F.col("new_depth")), F.lit(False))).drop("up", "steps", "old_depth", "new_depth")


def shortest_chain(edges: DataFrame, have: DataFrame, target: str) -> DataFrame:
    """(step, src, dst): the fewest deltas from a commit that is there to the target; ties go to the smaller source. Backward breadth-first search."""
    dist = cut(edges.sparkSession.range(1).select(F.lit(target).alias("node"), F.lit(0).alias("dist"), F.lit(None).cast("string").alias("next")))
    frontier = dist
    while not frontier.isEmpty():
        step = edges.join(frontier.select(F.col("node").alias("dst"), "dist"), "dst").groupBy(F.col("src").alias("node")).agg((F.min("dist") + 1).alias("dist"), F.min("dst").alias("next"))
        frontier = cut(step.join(dist.select("node"), "node", "left_anti").select("node", "dist", "next"))
        dist = cut(dist.unionByName(frontier))
        if not frontier.join(have.select(F.col("checksum").alias("node")), "node", "left_semi").isEmpty():
            break
    start = dist.join(have.select(F.col("checksum").alias("node")), "node", "left_semi").orderBy("dist", "node").limit(1)
    path = cut(start.where("next is not null").select(F.lit(1).alias("step"), F.col("node").alias("src"), F.col("next").alias("dst")))
    last = path
    while not last.isEmpty():
        on = last.select(F.col("dst").alias("node"), "step").join(dist, "node").where("next is not null")
        last = cut(on.select((F.col("step") + 1).alias("step"), F.col("node").alias("src"), F.col("next").alias("dst")))
        path = path.unionByName(last)
    return path


def prune(objects: DataFrame, reached: DataFrame) -> DataFrame:
    """Objects (checksum, otype, size) that nothing reaches; sidecars (otype 6) follow their commit, tombstones (5) stay."""
    return objects.where("otype <> 5").join(reached.select("checksum").distinct(), "checksum", "left_anti")


def chain_lengths(edges: DataFrame, have: DataFrame) -> DataFrame:
    """(node, deltas): for every commit that deltas (src, dst) reach from what is there, the fewest of them; one breadth-first search for all targets."""
    edges = cut(edges.select(F.col("src").alias("node"), "dst").distinct())
    frontier = cut(have.select(F.col("checksum").alias("node")).distinct().withColumn("deltas", F.lit(0).cast("long")))
    found = [frontier]
    while not frontier.isEmpty():
        step = frontier.join(edges, "node").select(F.col("dst").alias("node"), F.col("deltas") + 1).toDF("node", "deltas").distinct()
        frontier = cut(step.join(reduce(DataFrame.unionByName, found).select("node"), "node", "left_anti"))
        found.append(frontier)
    return reduce(DataFrame.unionByName, found)


def roots(refs: DataFrame, weak: Column) -> DataFrame:
    """Adds kind and root: a weak ref doesn't keep what it names."""
    return refs.withColumn("kind", F.when(weak, "weak").otherwise("strong")).withColumn("root", ~weak)


def complete(markers: DataFrame, commits: DataFrame, holds: DataFrame, arrived: DataFrame) -> DataFrame:
    """(checksum, still_partial) of the marked commits after a run: whether an object (k, object) of theirs hasn't arrived."""
    marked = commits.join(markers, "checksum", "left_semi")
    lacking = holds.join(marked.select("k"), "k", "left_semi").join(arrived.select(F.col("checksum").alias("object")), "object", "left_anti").select("k").distinct()
    return marked.join(lacking.withColumn("still_partial", F.lit(True)), "k", "left").select("checksum", F.coalesce("still_partial", F.lit(False)).alias("still_partial"))


def expired(ts: Column, now: Column, age: int) -> Column:
    return now - ts > age


def log(commits: DataFrame, stored: DataFrame, order: list[str], by: str = "branch") -> DataFrame:
    """(by, checksum, depth, stop) newest first along linear branches, up to the first commit that isn't stored; stop marks the one whose parent is missing."""
    there = commits.join(stored.select("checksum").distinct().withColumn("there", F.lit(True)), "checksum", "left")
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    rows = there.withColumn("depth", F.row_number().over(w) - 1).withColumn("gone", F.max(F.col("there").isNull()).over(w)).withColumn("next_gone", F.lead(F.col("there").isNull()).over(w))
    return rows.where(~F.col("gone")).select(by, "checksum", F.col("depth").cast("long").alias("depth"), F.coalesce("next_gone", F.lit(False)).alias("stop"))
