"""Embedding near-dedup: an exact metric range join on the unit sphere.

cos(x, y) >= c is |x - y| <= r = sqrt(2 - 2c) for unit vectors, so the pairs of a label are a range join in a
Euclidean space. Equal vectors are one point with a count. Points are cut by pivots, farthest first: a point's home is the cell of its nearest pivot, and it is
copied into each cell i that could hold a neighbour: by the triangle inequality one whose bisecting plane
is at most r away, (|x - p_i|^2 - |x - p_home|^2) / (2 |p_i - p_home|) <= r, and whose pivot is at most r farther
than that cell's farthest home point. Cells that are too large for a task are written out and cut again, until they fit or pivots no longer separate;
then blocks of home points meet blocks of the cell. A cell that fits is cut by pivots once more in its task. Each pair is counted where its first point is
at home, so the counts add up without removing duplicates. The test itself is a cosine in double precision.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spent, spread_join
from .components import components

CELL = 8192  # points of a cell, or of a pair of blocks of one, that a task compares
PIVOTS = 64  # pivots that cut a cell
FEW = 128  # points that are compared without pivots
SLACK = 1e-9  # over the rounding of distances; it only copies more


def unit_rows(raw: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(usable, unit vectors in double precision). Null, empty and zero vectors and those with null or non-finite parts aren't usable."""
    usable, out = np.zeros(len(raw), bool), []
    for i, v in enumerate(raw):
        if v is None or len(v) == 0:
            continue
        try:
            x = np.asarray(v, np.float64)
        except (TypeError, ValueError):
            continue
        top = np.max(np.abs(x)) if np.isfinite(x).all() else 0.0
        if top > 0:
            x = x / top
            usable[i] = True
            out.append(x / np.sqrt(x @ x))
    return usable, out


def _unit(frames):
    """(vec, cell, v) -> points: unit vectors with a key that equal ones of a label share; a row that links with nothing has no key."""
    for pdf in frames:
        usable, out = unit_rows(pdf["v"])
        units = iter(out)
        keys, xs = [None] * len(pdf), [None] * len(pdf)
        for i in np.flatnonzero(usable):
            xs[i] = next(units)
            keys[i] = hashlib.blake2b(xs[i].tobytes(), digest_size=16, salt=int(pdf["cell"].iloc[i]).to_bytes(8, "little", signed=True)).digest()
        yield pd.DataFrame({"vec": pdf["vec"], "key": keys, "cell": pdf["cell"], "x": xs, "dim": [0 if x is None else len(x) for x in xs]})


def farthest_first(x: np.ndarray, n: int) -> np.ndarray:
    """Rows of at most n pivots: the first, then always the one farthest from those taken."""
    taken, d2 = [0], np.maximum(0, 2 - 2 * x @ x[0])
    while len(taken) < min(n, len(x)) and d2.max() > 1e-12:
        taken.append(int(d2.argmax()))
        d2 = np.minimum(d2, np.maximum(0, 2 - 2 * x @ x[taken[-1]]))
    return np.array(taken)


def voronoi(x: np.ndarray, p: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of points x and pivots p: each point's nearest pivot, the cells that its ball of the radius may reach, and all squared distances."""
    d2 = np.maximum(0, 2 - 2 * x @ p.T)
    near, each = d2.argmin(1), np.arange(len(x))
    between = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))
    reach = d2 - d2[each, near][:, None] <= 2 * (radius + SLACK) * between[near] + SLACK
    reach[each, near] = True
    return near, reach, d2


def _spread(radius: float, tally: bool):
    """One chunk of a cell and the cell's pivots -> each point at home with its nearest pivot, and its copies; or only how many rows each pivot gets."""

    def rows(part: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        columns = ["parent", "pivot", "n"] if tally else ["parent", "pivot", "vec", "x", "home", "dup", "times", "d"]
        if part.empty or pivots.empty:
            return pd.DataFrame(columns=columns)
        x, p = np.stack(part["x"].to_list()), np.stack(pivots.sort_values("bucket")["p"].to_list())
        p = p[farthest_first(p, PIVOTS)]
        near, reach, d2 = voronoi(x, p, radius)
        if tally:
            return pd.DataFrame({"parent": part["cell"].iloc[0], "pivot": np.arange(len(p)), "n": reach.sum(0)})
        who, where = np.nonzero(reach)
        home = (near[who] == where) & part["home"].to_numpy()[who]
        values = [part["cell"].to_numpy()[who], where, part["vec"].to_numpy()[who], part["x"].to_numpy()[who], home, part["dup"].to_numpy()[who], part["times"].to_numpy()[who], np.sqrt(d2[who, where])]
        return pd.DataFrame(dict(zip(columns, values, strict=True)))

    return rows


def meetings(x: np.ndarray, a: np.ndarray, o: np.ndarray, radius: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of a and rows of o to compare: by Voronoi cells, each with the rows of o that its windows let in."""
    if min(len(a), len(o)) <= FEW:
        return [(a, o)]
    p = x[a][farthest_first(x[a], PIVOTS)]
    near = voronoi(x[a], p, radius)[0]
    of, reach, d2 = voronoi(x[o], p, radius)
    out = []
    for i in range(len(p)):
        home = a[near == i]
        if len(home):
            far = np.sqrt(np.maximum(0, 2 - 2 * x[home] @ p[i]).max())
            out.append((home, o[reach[:, i] & ((of == i) | (np.sqrt(d2[:, i]) <= far + radius + 1e-6))]))
    return out


def _links(cosine: float, radius: float):
    """Of home points: the number of others within reach here, and a forest over all that are linked.

    In a cell the others are all its rows, in a pair of blocks those that aren't at home.
    """

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        vec, dup, times, x = pdf["vec"].to_numpy(), pdf["dup"].to_numpy(), pdf["times"].to_numpy(), np.stack(pdf["x"].to_list())
        home = pdf["home"].to_numpy()
        a, o = np.flatnonzero(home), np.flatnonzero(~home if pdf["blocks"].iloc[0] else np.ones(len(home), bool))
        count, root, found = np.zeros(len(x), np.int64), np.arange(len(x)), []
        for mine, others in meetings(x, a, o, radius):
            for at in range(0, len(mine), 512):
                m = mine[at : at + 512]
                hit = (x[m] @ x[others].T >= cosine) & (dup[m][:, None] != dup[others][None, :])
                count[m] += hit @ times[others]
                i, j = hit.any(1), hit.any(0)
                if i.any():
                    found.append((m[i], others[j], hit[np.ix_(i, j)]))
        while True:  # the smallest row over links; each pass joins all of a block at once
            before = root.copy()
            for m, others, hit in found:
                least = np.where(hit, root[others][None, :], len(x)).min(1)
                root[m] = np.minimum(root[m], least)
                back = np.where(hit, root[m][:, None], len(x)).min(0)
                root[others] = np.minimum(root[others], back)
            root = root[root]
            if (root == before).all():
                break
        least = pd.Series(vec).groupby(root).transform("min").to_numpy()
        counts = pd.DataFrame({"vec": vec[a], "dup": dup[a], "other": -1, "n": count[a]})
        tree = pd.DataFrame({"vec": vec, "dup": -1, "other": least, "n": -1})
        return pd.concat([counts, tree[tree["vec"] != tree["other"]].drop_duplicates()])

    return rows


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec, n_links, component, kept): vectors of one label link at cosine >= the threshold.

    Null labels, ids and unusable vectors link with nothing (n_links 0, component their own id). Vectors of different
    lengths never meet. Equal vectors link like any other pair; a repeated id counts each of its rows, and each of its rows has its vector's links. Columns
    beside the three are ignored, an empty table gives no rows.
    """
    radius = float(np.sqrt(2 - 2 * cosine))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    whole_row = F.col("vec").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    given = rows.where(whole_row).select("vec", F.xxhash64("label").alias("cell"), "v")
    points = cut(given.mapInPandas(_unit, "vec long, key binary, cell long, x array<double>, dim int"))
    # equal vectors are one point, with map-side combining; the smallest id names it
    one = points.where("key is not null").groupBy("key").agg(F.min("vec").alias("vec"), F.count("*").alias("times"), F.first(F.xxhash64("cell", "dim")).alias("cell"), F.first("x").alias("x"))
    one = cut(one.withColumn("dup", F.monotonically_increasing_id()))
    now = one.select("vec", "cell", "x", F.lit(True).alias("home"), "dup", "times")
    ready: list[DataFrame] = []
    columns = ["vec", "x", "home", "dup", "times"]
    while True:
        sizes = cut(now.groupBy("cell").agg(F.count("*").alias("rows"), F.count_if("home").alias("homes")).where("homes > 0"))
        kinds = sizes.agg(F.count_if(F.col("rows") <= CELL), F.count_if(F.col("rows") > CELL)).first()
        if kinds[0]:
            ready.append(now.join(sizes.where(F.col("rows") <= CELL).select("cell"), "cell").select(F.xxhash64("cell", F.lit(0), F.lit(0)).alias("task"), *columns, F.lit(False).alias("blocks")))
        if not kinds[1]:
            break
        large = now.join(sizes.where(F.col("rows") > CELL), "cell")
        # candidates for pivots: the smallest hash of each of some buckets, with map-side combining
        bucket = F.pmod(F.xxhash64(F.lit(1), "dup"), F.lit(4 * PIVOTS)).alias("bucket")
        pivots = large.groupBy("cell", bucket).agg(F.min_by("x", F.struct(F.xxhash64(F.lit(2), "dup"), F.col("dup"))).alias("p"), F.first("rows").alias("rows"))
        chunks = F.ceil(F.col("rows") / CELL)
        pivots = cut(pivots.select("cell", "bucket", "p", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk")))
        parts = large.withColumn("chunk", F.pmod(F.xxhash64(F.lit(4), "dup"), chunks)).select("cell", "chunk", *columns)
        # counted before anything is copied: where the copies would be many, blocks are cheaper
        ahead = parts.groupBy("cell", "chunk").cogroup(pivots.groupBy("cell", "chunk")).applyInPandas(_spread(radius, True), "parent long, pivot int, n long")
        after = ahead.groupBy("parent", "pivot").agg(F.sum("n").alias("rows")).groupBy("parent").agg(F.max("rows").alias("largest"), F.sum("rows").alias("all"))
        judged = sizes.where(F.col("rows") > CELL).join(after.withColumnRenamed("parent", "cell"), "cell", "left")
        # blocks of CELL / 2 points copy a row of a cell 2 * rows / CELL times on each side
        judged = cut(judged.withColumn("split", F.coalesce((F.col("largest") <= 0.7 * F.col("rows")) & (F.col("all") <= 4 * F.col("rows")), F.lit(False))))
        whole = now.join(judged.where("not split").select("cell", F.ceil(F.col("rows") / (CELL // 2)).alias("blocks")), "cell")
        mine = F.pmod(F.xxhash64(F.lit(5), "dup"), F.col("blocks"))
        every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
        a = whole.where("home").select("cell", mine.alias("b"), F.explode(every).alias("o"), "vec", "x", F.lit(True).alias("home"), "dup", "times")
        o = whole.select("cell", F.explode(every).alias("b"), mine.alias("o"), "vec", "x", F.lit(False).alias("home"), "dup", "times")
        ready.append(a.union(o).select(F.xxhash64("cell", F.col("b") + 1, F.col("o") + 1).alias("task"), *columns, F.lit(True).alias("blocks")))
        if judged.where("split").isEmpty():
            break
        cells = judged.where("split").select("cell")
        going = parts.join(cells, "cell", "left_semi").groupBy("cell", "chunk").cogroup(pivots.join(cells, "cell", "left_semi").groupBy("cell", "chunk"))
        spread = cut(going.applyInPandas(_spread(radius, False), "parent long, pivot int, vec long, x array<double>, home boolean, dup long, times long, d double"))
        reach = spread.where("home").groupBy("parent", "pivot").agg(F.max("d").alias("far"))
        near = spread.join(reach, ["parent", "pivot"]).where(F.col("home") | (F.col("d") <= F.col("far") + radius + 1e-6))
        now = cut(near.select(F.xxhash64("parent", "pivot").alias("cell"), *columns))
        spent(spread, pivots)
    work = ready[0] if ready else None
    for more in ready[1:]:
        work = work.union(more)
    none = points.where("key is null").select("vec").union(rows.where(~whole_row).select("vec")).select("vec", F.lit(0).cast("long").alias("n_links"), F.col("vec").alias("component"), F.col("vec").isNotNull().alias("kept"))
    if work is None:
        return none
    found = cut(work.groupBy("task").applyInPandas(_links(cosine, radius), "vec long, dup long, other long, n long"))
    counts = found.where("n >= 0").groupBy("dup").agg(F.sum("n").alias("n"))
    of = one.join(counts, "dup").select("key", F.col("vec").alias("named"), (F.col("n") + F.col("times") - 1).alias("n_links"))
    mine = cut(spread_join(points.select("vec", "key").where("key is not null"), of, "key", "vec").select("vec", "named", "n_links"))
    copies = mine.where("vec <> named").select("vec", F.col("named").alias("other"))
    joined = components(found.where("n < 0").select("vec", "other").union(copies), "vec", "other").withColumnRenamed("node", "vec")
    component = F.coalesce("component", "vec")
    out = mine.join(joined, "vec", "left").select("vec", F.col("n_links").cast("long").alias("n_links"), component.alias("component"), (component == F.col("vec")).alias("kept"))
    spent(one, found)
    return out.union(none)
