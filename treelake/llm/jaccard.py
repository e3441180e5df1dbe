"""N-gram Jaccard join: an exact metric-space join of documents by the Jaccard distance of their word shingles.

d(x, y) = 1 - |x & y| / |x | y| is a metric. Texts that aren't copies lie at a distance of
nearly 1 from each other, so pivots chosen among whole documents separate nothing at first.
The first level therefore takes its pivots in sub-spaces: the shingle universe is cut by a
hash into m parts, and a document's projections onto them are its pivots. Two documents
within the radius differ in at most D shingles, so of D + 1 parts one has no difference:
there both lie in the cell of the same pivot, with a window of radius zero. Documents near
the border of a size class are replicated into the class below (sizes of linked documents
differ by the threshold at most). Each cell becomes a Voronoi region around its smallest
document, and each document lies at an exact or a least distance from that pivot: histograms of shingles bound an
intersection from above, so shingle sets travel only to pairs that may link. Whoever lies within the radius links to the pivot.
The rest goes on: a document at distance e from the pivot can only link to documents at
e +- radius (triangle inequality), so the region shrinks to that window; one whose documents are joined by now is
done. A small region is finished in one task, by histograms first and by sets where those leave a pair. A large one is cut
again by pivots in fresh sub-spaces, and what is still large after that
by pivots from outside its main component, with documents replicated into every region whose pivot
is at most 2 radii farther than the nearest. Where this separates little, blocks of the documents outside
the main component meet blocks of the region. No pair is lost, and no task holds a region that is large.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, few_join, maybe_broadcast, semi_join, smallish_join, spent, spread_join
from .components import components
from .words import M1, M2, Words, mix

SMALL_DOCS, SMALL_SHINGLES = 512, 2_000_000  # shingle sets that one task joins
CROSS_DOCS, CROSS_WORK = 4096, 2_000_000_000  # histograms that one task compares: documents, and documents times shingles
CHUNK = 500_000  # rows (cell, doc) that a task sorts at a time
PIVOTS = 8  # new pivots of a region that is larger
ROUNDS = 3  # steps in which labels of joined documents spread between levels
FRESH = 1  # times that a large region is cut by fresh sub-spaces
COPIES = 200_000  # shingle sets that a task remembers to find equal ones; later copies meet in cells


def shingle_set(text: str | None, words: Words, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words make one shingle, none an empty set."""
    h = words(text)
    if not len(h):
        return h
    k = min(k, len(h))
    s = h[: len(h) - k + 1] * M1
    for i in range(1, k):  # an odd factor for each place keeps the order
        s += h[i : len(h) - k + 1 + i] * np.uint64(pow(int(M1), i + 1, 1 << 64))
    return np.unique(mix(s + np.uint64(k)))


class Classes:
    """Size classes: [low, high), and how many parts each has at the threshold num / den.

    A pair meets in the class of its smaller member, of size s < high. Its union is at most
    s * den / num, hence it differs in at most D = (den - num) * s // num shingles. Of D + 1 + e parts
    at least 1 + e have no difference. A document leaves out its smallest parts, at most e of them: parts of fewer than q
    shingles, for the largest such q. Among the equal parts of a pair one is left that has the larger q of the two.
    """

    def __init__(self, num: int, den: int, growth: float = 1.5, spare: float = 0.15):
        self.num, self.den, self.spare = num, den, spare
        self.edges = [1, max(2, num // (den - num) if den > num else 2)]
        while self.edges[-1] < 1 << 40:
            self.edges.append(int(self.edges[-1] * growth) + 1)
        self.high = np.array(self.edges[1:], np.int64)

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.high, n, "right"))

    def classes(self, n: int) -> range:
        return range(self.of(-(-self.num * n // self.den)), self.of(n) + 1)

    def parts(self, c: int) -> tuple[int, int]:
        differ = (self.den - self.num) * (int(self.high[c]) - 1) // self.num
        left_out = 0 if differ == 0 else 2 + int(self.spare * (differ + 1))
        return differ + 1 + left_out, left_out

    def signatures(self, s: np.ndarray, seed: int = 0) -> np.ndarray:
        """One 64-bit pivot name for each part, but the smallest, of each class that the set belongs to."""
        n = len(s)
        if seed:  # other parts
            s = mix(s + np.uint64(seed) * M2)
        low, high = (s & np.uint64(0xFFFFFFFF)).astype(np.float64), (s >> np.uint64(32)).astype(np.float64)
        out = []
        for c in self.classes(n):
            m, left_out = self.parts(c)
            part = (s % np.uint64(m)).astype(np.int64)
            full = np.bincount(part, minlength=m)
            a = np.bincount(part, low, m).astype(np.uint64)
            b = np.bincount(part, high, m).astype(np.uint64)
            name = mix(mix(a * M1 + b) + np.arange(m, dtype=np.uint64) * M2 + np.uint64(c + 1))
            out.append(name[full >= np.partition(full, left_out)[left_out]])
        return np.concatenate(out)


def histogram(s: np.ndarray) -> bytes | None:
    """How many shingles fall into each of 2**j buckets, j least with a bucket for each shingle, two counts in a byte; None where a count is over 15."""
    wide = max(16, 1 << (len(s) - 1).bit_length())
    count = np.bincount((s >> np.uint64(20)).astype(np.int64) & (wide - 1), minlength=wide).astype(np.uint8)
    return (count[::2] | count[1::2] << 4).tobytes() if count.max() <= 15 else None


def unpacked(h: bytes) -> np.ndarray:
    raw = np.frombuffer(h, np.uint8)
    out = np.empty(2 * len(raw), np.uint8)
    out[::2], out[1::2] = raw & 15, raw >> 4
    return out


def folded(count: np.ndarray, wide: int) -> np.ndarray:
    while count.shape[-1] > wide:
        half = count.shape[-1] // 2
        count = count[..., :half] + count[..., half:]
    return count


def most_common(x: np.ndarray | None, y: np.ndarray | None, n: int, m: int) -> int:
    """A bound from above on the shingles that sets of n and m shingles share; counts of a bucket fit a byte as long as widths differ by a factor of 16 at most."""
    if x is None or y is None or max(len(x), len(y)) > 16 * min(len(x), len(y)):
        return min(n, m)
    wide = min(len(x), len(y))
    return min(n, m, int(np.minimum(folded(x, wide), folded(y, wide)).sum(dtype=np.int64)))


def _leaders(cell: np.ndarray, doc: np.ndarray, last: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by (cell, doc): which begin a cell, and each row's smallest doc of its cell. `last` is the cell (and its leader) that went before."""
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    lead = doc[np.maximum.accumulate(np.where(first, np.arange(len(cell)), 0))]
    if last is not None and len(cell) and cell[0] == last[0]:
        lead[: int(np.argmin(cell == cell[0])) or len(cell)] = last[1]
        first[0] = False
    return first, lead


def _signature_rows(k: int, num: int, den: int):
    """Rows (kind, a, b, c, sketch): 0 = (doc, set size) with the set's digest and histogram, 1 = (cell, doc), 2 = (doc, an equal set's doc in the same task), 3 = (leader, doc, cell).

    A task sends the cells of equal sets once; the other copies link to the first. Of the documents that share a
    cell within a chunk of rows, only the smallest (the leader) is sent with it, and the others with their leader, so that no cell
    has more rows than there are chunks.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, classes, seen = Words(), Classes(num, den), {}
        cells, owners, held = [], [], 0

        def out(kind: int, a, b, c=None, sketch=None) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(a), 50_000):
                x, y = a[at : at + 50_000], b[at : at + 50_000]
                z = pa.nulls(len(x), pa.int64()) if c is None else pa.array(c[at : at + 50_000])
                sk = pa.nulls(len(x), pa.binary()) if sketch is None else pa.array(sketch[at : at + 50_000], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int8)), pa.array(x, pa.int64()), pa.array(y, pa.int64()), z, sk], ["kind", "a", "b", "c", "sketch"])

        def chunk() -> Iterator[pa.RecordBatch]:
            cell, doc = np.concatenate(cells).view(np.int64), np.concatenate(owners)
            order = np.lexsort((doc, cell))
            cell, doc = cell[order], doc[order]
            first, lead = _leaders(cell, doc)
            yield from out(1, cell[first], doc[first])
            other = lead != doc
            yield from out(3, lead[other], doc[other], cell[other])

        for batch in batches:
            docs, sizes, sketches, copies, firsts = batch.column(0).to_pylist(), [], [], [], []
            for doc, text in zip(docs, batch.column(1), strict=True):
                s = shingle_set(text.as_py(), words, k)
                sizes.append(len(s))
                if not len(s):
                    sketches.append(None)
                    continue
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                sketches.append(digest + (histogram(s) or b""))
                if len(seen) >= COPIES:
                    seen.clear()
                one = seen.setdefault(digest, doc)
                if one != doc:
                    copies.append(doc), firsts.append(one)
                    continue
                cells.append(classes.signatures(s)), owners.append(np.full(len(cells[-1]), doc, np.int64))
                held += len(cells[-1])
                if held >= CHUNK:
                    yield from chunk()
                    cells, owners, held = [], [], 0
            yield from out(0, docs, sizes, None, sketches)
            yield from out(2, copies, firsts)
        if held:
            yield from chunk()

    return rows


def _shared_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, region, leader) of the rows (cell, leader) of a partition, sorted: leaders that share a cell with a smaller one."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cell, doc = b.column(0).to_numpy(), b.column(1).to_numpy()
        _, lead = _leaders(cell, doc, last)
        last = (cell[-1], lead[-1])
        other = lead != doc
        yield pa.RecordBatch.from_arrays([pa.array(cell[other]), pa.array(lead[other]), pa.array(doc[other])], ["cell", "region", "leader"])


def _regions(rows: DataFrame) -> DataFrame:
    """(region, pivot, doc): whoever shares a cell stands in the region of its smallest document.

    Cells are shuffled once. A leader that meets a smaller one takes along its own documents of that cell, and no others.
    """
    signed = rows.where("kind = 1").select(F.col("a").alias("cell"), F.col("b").alias("leader"))
    met = cut(signed.repartition("cell").sortWithinPartitions("cell", "leader").mapInArrow(_shared_cells, "cell long, region long, leader long"))
    own = rows.where("kind = 3").select(F.col("c").alias("cell"), F.col("a").alias("leader"), F.col("b").alias("doc"))
    own = own.join(met, ["cell", "leader"], "left").select(F.coalesce("region", "leader").alias("region"), "doc")
    out = cut(met.select("region", F.col("leader").alias("doc")).union(own).where("region <> doc").distinct().select("region", F.col("region").alias("pivot"), "doc"))
    spent(met)
    return out


def _set_rows(k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            docs, sets, held = [], [], 0

            def out():
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                shingles = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), shingles], ["doc", "shingles"])

            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs.append(doc), sets.append(s := shingle_set(text.as_py(), words, k))
                held += len(s)
                if held >= 500_000:
                    yield out()
                    docs, sets, held = [], [], 0
            if docs:
                yield out()

    return rows


def _small_region(num: int, den: int):
    """All links of one region that fits in a task, as a forest over its documents."""

    def links(pdf):
        docs, sets = pdf["doc"].to_numpy(), list(pdf["shingles"])
        n, size = len(docs), np.array([len(s) for s in sets], np.int64)
        flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
        _, token, count = np.unique(flat, return_inverse=True, return_counts=True)
        keep = count[token] > 1  # a shingle of one document is in no intersection
        token, owner = np.unique(token[keep], return_inverse=True)[1], owner[keep]
        common = np.zeros((n, n))
        step = max(1, 4_000_000 // n)
        for at in range(0, int(token.max()) + 1 if len(token) else 0, step):
            here = (token >= at) & (token < at + step)
            block = np.zeros((n, step), np.float32)
            block[owner[here], token[here] - at] = 1
            common += block @ block.T
        common = np.rint(common).astype(np.int64)
        linked = den * common >= num * (size[:, None] + size[None, :] - common)
        root = np.arange(n)
        while True:  # smallest row reachable
            best = np.where(linked, root[None, :], n).min(axis=1)
            best = np.minimum(root, best)
            if (best == root).all():
                break
            root = best
        pdf = pdf[["doc"]].copy()
        pdf["other"] = docs[root]
        return pdf[pdf["doc"] != pdf["other"]].rename(columns={"doc": "a", "other": "b"})

    return links


def _star_rows(num: int, den: int):
    """(region, pivot, doc, n, pivot_n, sketch, pivot_sketch) -> the distance from the pivot, in millionths and rounded down, at least; and 0 = apart, 1 = may link, 2 = equal sets."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = b.column(3).to_numpy(), b.column(4).to_numpy()
            d, state, known, of = np.zeros(len(n), np.int64), np.zeros(len(n), np.int8), None, None
            for i, (x, y) in enumerate(zip(b.column(5), b.column(6), strict=True)):
                x, y = x.as_py(), y.as_py()
                if x[:16] == y[:16]:
                    state[i] = 2
                    continue
                if y is not known and y != known:
                    known, of = y, unpacked(y[16:]) if len(y) > 16 else None
                both = most_common(unpacked(x[16:]) if len(x) > 16 else None, of, int(n[i]), int(m[i]))
                union = int(n[i] + m[i]) - both
                d[i], state[i] = (union - both) * 1_000_000 // union, den * both >= num * union
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(d), pa.array(state)], ["region", "pivot", "doc", "n", "d", "state"])

    return rows


def crossing(n: np.ndarray, component: np.ndarray, sketches: list[bytes], num: int, den: int) -> np.ndarray:
    """Which documents may link to one of another component, as far as histograms tell; n is ascending."""
    keep, top = np.zeros(len(n), bool), np.searchsorted(n, n * den // num, "right")
    wide = [max(16, 1 << (int(x) - 1).bit_length()) for x in n]
    at = 0
    while at < len(n):
        w, end = wide[at], at + wide[at:].count(wide[at])
        # where a histogram is missing, every count may be any
        mat = np.stack([folded(unpacked(h[16:]), w) if 16 < len(h) and wide[at + j] <= 16 * w else np.full(w, 255, np.uint8) for j, h in enumerate(sketches[at : top[end - 1]])])
        for i in range(at, end):
            other = i + 1 + np.flatnonzero(component[i + 1 : top[i]] != component[i])
            if len(other):
                both = np.minimum(np.minimum(mat[other - at], mat[i - at]).sum(1, dtype=np.int64), n[i])
                other = other[den * both >= num * (n[i] + n[other] - both)]
                keep[other] = True
                keep[i] |= len(other) > 0
        at = end
    return keep


def _crossing_rows(num: int, den: int):
    """Rows (region, doc, n, component, sketch), whole regions sorted by n -> (region, doc, n, component) of those that may link across components."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def kept(t: pa.Table) -> pa.RecordBatch:
            n, component = t["n"].to_numpy(), t["component"].to_numpy()
            mask = pa.array(crossing(n, component, t["sketch"].to_pylist(), num, den))
            t = t.select(["region", "doc", "n", "component"]).filter(mask).combine_chunks()
            return t.to_batches()[0] if t.num_rows else pa.RecordBatch.from_pylist([], t.schema)

        for b in batches:
            if not b.num_rows:
                continue
            region = b.column(0).to_numpy()
            ends = np.append(np.flatnonzero(region[1:] != region[:-1]) + 1, len(region))
            begin = 0
            for end in ends.tolist():
                if held and held[0]["region"][0].as_py() != region[begin]:
                    yield kept(pa.concat_tables(held))
                    held = []
                held.append(pa.Table.from_batches([b.slice(begin, end - begin)]))
                begin = end
        if held:
            yield kept(pa.concat_tables(held))

    return rows


class _Join:
    """The steps of one join: its texts, what is known of each document, and the links found."""

    def __init__(self, texts: DataFrame, facts: DataFrame, links: list[DataFrame], k: int, num: int, den: int):
        self.texts, self.facts, self.links, self.k, self.num, self.den = texts, facts, links, k, num, den
        self.radius = (den - num) * 1_000_000 // den + 2  # in millionths; 2 covers the rounding of two distances

    def some(self, docs: DataFrame) -> DataFrame:
        """Texts of these documents. The texts are the heavy side: they stay where they are while the ids are few enough to go to them, and beyond that all but those that a bitmap of the ids lets in."""
        return semi_join(self.texts, docs, "doc", docs.count())

    def sets(self, docs: DataFrame) -> DataFrame:
        return cut(self.some(docs).mapInArrow(_set_rows(self.k), "doc long, shingles array<long>").where("size(shingles) > 0"))

    def sketches(self, rows: DataFrame) -> DataFrame:
        """The rows (doc, ...), each with n and sketch of its document; one for each text of a document."""
        known = self.facts.where("sketch is not null")
        return known.join(maybe_broadcast(rows, rows.count()), "doc")

    def distances(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Adds to (region, pivot, doc) the exact distance in millionths (rounded down), whether the two link, and the size."""
        n = pairs.count()
        mine = sets.join(maybe_broadcast(pairs.select("region", "pivot", "doc"), n), "doc")
        of = semi_join(sets, pairs.select(F.col("pivot").alias("doc")), "doc", n).select(F.col("doc").alias("pivot"), F.col("shingles").alias("of_pivot"))
        both = smallish_join(mine, of, "pivot", "doc", "of_pivot", 8)
        both = both.withColumn("i", F.size(F.array_intersect("shingles", "of_pivot")).cast("long")).withColumn("u", F.size("shingles") + F.size("of_pivot") - F.col("i"))
        return both.select("region", "pivot", "doc", F.expr("(u - i) * 1000000 div u").alias("d"), F.expr(f"{self.den} * i >= {self.num} * u").alias("linked"), F.size("shingles").cast("long").alias("n"))

    def star(self, regions: DataFrame) -> DataFrame:
        """(region, pivot, doc, d, linked, n): exact for documents that link, for others at least the distance."""
        ids = cut(regions.select(F.col("pivot").alias("doc")).distinct())
        of = cut(self.sketches(ids).select(F.col("doc").alias("pivot"), F.col("n").alias("pivot_n"), F.col("sketch").alias("pivot_sketch")))
        rows = smallish_join(self.sketches(regions), of, "pivot", "doc", "pivot_sketch").select("region", "pivot", "doc", "n", "pivot_n", "sketch", "pivot_sketch")
        judged = cut(rows.mapInArrow(_star_rows(self.num, self.den), "region long, pivot long, doc long, n long, d long, state byte"))
        pairs = cut(judged.where("state = 1").select("region", "pivot", "doc"))
        sure = judged.where("state <> 1").select("region", "pivot", "doc", "d", (F.col("state") == 2).alias("linked"), "n")
        if pairs.isEmpty():
            return sure
        sets = self.sets(cut(pairs.select("doc").union(pairs.select("pivot")).distinct()))
        met = cut(sure.union(self.distances(pairs, sets)))
        spent(ids, of, judged, pairs, sets)
        return met

    def window(self, met: DataFrame) -> DataFrame:
        """What a region still has to compare after its pivot: from the nearest unlinked document less the radius on."""
        far = met.where("not linked").groupBy("region").agg(F.min("d").alias("far"))
        return met.join(far, "region").where(F.col("d") >= F.col("far") - self.radius).select("region", "doc", "n")

    def labels(self) -> DataFrame:
        """(doc, label): a document that each linked one is joined with, in few rounds towards the smallest; equal labels mean joined, unequal ones that it isn't known yet."""
        links = _union(self.links).select("a", "b")
        both = cut(links.union(links.select("b", "a")).toDF("doc", "other").distinct())
        now = cut(both.groupBy("doc").agg(F.min("other").alias("other")).select("doc", F.least("doc", "other").alias("label")))
        for _ in range(ROUNDS):
            n = now.count()
            met = few_join(both, now.withColumnRenamed("doc", "other"), "other", "doc", n).groupBy("doc").agg(F.min("label").alias("label"))
            met = met if n <= BROADCAST_ROWS else cut(met)  # its hot labels are counted first
            # every label is a document with a label
            jumped = few_join(met, now.select(F.col("doc").alias("label"), F.col("label").alias("further")), "label", "doc", n)
            last, now = now, cut(jumped.select("doc", F.least("doc", "label", "further").alias("label")))
            spent(last, met)
        spent(both)
        return now

    def unjoined(self, rest: DataFrame) -> DataFrame:
        """(region, doc, n, component): the documents of regions that aren't known to be joined by now; component is their label."""
        named = self.labels()
        few = maybe_broadcast(named, named.count())
        of = rest.join(few, "doc", "left").select("region", "doc", "n", F.coalesce("label", "doc").alias("component"))
        of = cut(of.groupBy("region", "doc").agg(F.max("n").alias("n"), F.min("component").alias("component")))
        parts = of.groupBy("region").agg(F.min("component").alias("least"), F.max("component").alias("most"))
        out = cut(of.join(parts.where("least <> most").select("region"), "region", "left_semi"))
        spent(of, named)
        return out

    def finish(self, rows: DataFrame) -> None:
        """Joins regions (region, doc, n, component) whose histograms fit in a task: by these, and by sets, in blocks, what they leave."""
        near = self.sketches(rows.select("region", "doc", "component")).select("region", "doc", "n", "component", "sketch")
        near = near.repartition("region").sortWithinPartitions("region", "n", "doc").mapInArrow(_crossing_rows(self.num, self.den), "region long, doc long, n long, component long")
        left = cut(near)
        if not left.isEmpty():
            sizes = left.groupBy("region").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
            wide = sizes.where(f"docs > {SMALL_DOCS} or shingles > {SMALL_SHINGLES}").select("region", F.lit(True).alias("wide"))
            of = cut(left.join(wide, "region", "left"))
            tasks = cut(of.where("wide is null").select("region", "doc").union(_blocks(_odd(of.where("wide")), SMALL_DOCS, SMALL_SHINGLES).select("region", "doc")))
            sets = self.sets(cut(left.select("doc").distinct()))
            with_sets = sets.join(maybe_broadcast(tasks, tasks.count()), "doc").select("region", "doc", "shingles")
            self.links.append(cut(with_sets.groupBy("region").applyInPandas(_small_region(self.num, self.den), "a long, b long")))
            spent(sets, of, tasks)
        spent(left)

    def fresh(self, large: DataFrame, seed: int) -> DataFrame:
        """(region, pivot, doc): large regions cut by cells of fresh sub-spaces; a pair that links shares a cell in these, too."""
        ids = cut(large.select("doc").distinct())
        cells = self.some(ids).mapInArrow(_cell_rows(self.k, self.num, self.den, seed), "doc long, cell long")
        signed = cut(cells.join(maybe_broadcast(large.select("region", "doc"), large.count()), "doc").select("region", F.xxhash64("region", "cell").alias("cell"), "doc"))
        least = cut(signed.groupBy("cell").agg(F.min("doc").alias("pivot"), F.max("doc").alias("most")).where("pivot <> most").select("cell", "pivot"))
        # a pair that shares a region and a cell of it meets at the cell's smallest document; regions around one pivot are one
        out = cut(spread_join(signed, least, "cell", "doc").where("doc <> pivot").select(F.col("pivot").alias("region"), "pivot", "doc").distinct())
        spent(ids, signed, least)
        return out

    def by_pivots(self, large: DataFrame) -> DataFrame:
        """Cuts large regions by pivots among themselves; returns (region, pivot, doc, d, linked, n) of the new regions, and finishes those that don't separate."""
        large = cut(_odd(large))
        # with map-side combining: of each of some buckets of odd documents, the smallest
        bucket = lambda j: F.min(F.when(F.col("odd") & (F.pmod(F.xxhash64("doc"), F.lit(PIVOTS)) == j), F.col("doc")))
        pivots = large.groupBy("region").agg(*[bucket(j).alias(f"p{j}") for j in range(PIVOTS)])
        pivots = cut(pivots.select("region", F.explode(F.array(*[f"p{j}" for j in range(PIVOTS)])).alias("pivot")).where("pivot is not null"))
        sets = self.sets(cut(large.select("doc").distinct()))
        met = cut(self.distances(cut(large.join(pivots, "region").select("region", "pivot", "doc")), sets))
        self.links.append(cut(_near(met)))
        of_pivots = pivots.select("region", F.col("pivot").alias("doc"))
        met = met.join(of_pivots, ["region", "doc"], "left_anti")
        nearest = met.groupBy("region", "doc").agg(F.min("d").alias("nearest"))
        spread = cut(met.join(nearest, ["region", "doc"]).where(F.col("d") <= F.col("nearest") + 2 * self.radius).drop("nearest"))
        copies = cut(spread.groupBy("region").agg((F.count("*") / F.count_distinct("doc")).alias("copies"), F.count_distinct("pivot").alias("cells")))
        # where the windows would replicate more than the cells separate, blocks finish the region
        whole = large.join(copies.where("copies > 2 or cells = 1").select("region"), "region", "left_semi").join(of_pivots, ["region", "doc"], "left_anti")
        blocks = cut(_blocks(whole, CROSS_DOCS, CROSS_WORK // CROSS_DOCS))
        if not blocks.isEmpty():
            self.finish(blocks)
        out = spread.join(copies.where("copies <= 2 and cells > 1").select("region"), "region", "left_semi")
        out = cut(out.withColumn("region", F.xxhash64("region", "pivot")).select("region", "pivot", "doc", "d", "linked", "n"))
        spent(large, pivots, sets, spread, copies, blocks)
        return out

    def run(self, regions: DataFrame) -> None:
        """Finds all links within regions (region, pivot, doc); each round leaves smaller regions."""
        met, level = self.star(regions), 0
        while True:
            self.links.append(cut(_near(met)))
            rest = self.unjoined(self.window(met))
            sizes = cut(rest.groupBy("region").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles")))
            small = f"docs <= {CROSS_DOCS} and docs * shingles <= {CROSS_WORK}L"
            kinds = sizes.agg(F.count_if(F.expr(small)), F.count_if(F.expr(f"not ({small})"))).first()
            if kinds[0]:
                self.finish(rest.join(sizes.where(small).select("region"), "region", "left_semi"))
            if not kinds[1]:
                spent(rest, sizes)
                return
            large, level = cut(rest.join(sizes.where(f"not ({small})").select("region"), "region", "left_semi")), level + 1
            met = self.star(self.fresh(large, level)) if level <= FRESH else self.by_pivots(large)
            spent(rest, sizes, large)


def _near(met: DataFrame) -> DataFrame:
    return met.where("linked and doc <> pivot").select(F.col("doc").alias("a"), F.col("pivot").alias("b")).distinct()


def _cell_rows(k: int, num: int, den: int, seed: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, classes = Words(), Classes(num, den)
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = shingle_set(text.as_py(), words, k)
                if len(s):
                    cells = classes.signatures(s, seed).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), doc, np.int64)), pa.array(cells)], ["doc", "cell"])

    return rows


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def _odd(rows: DataFrame) -> DataFrame:
    """Marks the documents of a region outside its most frequent component."""
    most = rows.groupBy("region", "component").agg(F.count("*").alias("rows")).groupBy("region").agg(F.max_by("component", F.struct("rows", "component")).alias("most"))
    return rows.join(most, "region").select("region", "doc", "n", "component", (F.col("component") != F.col("most")).alias("odd"))


def _blocks(rest: DataFrame, docs: int, shingles: int) -> DataFrame:
    """Cuts regions into blocks that fit in a task, and pairs each block of odd documents with each block of the region.

    Pairs within the most frequent component are linked already; all others have an odd member and so meet in some task.
    """
    limit = F.greatest(F.ceil(F.sum("n") / max(1, shingles // 2)), F.ceil(F.count("*") / max(1, docs // 2)))
    whole = rest.groupBy("region").agg(limit.alias("all_blocks"))
    odd = rest.where("odd").groupBy("region").agg(limit.alias("odd_blocks"))
    both = rest.join(whole.join(odd, "region"), "region")
    h = F.xxhash64(F.lit(3), "doc")
    every = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    a = both.select("region", F.pmod(h, F.col("all_blocks")).alias("x"), F.explode(every("odd_blocks")).alias("y"), "doc", "n", "component")
    b = both.where("odd").select("region", F.explode(every("all_blocks")).alias("x"), F.pmod(h, F.col("odd_blocks")).alias("y"), "doc", "n", "component")
    return a.union(b).distinct().select(F.xxhash64("region", "x", "y").alias("region"), "doc", "n", "component")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(doc, n_shingles, component): documents link when |x & y| / |x | y| >= num / den.

    component is the smallest id reachable over links. Null or wordless texts have
    an empty set and link with nothing. Rows of the same id count as one
    document if their texts agree, else each text links for the id. A null id is returned with its
    size and no component. Other columns of the input are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    known = docs.where("doc is not null")
    rows = cut(known.mapInArrow(_signature_rows(k, num, den), "kind byte, a long, b long, c long, sketch binary"))
    facts = cut(rows.where("kind = 0").select(F.col("a").alias("doc"), F.col("b").alias("n"), "sketch"))
    copies = cut(rows.where("kind = 2").select("a", "b"))
    regions = _regions(rows)
    spent(rows)
    join = _Join(known, facts, [copies], k, num, den)
    join.run(regions)
    joined = components(_union(join.links), "a", "b")
    spent(regions, *join.links)
    out = facts.select("doc", F.col("n").alias("n_shingles")).join(joined.withColumnRenamed("node", "doc"), "doc", "left")
    out = out.select("doc", "n_shingles", F.coalesce("component", "doc").alias("component"))
    nameless = docs.where("doc is null").withColumn("doc", F.lit(0).cast("long")).mapInArrow(_set_rows(k), "doc long, shingles array<long>")
    none = F.lit(None).cast("long")
    return out.union(nameless.select(none, F.size("shingles").cast("long"), none))
