"""Language-model scoring with a hashed maximum-entropy model and a class-factored softmax.

P(word | history) = P(class | history) * P(part | class, history) * P(word | class, part). A word's class comes from its ending, so that unseen words have one, and
endings are clustered by the company they keep in all training texts. P(class | history) is a softmax
over hashed features of the three classes before: n-grams (1, 1-2, 1-2-3 back) and skips (2, 3, 1 and 3 back). The words of a class fall into parts
by their hash; P(part | class, history) is a softmax within the class over hashed features of the words before: n-grams (1, 1-2 back) and a skip (2 back).
P(word | class, part) is (count + 1) / (tokens of the part + its words + 1), the last 1 being for all its unseen words, so all probabilities of a history add up to 1.

Counts cover every training text: pairs of endings, words, class 4-grams, and parts after hashed words. Gradient updates
run over the 4-gram table on the executors, which return one summed gradient for each partition; the parts' weights start from their counts and are
scaled by expectations over every training token, summed on the executors. Word counts are looked up in a dictionary of the most frequent words of bounded size, and joined for all other words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spent
from .words import M1, M2, Words, mix

C = 32  # classes; 0 is the end of a text
PARTS = 8  # parts of a class
CONTEXTS = C**3
HEAD = 200_000  # words of the broadcast dictionary: 16 bytes each
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += 32
END = np.uint64(0x6A09E667F3BCC909)
END_PART = int(END >> np.uint64(7)) & PARTS - 1


@dataclass(frozen=True)
class Params:
    endings: int = 512
    features: int = 4096
    partitions: int = 8
    steps: int = 12
    rate: float = 0.15
    l2: float = 1e-7
    rows: int = 1024  # hashed word features of each class
    pull: float = 40.0  # tokens that hold a row's weights to what the class says
    share: float = 0.6  # of each feature's own evidence, as features overlap
    scalings: int = 1  # rounds over all training tokens


def endings(data: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """A number below n for each word from its last three bytes."""
    at = lambda k: np.where(end - k >= start, LOWER[data[np.maximum(end - k, 0)]] + np.uint64(1), np.uint64(0))
    return (mix(at(1) | at(2) << np.uint64(9) | at(3) << np.uint64(18)) % np.uint64(n)).astype(np.int64)


def _meet(p: Params):
    """Rows (key, n): how often ending b follows a by 1 to 3 words as key a * endings + b, how often b occurs as key endings**2 + b. Summed within the task."""
    size = p.endings**2

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total, codes, held = Words(), np.zeros(size + p.endings, np.int64), [], 0
        for b in batches:
            for text in b.column(0):
                _, data, start, end = words.spans(text.as_py())
                if not len(start):
                    continue
                at = endings(data, start, end, p.endings)
                codes.append(size + at)
                codes += [at[:-gap] * p.endings + at[gap:] for gap in (1, 2, 3) if len(at) > gap]
                held += 4 * len(at)
                if held >= 2_000_000:
                    total += np.bincount(np.concatenate(codes), minlength=len(total))
                    codes, held = [], 0
        if codes:
            total += np.bincount(np.concatenate(codes), minlength=len(total))
        key = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(total[key])], ["key", "n"])

    return rows


def meetings(texts: DataFrame, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(endings x endings counts of pairs, counts of endings) over every text; at most endings**2 + endings rows reach the driver."""
    found = texts.mapInArrow(_meet(p), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(p.endings**2 + p.endings)
    total[found.column("key").to_numpy()] = found.column("n").to_numpy()
    return total[: p.endings**2].reshape(p.endings, p.endings), total[p.endings**2 :]


def cluster(met: np.ndarray, freq: np.ndarray, p: Params) -> np.ndarray:
    """ending -> class in 1 .. C - 1, by k-means over the leading directions of the endings' positive mutual information."""
    n = p.endings
    if not freq.sum():
        return 1 + np.arange(n) % (C - 1)
    met = met + met.T + 1e-3
    share = met.sum(1) / met.sum()
    info = np.maximum(0, np.log(met / met.sum() / (share[:, None] * share[None, :])))
    u, s, _ = np.linalg.svd(info)
    x = u[:, :12] * s[:12]
    order = np.argsort(-freq, kind="stable")
    centres = x[order[: C - 1]].copy()
    for _ in range(25):
        to = ((x[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
        for k in range(C - 1):
            w = freq * (to == k)
            if w.sum():
                centres[k] = (x * w[:, None]).sum(0) / w.sum()
    return to + 1


class Tokens:
    """Word hashes and classes of a text, its end included."""

    def __init__(self, classes: np.ndarray, p: Params):
        self.words, self.classes, self.p = Words(), classes, p

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        h, data, start, end = self.words.spans(text)
        kinds = self.classes[endings(data, start, end, self.p.endings)] if len(h) else np.empty(0, np.int64)
        return np.append(h, END), np.append(kinds, 0)


def word_rows(h: np.ndarray, kinds: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(three rows of weights, the part) of each token of whole texts that follow each other. Only 32 bits of a word's hash are used."""
    h = h.astype(np.uint64) & np.uint64(0xFFFFFFFF)
    end = END & np.uint64(0xFFFFFFFF)
    one = np.concatenate([[end], h[:-1]])
    two = np.where(one == end, end, np.concatenate([[end, end], h[:-2]])[: len(h)])
    base, n = kinds.astype(np.int64) * p.rows, np.uint64(p.rows)
    hashed = [mix(v + np.uint64(tag)) % n for tag, v in ((1, one), (2, two * M2), (3, one * M1 + two * M2))]
    return np.stack([base + x.astype(np.int64) for x in hashed], 1), (h >> np.uint64(7) & np.uint64(PARTS - 1)).astype(np.int64)


def part_log_p(weights: np.ndarray, prior: np.ndarray, rows: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Natural logarithms of P(part | class, words before), a row for each token."""
    z = prior[kinds] + weights[rows[:, 0]] + weights[rows[:, 1]] + weights[rows[:, 2]]
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def cells(kinds: np.ndarray) -> np.ndarray:
    """(3 back, 2 back, 1 back, class) of each token as one number; before the text stands its end."""
    k = np.concatenate([np.zeros(3, np.int64), kinds])
    return ((k[:-3] * C + k[1:-2]) * C + k[2:-1]) * C + k[3:]


def feature_ids(p: Params) -> np.ndarray:
    """The features of every context, hashed into p.features rows behind the single classes' own rows."""
    c = np.arange(CONTEXTS)
    c3, c2, c1 = c // (C * C), c // C % C, c % C
    hashed = lambda tag, v: (3 * C + (mix(np.uint64(tag) * np.uint64(CONTEXTS) + v.astype(np.uint64)) % np.uint64(p.features)).astype(np.int64))
    return np.stack([c1, C + c2, 2 * C + c3, hashed(1, c2 * C + c1), hashed(2, c3 * C + c1), hashed(3, c3 * C + c2), hashed(4, c)], 1)


def log_p(weights: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Natural logarithms of P(class | context), a row for each row of feature ids. The last row of the weights is the bias."""
    z = weights[-1] + weights[ids].sum(1)
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def _count(classes: np.ndarray, p: Params):
    """Rows (kind, key, form, n, tokens): 0 = a word's count and class, 1 = a class 4-gram's count, 2 = a part's count after a hashed word feature, 3 = a run of whole texts' tokens, kept for training. Counted within the task first."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, grams, parts = Tokens(classes, p), np.zeros(CONTEXTS * C, np.int64), np.zeros(C * p.rows * PARTS, np.int64)
        hashes, kinds, held = [], [], 0

        def out(kind: int, key: np.ndarray, form: np.ndarray, n: np.ndarray, kept: list | None = None) -> pa.RecordBatch:
            blob = pa.nulls(len(key), pa.binary()) if kept is None else pa.array(kept, pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), pa.array(key.view(np.int64)), pa.array(form.astype(np.int32)), pa.array(n.astype(np.int64)), blob], ["kind", "key", "form", "n", "tokens"])

        def counted() -> Iterator[pa.RecordBatch]:
            h, k = np.concatenate(hashes), np.concatenate(kinds)
            key, first, n = np.unique(h, return_index=True, return_counts=True)
            yield out(0, key, k[first], n)
            at, part = word_rows(h, k, p)
            for f in range(3):
                parts[:] += np.bincount(at[:, f] * PARTS + part, minlength=len(parts))
            one = np.zeros(1, np.int64)
            yield out(3, one, one, np.array([len(h)]), [(h & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + k.astype(np.uint8).tobytes()])

        for b in batches:
            for text in b.column(0):
                h, k = tokens(text.as_py())
                np.add.at(grams, cells(k), 1) if len(k) < 64 else None
                if len(k) >= 64:
                    code, n = np.unique(cells(k), return_counts=True)
                    grams[code] += n
                hashes.append(h), kinds.append(k)
                held += len(h)
                if held >= 800_000:
                    yield from counted()
                    hashes, kinds, held = [], [], 0
        if held:
            yield from counted()
        for kind, table in ((1, grams), (2, parts)):
            key = np.flatnonzero(table)
            if len(key):
                yield out(kind, key, np.zeros(len(key)), table[key])

    return rows


def train(grams: DataFrame, p: Params) -> np.ndarray:
    """Weights by Adam on the whole table's likelihood; each step is one distributed sum of gradients. The best step's weights are kept."""
    sc = grams.sparkSession.sparkContext
    parts = cut(grams.select(F.expr(f"key div {C}").alias("context"), (F.col("key") % C).cast("int").alias("class"), "n").repartition(p.partitions, "context"))
    prior = np.ones(C)
    for r in parts.groupBy("class").agg(F.sum("n").alias("n")).collect():
        prior[r["class"]] += r.n
    total = prior.sum() - C
    w = np.zeros((3 * C + p.features + 1, C))
    w[-1] = np.log(prior / prior.sum())
    if total <= 0:
        return w
    after = np.full((C, C), 0.0)  # what the class before says, as a start
    for r in parts.groupBy((F.col("context") % C).alias("c1"), "class").agg(F.sum("n").alias("n")).collect():
        after[r.c1, r["class"]] = r.n
    w[:C] = np.log((after + prior / prior.sum() * 5) / (after.sum(1, keepdims=True) + 5)) - w[-1]

    def step_rows(weights):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = [np.concatenate(c) for c in zip(*[[b.column(i).to_numpy() for i in range(3)] for b in batches if b.num_rows], strict=True)]
            if not at:
                return
            context, to = np.unique(at[0], return_inverse=True)
            n = np.zeros((len(context), C))
            np.add.at(n, (to, at[1]), at[2])
            ids = feature_ids(p)[context]
            lp = log_p(weights.value, ids)
            loss = -(n * lp).sum()
            grad = np.exp(lp) * n.sum(1, keepdims=True) - n
            full = np.zeros((3 * C + p.features + 1, C))
            for f in range(ids.shape[1]):
                np.add.at(full, ids[:, f], grad)
            full[-1] = grad.sum(0)
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([full.astype(np.float32).tobytes()], pa.binary())], ["loss", "grad"])

        return rows

    mean, var, best, least = np.zeros_like(w), np.zeros_like(w), w, np.inf
    for t in range(1, p.steps + 1):
        shared = sc.broadcast(w)
        sums = parts.mapInArrow(step_rows(shared), "loss double, grad binary").collect()
        loss = sum(r.loss for r in sums) / total
        if loss < least:
            best, least = w, loss
        g = sum(np.frombuffer(r.grad, np.float32).reshape(w.shape).astype(np.float64) for r in sums) / total + p.l2 * w
        mean, var = 0.8 * mean + 0.2 * g, 0.99 * var + 0.01 * g * g
        w = w - p.rate * (mean / (1 - 0.8**t)) / (np.sqrt(var / (1 - 0.99**t)) + 1e-9)
        shared.unpersist()
    return best


def train_parts(counts: DataFrame, kept: DataFrame, prior: np.ndarray, p: Params) -> np.ndarray:
    """Weights of the hashed word features: from counts (key, n), then scaled so that what the model expects over all kept tokens meets them. Sums of at most C * rows * PARTS numbers reach the driver."""
    shape = (C * p.rows, PARTS)

    def dense(found: pa.Table) -> np.ndarray:
        out = np.zeros(shape[0] * PARTS)
        out[found.column("key").to_numpy()] = found.column("n").to_numpy()
        return out.reshape(shape)

    seen = dense(counts.groupBy("key").agg(F.sum("n").alias("n")).toArrow())
    likely = np.exp(np.repeat(prior, p.rows, axis=0))
    weights = (p.share * np.log((seen + p.pull * likely) / ((seen.sum(1, keepdims=True) + p.pull) * likely))).astype(np.float32)
    for _ in range(p.scalings):
        shared = kept.sparkSession.sparkContext.broadcast((weights, prior.astype(np.float32)))

        def expected(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            weights, prior = shared.value
            total = np.zeros(shape, np.float64)
            for b in batches:
                for blob, n in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                    raw = blob.as_buffer()
                    h, k = np.frombuffer(raw, "<u4", n), np.frombuffer(raw, np.uint8, n, 4 * n)
                    rows, _ = word_rows(h, k, p)
                    for at in range(0, n, 100_000):
                        r = rows[at : at + 100_000]
                        share = np.exp(part_log_p(weights, prior, r, k[at : at + 100_000]))
                        own, times = r.ravel(), np.repeat(share, 3, axis=0)
                        for j in range(PARTS):
                            total[:, j] += np.bincount(own, times[:, j], shape[0])
            flat = total.ravel()
            key = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(flat[key])], ["key", "n"])

        sums = kept.mapInArrow(expected, "key long, n double").groupBy("key").agg(F.sum("n").alias("n"))
        meets = dense(sums.toArrow())
        weights = (weights + np.log((seen + p.pull * likely) / (meets + p.pull * likely)) / 3).astype(np.float32)
        shared.unpersist()
    return weights


def frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) by key of the words from the least count on that at most HEAD words reach."""
    top = 100_000  # the histogram has at most so many rows
    found = counts.groupBy(F.least("c", F.lit(top)).alias("c")).agg(F.count("*").alias("words")).collect()
    least, held = top + 1, 0
    for r in sorted(found, key=lambda r: -r.c):
        held += r.words
        if held > HEAD:
            break
        least = r.c
    rows = counts.where(F.col("c") >= least).select("key", "c").toArrow()
    key, c = rows.column("key").to_numpy(), rows.column("c").to_numpy()
    order = np.argsort(key)
    return key[order], c[order]


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out=None, p: Params = Params()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learned from rows where held_out is false.

    Null and empty texts have one token, their end. Without a training text all counts are 0 and classes equally likely. Rows
    with null or repeated ids are learned from and scored one by one. Other columns are ignored.
    """
    spark = docs.sparkSession
    flag = F.lit(False) if held_out is None else held_out
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), flag.alias("held_out"))
    training = docs.where("not held_out")
    classes = cluster(*meetings(training.select("text"), p), p)
    rows = cut(training.select("text").mapInArrow(_count(classes, p), "kind byte, key long, form int, n long, tokens binary"))
    counts = cut(rows.where("kind = 0").groupBy("key").agg(F.sum("n").alias("c"), F.max("form").alias("form")))
    weights = train(rows.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")), p)
    size = np.zeros((C, PARTS, 2))
    part = F.shiftright("key", 7).bitwiseAND(F.lit(PARTS - 1).cast("long")).alias("part")
    for r in counts.groupBy("form", part).agg(F.sum("c").alias("tokens"), F.count("*").alias("words")).collect():
        size[r.form, r.part] = r.tokens, r.words
    total, distinct = (int(x) for x in size.sum((0, 1)))
    head = frequent(counts)
    within = np.log10(size.sum(2) + 1)
    prior = np.log((size[:, :, 0] + 1) / (size[:, :, 0] + 1).sum(1, keepdims=True))
    by_word = train_parts(rows.where("kind = 2").select("key", "n"), rows.where("kind = 3").select("tokens", "n"), prior, p)
    spent(rows)
    table = np.empty((CONTEXTS, C), np.float32)
    ids = feature_ids(p)
    for at in range(0, CONTEXTS, 4096):  # sparse batches: seven rows of weights for each context
        table[at : at + 4096] = log_p(weights, ids[at : at + 4096]) / np.log(10)
    shared = spark.sparkContext.broadcast((classes, *head, table.ravel(), by_word, prior.astype(np.float32), within))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts: (row, 0, doc, held_out, tokens, known words of the dictionary, their sum, sum over classes); other words: (row, 1, hash, null, times, ...)."""
        classes, known, count, table, by_word, prior, within = shared.value
        logs, tokens = np.log10(count + 1.0), Tokens(classes, p)
        row = TaskContext.get().partitionId() << 33
        names = ["row", "kind", "a", "held_out", "n", "known", "counts", "classes"]
        for b in batches:
            texts, rest, words, held = [], [], [], 0

            def out() -> pa.RecordBatch:
                h, k = (np.concatenate(c) for c in zip(*words, strict=True))
                rows, part = word_rows(h, k, p)
                logs = np.empty(len(h))
                for at in range(0, len(h), 100_000):
                    lp = part_log_p(by_word, prior, rows[at : at + 100_000], k[at : at + 100_000])
                    logs[at : at + 100_000] = lp[np.arange(len(lp)), part[at : at + 100_000]]
                logs = np.where(k > 0, logs / np.log(10), 0) - within[k, np.where(k > 0, part, END_PART)]
                first = np.cumsum([0] + [len(x) for x, _ in words[:-1]])
                more = np.add.reduceat(logs, first).tolist()
                cols = [list(c) for c in zip(*texts, strict=True)]
                cols[6] = [a + b for a, b in zip(cols[6], more, strict=True)]
                r, k, n = (np.concatenate(c) for c in zip(*rest, strict=True))
                pad = [None] * len(r)
                data = [cols[0] + r.tolist(), [0] * len(texts) + [1] * len(r), cols[1] + k.tolist(), cols[2] + pad, cols[3] + n.tolist(), cols[4] + pad, cols[5] + pad, cols[6] + pad]
                kinds = [pa.int64(), pa.int8(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                return pa.RecordBatch.from_arrays([pa.array(d, t) for d, t in zip(data, kinds, strict=True)], names)

            for doc, text, apart in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                h, k = tokens(text.as_py())
                words.append((h, k))
                h = h.view(np.int64)
                at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
                hit = known[at] == h if len(known) else np.zeros(len(h), bool)
                other, n = np.unique(h[~hit], return_counts=True)
                texts.append((row, doc, apart, len(h), int(hit.sum()), float(logs[at[hit]].sum()), float(table[cells(k)].sum(dtype=np.float64))))
                rest.append((np.full(len(other), row), other, n))
                row += 1
                held += 1 + len(h)
                if held >= 200_000:
                    yield out()
                    texts, rest, words, held = [], [], [], 0
            if texts:
                yield out()

    found = cut(docs.select("doc_id", "text", "held_out").mapInArrow(scored, "row long, kind byte, a long, held_out boolean, n long, known long, counts double, classes double"))
    tail = found.where("kind = 1").select("row", F.col("a").alias("key"), "n").join(counts.select("key", "c"), "key")
    tail = tail.groupBy("row").agg(F.sum("n").alias("tail_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("tail_counts"))
    out = found.where("kind = 0").join(tail, "row", "left")
    sums = F.col("counts") + F.coalesce("tail_counts", F.lit(0.0))
    return out.select(
        F.col("a").alias("doc_id"), "held_out", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (sums - F.col("n") * F.lit(float(np.log10(total + distinct + 1)))).alias("base_score"), (sums + F.col("classes")).alias("score"),
    )
