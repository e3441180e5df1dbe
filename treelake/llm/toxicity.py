"""Toxicity by non-negative positive-unlabelled learning over the presence of words and stems.

The learner sees confirmed toxic documents and unlabelled ones (no document counts as a confirmed clean one), and minimises
    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])
with logistic loss; where the bracket falls below zero its gradient is reversed, as in the non-negative estimator.
A bounded sample trains it; every whole text is scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, maybe_broadcast, spent
from .words import mix

WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Params:
    """rows and buckets bound the sample: about `rows` documents of each kind are read, one for each bucket is kept."""

    rows: int = 20_000
    positive_buckets: int = 2048
    unlabelled_buckets: int = 4096
    features: int = 512
    min_positive: int = 3  # sampled toxic documents that a word must be in,
    min_share: float = 0.015  # and the share of them
    purity: float = 0.6  # least estimated share of toxic documents among those with the word,
    sure_purity: float = 0.25  # and its lower bound by so many deviations of the count
    deviations: float = 2.0
    steps: int = 400
    rate: float = 0.1
    l2: float = 1e-4
    threshold: float = 0.7


def words_of(text: str | None) -> set[str]:
    """The words of a text, and the stems of its longer words: their first four and five letters, marked as such."""
    words = set(WORD.findall(text.lower())) if text else set()
    return words | {f"{w[:4]}*" for w in words if len(w) > 4} | {f"{w[:5]}*" for w in words if len(w) > 5}


def family(words: list[str]) -> int:
    """A number that near copies often share and other texts don't: the smallest of the words' hashes in each of three orders, hashed."""
    if not words:
        return 0
    h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    least = [mix(h * np.uint64(2 * seed + 1)).min() for seed in range(1, 4)]
    return xxhash.xxh64_intdigest(np.array(least).tobytes()) >> 1


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [sorted(words_of(t.as_py())) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([family(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.string()))], ["positive", "least", "words"])


def _sample(rows: DataFrame, buckets: int) -> DataFrame:
    """(positive, words): of each bucket the row of the smallest hash."""
    bucket = F.pmod(F.xxhash64("least"), F.lit(buckets))
    return rows.groupBy(bucket.alias("bucket")).agg(F.first("positive").alias("positive"), F.min_by("words", F.struct(F.xxhash64("words"), F.col("words"))).alias("words")).drop("bucket")


def _places(ranked: list[str]):
    """(positive, words) -> (positive, the features' places): a row of the design matrix, of at most one number for each feature."""
    index = {w: i for i, w in enumerate(ranked)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [sorted(index[w] for w in ws if w in index) for ws in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.list_(pa.int32()))], ["positive", "at"])

    return rows


def nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, p: Params) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear score g, by full-batch Adam on the non-negative risk."""
    x = np.vstack([positive, unlabelled]).astype(np.float32)
    n, m = len(positive), len(unlabelled)
    w, b = np.zeros(x.shape[1], np.float64), 0.0
    mean, var = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, p.steps + 1):
        g = x @ w + b
        up, down = 1 / (1 + np.exp(np.clip(g, -50, 50))), 1 / (1 + np.exp(np.clip(-g, -50, 50)))  # -l'(g), l'(-g)
        bracket = np.logaddexp(0, g[n:]).mean() - prior * np.logaddexp(0, g[:n]).mean()
        slope = np.empty(n + m)
        if bracket >= 0:
            slope[:n] = -prior * up[:n] / n - prior * down[:n] / n
            slope[n:] = down[n:] / m
        else:
            slope[:n], slope[n:] = prior * down[:n] / n, -down[n:] / m
        grad = np.append(x.T @ slope + p.l2 * w, slope.sum())
        mean, var = 0.9 * mean + 0.1 * grad, 0.999 * var + 0.001 * grad**2
        step = p.rate * (mean / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", p: Params = Params()) -> dict:
    """{"weights": {word: weight}, "bias", "scale"} from documents that may be learned from; without toxic labels or documents there are no weights, and every score is 0.

    Null ids, labels and texts teach nothing; an id with several labels counts as toxic if one is. Repeated rows and near copies share a bucket of the sample.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    labels = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    known = labels.groupBy("id").agg(F.max("y").alias("y"))
    total, toxic = known.agg(F.count("*"), F.count_if(F.col("y") == 1)).first()
    prior = min(0.9, max(0.001, toxic / total)) if total else 0.0
    share = lambda n: F.pmod(F.xxhash64(F.lit(17), F.col("id")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, p.rows / max(1, n)))
    wanted = known.where((F.col("y") == 1) & share(toxic)).select("id")
    pos = docs.join(maybe_broadcast(wanted, min(toxic, 2 * p.rows)), "id", "left_semi").select(F.lit(True).alias("positive"), "text")
    unl = docs.where(share(docs.count())).select(F.lit(False).alias("positive"), "text")
    schema = "positive boolean, least long, words array<string>"
    sample = cut(_sample(pos.mapInArrow(_features, schema), p.positive_buckets).union(_sample(unl.mapInArrow(_features, schema), p.unlabelled_buckets)))
    n, m = sample.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
    if not n or not m:
        return {"weights": {}, "bias": 0.0, "scale": 0.0}
    # prior * P(word | toxic) / P(word | unlabelled) estimates how many of the documents with the word are toxic
    least = min(n, max(p.min_positive, p.min_share * n))
    met = sample.select("positive", F.explode("words").alias("word")).groupBy("word").agg(F.count_if("positive").alias("here"), F.count_if(~F.col("positive")).alias("there"))
    sure = F.greatest(F.lit(0.0), F.col("here") - p.deviations * F.sqrt("here"))
    part = lambda c: prior * (c / n) / ((F.col("there") + 1) / (m + 1))
    pure = met.where(F.col("here") >= least).withColumn("part", part(F.col("here"))).where((F.col("part") >= p.purity) & (part(sure) >= p.sure_purity))
    ranked = [r.word for r in pure.orderBy(F.desc(F.col("here") * F.least(F.lit(1.0), "part")), "word").limit(p.features).collect()]
    index = {w: i for i, w in enumerate(ranked)}
    x = {True: np.zeros((n, len(ranked)), np.float32), False: np.zeros((m, len(ranked)), np.float32)}
    filled = {True: 0, False: 0}
    for positive, at in sorted((r.positive, r.at) for r in sample.mapInArrow(_places(ranked), "positive boolean, at array<int>").collect()):
        x[positive][filled[positive], at] = 1
        filled[positive] += 1
    spent(sample)
    xp, xu = x[True], x[False]
    w, b = nnpu(xp, xu, prior, p)
    gp, gu = xp @ w + b, xu @ w + b
    # the decision point: the best corrected balance of toxic documents found and unlabelled ones beyond their share of toxic ones
    cuts = np.unique(np.concatenate([gp, gu]))
    cuts = (cuts[:-1] + cuts[1:]) / 2 if len(cuts) > 1 else cuts
    if len(cuts) > 2000:
        cuts = cuts[:: len(cuts) // 2000 + 1]
    gain = [prior * (gp > c).mean() * 2 - (gu > c).mean() for c in cuts]
    at = float(cuts[int(np.argmax(gain))])
    spread = float(np.median(np.abs(gp - at))) or 1.0
    return {"weights": {x: float(w[i]) for x, i in index.items() if abs(w[i]) > 1e-6}, "bias": b - at, "scale": 3.0 / spread}


def score_text(text: str | None, model: dict, threshold: float) -> float:
    weights = model["weights"]
    if not weights:
        return 0.0
    g = model["bias"] + sum(weights[w] for w in words_of(text) & weights.keys())
    z = model["scale"] * g + np.log(threshold / (1 - threshold))
    return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def score(docs: DataFrame, model: dict, text: str = "text", p: Params = Params(), name: str = "toxicity") -> DataFrame:
    """The input's columns and the score in 0..1; null, empty and wordless texts get the model's bias alone. Texts are read whole.

    Equal texts get equal scores, on repeated rows and rows without an id, too. A column of the score's name is replaced; an empty table gives no rows.
    """
    keep = [c for c in docs.columns if c != name]
    docs = docs.select(*[F.col(f"`{c}`") for c in keep])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, at = shared.value, keep.index(text)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([score_text(t.as_py(), model, p.threshold) for t in b.column(at)], pa.float64())], [*keep, name])

    return docs.mapInArrow(rows, StructType([*docs.schema.fields, *StructType().add(name, "double").fields]))
