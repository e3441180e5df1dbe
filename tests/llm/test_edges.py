"""Rows that carry little, repeat, or are very long, for operators whose own tests leave them out; the pipeline's stages on such rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece

from treelake.llm import licenses, maxent, packing, pieces, queries
from treelake.llm import shards as shards_

PIECES = queries.tokenizer_path("piece_bpe_32k.model")


def long_text(seed, words):
    rng = random.Random(seed)
    vocab = ["the", "of", "and", "river", "ing", "é", "日本", "x1", "--", "keit"]
    return " ".join(rng.choice(vocab) for _ in range(words))


def test_pieces_of_giant_and_repeated_rows(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    giant = long_text(1, 60_000)
    assert len(giant) > 10 * pieces.Params().chunk
    glued = "ab" * 12_000  # no border near a word
    rows = [(1, giant, 7), (1, giant, 7), (2, glued, 7), (2, "short", 7), (None, giant[:20_000], 7), (3, None, 7), (4, "", 7)]
    got = Counter((r.doc_id, bytes(r.ids)) for r in pieces.encode(spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3), PIECES).collect())
    assert got == Counter((i, np.array(sp.encode(t or ""), "<u4").tobytes()) for i, t, _ in rows)
    back = pieces.decode(pieces.encode(spark.createDataFrame(rows, "doc_id long, text string, ids int"), PIECES), PIECES, name="back").collect()
    assert Counter((r.doc_id, r.back) for r in back) == Counter((i, t or "") for i, t, _ in rows)
    assert pieces.encode(spark.createDataFrame([], "doc_id long, text string"), PIECES).collect() == []


def test_language_model_on_long_repeated_and_clashing_rows(spark):
    long = long_text(2, 100_000)
    rows = [(1, long, 0.5, True, 9), (1, long, 0.5, True, 9), (None, "the river", 0.1, False, 1), (2, None, 0.0, None, 0), (3, "the river", 0.2, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double, held_out boolean, n_tokens int")
    got = maxent.score(df).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((i, len((t or "").split()) + 1) for i, t, *_ in rows)
    twice = [r for r in got if r.doc_id == 1]
    assert twice[0] == twice[1] and math.isfinite(twice[0].score) and twice[0].train_tokens == 2 * 100_001 + 3 + 1 + 3
    same = {r.doc_id: r.score for r in got if r.n_tokens == 3}
    assert same[None] == pytest.approx(same[3])


def test_licenses_in_long_and_repeated_rows(spark):
    mit, long = licenses.KNOWN["MIT"], long_text(3, 100_000)
    rows = [(1, mit, "x"), (1, mit, "x"), (2, long, "x"), (3, f"{long}\n{mit}", "x"), (4, "\n" * 100_000 + mit + " " * 100_000, "x"), (None, mit, "x")]
    got = Counter((r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, digest string"), licenses.known_licenses(spark)).collect())
    assert got == Counter([(1, "MIT"), (1, "MIT"), (2, None), (3, None), (4, "MIT"), (None, "MIT")])


def test_packing_of_ties_and_clashes(spark):
    rows = [(i % 3, "the " * 40, i, i) for i in range(90)] + [(7, long_text(4, 9000), 0, 0)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, length int, sequence_id int"), queries.tokenizer_path("word_bpe_49k.json")).collect()
    assert len({r.proved for r in got}) == 1 and Counter(r.doc_id for r in got if r.doc_id < 7) == {0: 30, 1: 30, 2: 30}
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[-1][0] + parts[-1][1] <= 2048
    assert sorted(r.start for r in got if r.doc_id == 7) == [2048 * i for i in range(sum(r.doc_id == 7 for r in got))]


def test_tree_cuts_equal_direct_weighted_medians(spark):
    """Two shards of one dimension: the cut is the one nearest to half the bytes, as sorting tells it."""
    rng = random.Random(8)
    rows = [(i, rng.choice([8, 100, 5000])) for i in rng.sample(range(10_000), 400)]
    df = spark.createDataFrame(rows, "doc_id long, size long").repartition(4)
    got = {r.doc_id: r.shard for r in shards_.kd_shards(df, {"doc_id": shards_.F.col("doc_id")}, shards_.F.col("size"), 2).collect()}
    total, held, least = sum(n for _, n in rows), 0, None
    for i, n in sorted(rows):
        held += n
        if least is None or abs(held - total / 2) < least[0]:
            least = (abs(held - total / 2), i)
    off = abs(sum(n for i, n in rows if got[i] == 0) - total / 2)
    assert max(i for i in got if got[i] == 0) < min(i for i in got if got[i] == 1)  # neighbours stay together
    assert off <= least[0] + 5000


def test_pipeline_stages_on_odd_rows(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    base = docs.where("doc_id < 300")
    clean = base.where("n_chars between 500 and 2000").orderBy("doc_id").limit(1)
    f = pipeline.F
    nameless = clean.withColumn("doc_id", f.lit(None).cast("long"))
    null_text = clean.withColumn("doc_id", f.lit(90001).cast("long")).withColumn("text", f.lit(None).cast("string"))
    nothing = clean.withColumn("doc_id", f.lit(90002).cast("long")).withColumn("lang", f.lit(None).cast("string")).withColumn("source", f.lit(None).cast("string"))
    odd = base.unionByName(clean).unionByName(nameless).unionByName(null_text).unionByName(nothing).withColumn("score", f.lit(1)).withColumn("component", f.lit("x"))
    one = clean.first().doc_id
    kept = pipeline.language_id(spark, odd, sf)
    ids = Counter(r.doc_id for r in kept.collect())
    assert kept.columns == odd.columns and ids[one] == 2 and ids[None] == 1 and 90001 not in ids and ids[90002] == 1
    kept = pipeline.toxic(spark, odd, sf)
    ids = Counter(r.doc_id for r in kept.collect())
    assert kept.columns == odd.columns and ids[one] == 2 and ids[None] == 1 and ids[90001] == 1 and ids[90002] == 1
    kept = pipeline.near_duplicates(spark, odd, sf)
    ids = Counter(r.doc_id for r in kept.collect())
    assert kept.columns == odd.columns and ids[one] == 2 and ids[None] == 1 and ids[90001] == 1 and 90002 not in ids
    packed = Counter(r.doc_id for r in pipeline.pack(spark, odd, sf).collect())
    assert set(packed) == {r.doc_id for r in odd.select("doc_id").collect()}
