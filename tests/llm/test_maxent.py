import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from treelake.llm import langid, maxent
from treelake.llm.words import Words


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def corpus():
    rng = random.Random(4)
    a, b = [f"{x}ing" for x in "abcdefgh"] * 9 + [f"q{i}ing" for i in range(60)], [f"{x}eau" for x in "klmnopqr"] * 9 + [f"z{i}eau" for i in range(60)]
    rows = [(i, " ".join(rng.choice(a if i % 2 else b) for _ in range(rng.randint(0, 90))).title(), 1) for i in range(300)]
    return [*rows, (300, None, 1), (301, "", 1), (None, "aing\tkeau\x0baing", 1), (5, rows[5][1], 1), (302, "É É é x\x1cy \xa0", 1)]


def test_base_scores_are_exact_and_the_model_beats_them(spark, monkeypatch):
    monkeypatch.setattr(maxent, "HEAD", 30)
    rows = corpus()
    apart = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t, _ in rows if not apart(i) for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    expected = sorted((str(i), apart(i), len(ws := [*words(t), None]), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, t, _ in rows)
    got = maxent.score(spark.createDataFrame(rows, "doc_id long, text string, n long"), held_out=langid.held_out("doc_id", 7, 2)).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out) + 10
    assert all(r.score < 0 for r in got)


def test_probabilities_of_a_context_add_up_to_one():
    p = maxent.Params()
    w = np.random.default_rng(1).normal(size=(3 * maxent.C + p.features + 1, maxent.C))
    assert np.allclose(np.exp(maxent.log_p(w, maxent.feature_ids(p)[:500])).sum(1), 1)
    assert len(maxent.cells(np.array([3, 4, 0]))) == 3 and maxent.cells(np.array([3, 4, 0]))[1] == 3 * maxent.C + 4


def test_no_training_text(spark):
    got = maxent.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), held_out=maxent.F.lit(True)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(3, 0, 0, 0.0)] and math.isfinite(got[0].score)
    assert maxent.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_word_hashes_follow_the_words():
    rng, h = random.Random(1), Words()
    letters = "aAbBéÉß \t\n\x0b\x0c\r\x1c\x85\xa0zZ日"
    by = {}
    for _ in range(2000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        found = h(text).tolist()
        assert len(found) == len(words(text))
        for w, x in zip(words(text), found, strict=True):
            assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)


def test_parts_after_words_add_up_and_meet_their_counts(spark):
    """The parts' softmax against a plain one, whole texts apart from each other, and one round of scaling."""
    p = maxent.Params(rows=16)
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    k = rng.integers(1, maxent.C, 300)
    h[[99, 199, 299]], k[[99, 199, 299]] = maxent.END, 0
    rows, part = maxent.word_rows(h, k, p)
    assert (rows // p.rows == k[:, None]).all() and (part == (h >> np.uint64(7)).astype(np.int64) % maxent.PARTS).all()
    for a in (100, 200):  # a text's tokens don't depend on what stands before it
        alone, _ = maxent.word_rows(h[a : a + 100], k[a : a + 100], p)
        assert (alone == rows[a : a + 100]).all()
    w, prior = rng.normal(size=(maxent.C * p.rows, maxent.PARTS)), rng.normal(size=(maxent.C, maxent.PARTS))
    z = prior[k] + w[rows].sum(1)
    assert np.allclose(np.exp(maxent.part_log_p(w, prior, rows, k)), np.exp(z) / np.exp(z).sum(1, keepdims=True))
    # training: the likelihood of the kept tokens is better than the class's own shares
    part = np.where(rows[:, 0] % 2 == 0, 3, 11)  # words after some words fall into one part
    h = (h & ~np.uint64((maxent.PARTS - 1) << 7)) | (part.astype(np.uint64) << np.uint64(7))
    rows, part = maxent.word_rows(h, k, p)
    n = sum(np.bincount(rows[:, f] * maxent.PARTS + part, minlength=maxent.C * p.rows * maxent.PARTS) for f in range(3))
    at = np.flatnonzero(n)
    counts = spark.createDataFrame([(int(i), int(n[i])) for i in at], "key long, n long")
    kept = spark.createDataFrame([(bytearray((h & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + k.astype(np.uint8).tobytes()), len(h))], "tokens binary, n long")
    share = np.ones((maxent.C, maxent.PARTS))
    np.add.at(share, (k, part), 1)
    prior = np.log(share / share.sum(1, keepdims=True))
    small = maxent.Params(rows=16, pull=1.0)
    weights = maxent.train_parts(counts, kept, prior, small)
    own = np.arange(len(h))
    assert maxent.part_log_p(weights, prior, rows, k)[own, part].sum() > maxent.part_log_p(0 * weights, prior, rows, k)[own, part].sum() + 20
