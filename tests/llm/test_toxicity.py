"""The learner against the risk written down plainly, the scorer against a direct sum, and rows that carry nothing."""

import itertools
import random

import numpy as np
import pytest

from treelake.llm import toxicity

P = toxicity.Params()
CLEAN = ["".join(p) for p in itertools.product("bdfgklmnprst", "aeiou", "bdfgklmnprst", "aeiou")]
BAD = ["snarglewit", "blorkface", "grumpleswine"]


def rows(seed=1, n=1200):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = rng.choices(CLEAN, k=rng.randint(5, 60))
        bad = i % 5 == 0
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        out.append((i, " ".join(words), int(bad)))
    return out


@pytest.fixture(scope="module")
def model(spark):
    data = rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data if i % 2 == 0], "doc_id long, toxic int")
    return toxicity.fit(docs, labels)


def risk(w, b, xp, xu, prior):
    loss = lambda z: np.log1p(np.exp(-z))
    gp, gu = xp @ w + b, xu @ w + b
    return prior * loss(gp).mean(), loss(-gu).mean() - prior * loss(-gp).mean()


def test_learner_lowers_the_risk_and_keeps_it_above_zero():
    rng = np.random.default_rng(0)
    xp, xu = (rng.random((60, 4)) < [0.8, 0.5, 0.2, 0.1]).astype(float), (rng.random((200, 4)) < [0.2, 0.5, 0.2, 0.4]).astype(float)
    w, b = toxicity.nnpu(xp, xu, 0.2, P)
    up, bracket = risk(w, b, xp, xu, 0.2)
    up0, bracket0 = risk(np.zeros(4), 0.0, xp, xu, 0.2)
    assert up + max(0, bracket) < up0 + max(0, bracket0)
    assert bracket > -0.05 and w[0] > 0 > w[3]
    # no small step in any direction does much better
    for k in range(5):
        for d in (-0.05, 0.05):
            v, c = w.copy(), b
            if k < 4:
                v[k] += d
            else:
                c += d
            u, br = risk(v, c, xp, xu, 0.2)
            assert u + max(0, br) > up + max(0, bracket) - 0.01


def test_finds_toxic_and_leaves_clean(spark, model):
    data = rows(seed=7)
    got = {r.doc_id: r.toxicity for r in toxicity.score(spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string"), model).collect()}
    assert all((got[i] >= P.threshold) == bool(y) for i, _, y in data)
    for i, t, _ in data:  # a direct sum
        g = model["bias"] + sum(x for w, x in model["weights"].items() if w in toxicity.words_of(t))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(model["scale"] * g + np.log(P.threshold / (1 - P.threshold))))))


def test_nulls_repeats_clashes_long_texts_and_empty_tables(spark, model):
    long = " ".join(CLEAN * 20)
    data = [(1, None, 9.0), (2, "", 9.0), (3, " 123 ", 9.0), (None, BAD[0], None), (4, long, 1.0), (4, long, 1.0), (5, long + " " + BAD[1], 1.0)]
    df = spark.createDataFrame(data, "doc_id long, text string, score double")
    out = toxicity.score(df, model, name="score")
    assert out.columns == ["doc_id", "text", "score"]
    by = {}
    for r in out.collect():
        by.setdefault(r.doc_id, []).append(r.score)
    assert by[1] == by[2] == by[3] and by[1][0] < P.threshold
    assert by[4][0] == by[4][1] < P.threshold <= by[5][0] and by[None][0] >= P.threshold
    assert toxicity.score(df.limit(0), model).collect() == []


def test_without_anything_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, "c"), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, None), (None, 1)], [(1, 0)], [(77, 1)]):
        m = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {r.toxicity for r in toxicity.score(docs, m).collect()} == {0.0}
    m = toxicity.fit(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert m["weights"] == {}


def test_ties_between_labels_of_an_id(spark):
    """An id that is labelled both ways counts as toxic."""
    data = rows(3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = [(i, y) for i, _, y in data] + [(i, 0) for i, _, y in data if y]
    m = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {w for w in m["weights"] if not w.endswith("*")} <= set(BAD) and m["weights"]


def test_a_word_of_small_hash_is_no_family():
    rng = random.Random(1)
    texts = [sorted({"grumpleswine", *rng.choices(CLEAN, k=30)}) for _ in range(50)]
    assert len({toxicity.family(t) for t in texts}) > 45
    assert toxicity.family(texts[0]) == toxicity.family(list(reversed(texts[0]))) and toxicity.family([]) == 0
