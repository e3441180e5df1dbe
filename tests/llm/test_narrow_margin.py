"""Texts that two languages' dictionaries compress equally well, or nearly, are rejected; clean ones stay."""

import random

from treelake.llm import langid

SYLLABLES = {"a": "ka lo mi tu ren sho bal dik".split(), "b": "fe wu gy pra zont ix vel oum".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


def corpus():
    rng = random.Random(3)
    return rng, [(i, text(rng, "ab"[i % 2], 120), "ab"[i % 2]) for i in range(200)]


def test_ties_and_mixed_texts_go(spark):
    rng, rows = corpus()
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    assert len(model) == 2
    p, tools = langid.Params(), langid.compressors(model, langid.Params())

    def gap(words):  # by how much the texts of n words a and then b lie apart
        return langid.classify(words, tools, p)[2]

    mixed = min((f"{a} {b}" for a, b in ((text(rng, "a", 100), text(rng, "b", n)) for n in range(60, 160))), key=gap)
    assert 0 <= gap(mixed) < p.min_gap
    docs = [(1, rows[0][1]), (2, rows[1][1]), (3, mixed), (4, "日本"), (5, "123"), (6, text(rng, "a", 2000)), (7, text(rng, "b", 30))]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    assert {i for i, r in got.items() if r.rejected} == {3, 4, 5}
    assert [got[i].lang_pred for i in (1, 2, 6, 7)] == ["a", "b", "a", "b"]


def test_equal_dictionaries_reject_every_text(spark):
    _, rows = corpus()
    model = [("x", rows[0][1].encode()), ("y", rows[0][1].encode())]
    got = langid.identify(spark.createDataFrame([(1, rows[0][1]), (2, rows[1][1])], "doc_id long, text string"), model).collect()
    assert all(r.rejected for r in got)
    alone = langid.identify(spark.createDataFrame([(1, rows[0][1])], "doc_id long, text string"), model[:1]).collect()
    assert not alone[0].rejected
