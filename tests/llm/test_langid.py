"""Language ID against a direct classifier, and on rows that carry nothing."""

import random
import re

import pytest
import zstandard
from test_narrow_margin import corpus, text

from treelake.llm import langid

P = langid.Params()


def direct(t, model):
    """Sizes of the text's blocks with each dictionary, the plain way."""
    words = re.sub(r"[\W\d_]+", " ", (t or "").lower()).strip()
    if not any(c.isalpha() for c in words):
        return "und"
    sizes = []
    for lang, data in model:
        tool = zstandard.ZstdCompressor(level=P.level, dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False)
        raw = words.encode()
        sizes.append(sum(len(tool.compress(raw[i : i + P.block])) for i in range(0, len(raw), P.block)))
    return model[sizes.index(min(sizes))][0]


@pytest.fixture(scope="module")
def learned(spark):
    _, rows = corpus()
    return langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")


def test_equals_direct_classifier(spark, learned):
    rng = random.Random(11)
    texts = [text(rng, "ab"[i % 2], rng.choice([1, 3, 20, 400])) for i in range(60)] + ["½", "²", "Ⅳ", "1 ² x", "日本", "_", "", None, "é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(docs, learned).collect()}
    assert {i: r.lang_pred for i, r in got.items()} == {i: direct(t, learned) for i, t in enumerate(texts)}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {60, 61, 62, 65, 66, 67}
    assert all(got[i].rejected and got[i].score == 0 for i in (60, 61, 62, 65, 66, 67))


def test_nulls_repeats_clashes_and_long_texts(spark, learned):
    rng = random.Random(2)
    long = text(rng, "b", 60_000)
    rows = [(1, long, "x", 5.0), (1, long, "x", 5.0), (None, text(rng, "a", 50), None, None), (2, None, "y", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, score double")
    out = langid.identify(df, learned)
    assert out.columns == ["doc_id", "text", "lang_pred", "score", "rejected"]
    got = sorted(((r.doc_id, r.lang_pred, r.rejected) for r in out.collect()), key=str)
    assert got == sorted([(1, "b", False), (1, "b", False), (None, "a", False), (2, "und", True)], key=str)
    assert langid.identify(df.limit(0), learned).collect() == []


def test_learns_from_anywhere_in_a_text_and_from_nothing(spark):
    rng = random.Random(4)
    # the languages differ only far behind the beginning
    rows = [(i, "same start here " * 200 + text(rng, "ab"[i % 2], 2000), "ab"[i % 2]) for i in range(120)]
    schema = "doc_id long, text string, lang string"
    model = langid.fit(spark.createDataFrame(rows, schema), "doc_id", "text", "lang")
    got = langid.identify(spark.createDataFrame([(1, text(rng, "a", 80)), (2, text(rng, "b", 80))], "doc_id long, text string"), model).collect()
    assert [r.lang_pred for r in sorted(got, key=lambda r: r.doc_id)] == ["a", "b"]
    none = langid.fit(spark.createDataFrame([(1, "abc", None), (2, "½", "a"), (3, None, "a"), (None, "", "b")], schema), "doc_id", "text", "lang")
    assert none == []
    assert [r.lang_pred for r in langid.identify(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), none).collect()] == ["und"]


def test_only_the_most_frequent_languages_within_the_bound(spark):
    rows = [(i, f"word{i}", lang) for i, lang in enumerate(["a"] * 5 + ["b"] * 3 + ["c"])]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", langid.Params(languages=2))
    assert [lang for lang, _ in model] == ["a", "b"]
    assert all(len(data) <= P.dictionary for _, data in model)
