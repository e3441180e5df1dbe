import random

import numpy as np
import public_tokenizers
import pytest

from treelake.llm import pieces as P

PATH = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = ["the", "of ", " and", "ing", "tion", " ", "  ", "\n", "\t", "é", "ß", "日", "😀", "a", "aa", "aaa", "ab", "-", "--", "==", "1", "00", ".", ",", "▁", "x", "keit", "\x00", "É", "\r"]


def text(rng, n):
    return "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, n)))


@pytest.fixture(scope="module")
def pieces():
    return P.Pieces(PATH, kept=100)


def test_segments_equal_the_library(pieces):
    rng = random.Random(3)
    for _ in range(1500):
        t = text(rng, 12)
        ids = np.frombuffer(pieces.encode(t), "<u4").tolist()
        assert ids == pieces.sp.encode(t), repr(t)
        assert pieces.decode(pieces.encode(t)) == t.replace("▁", " ") or not t


def whole(pieces, t, p):
    marked = P.MARK + t.replace(" ", P.MARK)
    at = P.borders(pieces, marked, p)
    spans = list(zip(at, at[1:]))
    rows = P.pd.DataFrame([{"row": 0, "chunk": i, "into": m.shape[0], "bits": np.packbits(m).tobytes(), "out": m.shape[1]} for i, (a, b) in enumerate(spans) for m in [pieces.matrix(marked, a, b)]])
    states = P._scan(rows)
    return b"".join(pieces.backtrace(marked, a, b, pieces.states(marked, a)[r.start], pieces.states(marked, b)[r.stop]) for (a, b), r in zip(spans, states.itertuples()))


@pytest.mark.parametrize("near", [0, 8])
def test_scan_equals_the_library(pieces, near):
    rng = random.Random(near)
    for _ in range(40):
        t = text(rng, 60) if rng.random() < 0.6 else "".join(rng.choice("abthing=-") for _ in range(rng.randint(1, 120)))
        t = t or "a"
        p = P.Params(chunk=2 * pieces.longest + rng.randint(0, 9), near=near)
        assert np.frombuffer(whole(pieces, t, p), "<u4").tolist() == pieces.sp.encode(t), repr(t)


def test_columns(spark, pieces):
    rng = random.Random(9)
    texts = [None, "", "a", *[text(rng, 400) for _ in range(20)], "".join(rng.choice("abcdefing") for _ in range(900))]
    df = spark.createDataFrame([(i, t, b"x") for i, t in enumerate(texts)] + [(None, "a b", None)], "doc_id long, text string, ids binary")
    made = P.encode(df, PATH, p=P.Params(giant=300, chunk=100, near=20)).cache()
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in made.collect()}
    assert got == {**{i: pieces.sp.encode(t) if t else [] for i, t in enumerate(texts)}, None: pieces.sp.encode("a b")}
    back = {r.doc_id: r.text for r in P.decode(made, PATH).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(texts))
    assert P.encode(df.limit(0), PATH).collect() == []
