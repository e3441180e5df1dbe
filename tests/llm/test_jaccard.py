import random
import re

import numpy as np
import pytest

from treelake.llm import jaccard
from treelake.llm.jaccard import jaccard_join


def brute(rows, k=3, num=90, den=100):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {(i, len(sets[i]), find(i)) for i in ids}


def corpus(seed, n_base=12, copies=10):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocab) for _ in range(60)]
    rows = []
    for _ in range(n_base):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 8, 10, 13, 25, 60, 150, 400]))]
        if rng.random() < 0.3:
            base += passage
        for _ in range(rng.randint(1, copies)):
            text = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 60)):
                at = rng.randrange(len(text))
                text[at : at + rng.randint(0, 1)] = [rng.choice(vocab)] * rng.randint(0, 2)
                text = text or ["x"]
            rows.append(" ".join(text).upper() if rng.random() < 0.1 else "\n".join(text))
    rng.shuffle(rows)
    return list(enumerate([*rows, None, "", " \t", "É é", "é é"]))


def result(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, component string, doc long")
    return {(r.doc, r.n_shingles, r.component) for r in jaccard_join(df).collect()}


@pytest.mark.parametrize(("small", "chunk", "fresh", "cross"), [(512, 500_000, 1, 4096), (2, 300, 2, 4), (2, 300, 0, 4), (2, 300, 1, 4096), (512, 1, 1, 4096)])
def test_matches_brute_force(spark, monkeypatch, small, chunk, fresh, cross):
    monkeypatch.setattr(jaccard, "SMALL_DOCS", small)
    monkeypatch.setattr(jaccard, "CROSS_DOCS", cross)
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    monkeypatch.setattr(jaccard, "FRESH", fresh)
    rows = corpus(small + chunk)
    assert result(spark, rows) == brute(rows)


def test_empty_table_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join(df).collect() == []
    got = sorted(map(tuple, jaccard_join(spark.createDataFrame([(7, "a b c d"), (7, "a b c d"), (None, "a b c d"), (3, "A b\nc d")], "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(7, 2, 3), (7, 2, 3), (3, 2, 3), (None, 2, None)], key=str)


def test_class_borders_keep_every_pair():
    c = jaccard.Classes(90, 100)
    for n in range(1, 3000):
        for m in range(n, n * 100 // 90 + 1):
            assert c.of(n) in c.classes(m)
        assert c.parts(c.of(n))[0] > n * 10 // 90


def test_id_with_two_texts_links_by_either(spark):
    rows = [(7, "a b c d"), (7, None), (7, "q r s t u"), (9, "Q r s t u"), (3, "A B C D"), (12, "x")]
    got = {(r.doc, r.component) for r in jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {(7, 3), (9, 3), (3, 3), (12, 12)}


@pytest.mark.parametrize("t", [80, 90])
def test_pairs_at_the_threshold_share_a_cell(t):
    """However sizes fall into classes, and with other parts, too."""
    rng = np.random.default_rng(t)
    for n in [2, 5, 9, 10, 11, 40, 90, 333, 2000]:
        for _ in range(20):
            s = np.unique(rng.integers(0, 1 << 63, 2 * n).astype(np.uint64))[:n]
            gone = rng.integers(0, 1 + n * (100 - t) // 100)
            x, y = s[gone:], s
            assert 100 * len(x) >= t * len(y)
            for seed in (0, 1):
                c = jaccard.Classes(t, 100)
                assert set(c.signatures(x, seed).tolist()) & set(c.signatures(y, seed).tolist())


@pytest.mark.parametrize("n", [1, 16, 17, 300, 5000])
def test_histograms_bound_the_intersection(n):
    rng = np.random.default_rng(n)
    x, y = (np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64)) for size in (n, 2 * n))
    y = np.unique(np.concatenate([y, x[: len(x) // 2]]))
    h, g = (jaccard.unpacked(jaccard.histogram(s)) for s in (x, y))
    assert h.sum() == len(x) and g.sum() == len(y)
    assert len(np.intersect1d(x, y)) <= jaccard.most_common(h, g, len(x), len(y)) <= len(x)


def test_crossing_keeps_every_pair_that_links():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[: rng.integers(1, 400)], rng.integers(0, 1 << 63, rng.integers(0, 40)).astype(np.uint64)])) for _ in range(60)]
    sets.sort(key=len)
    component = rng.integers(0, 5, 60)
    n = np.array([len(s) for s in sets])
    sketches = [b"d" * 16 + (jaccard.histogram(s) if i % 7 else b"") for i, s in enumerate(sets)]
    keep = jaccard.crossing(n, component, sketches, 80, 100)
    for i in range(60):
        for j in range(60):
            both = len(np.intersect1d(sets[i], sets[j]))
            if component[i] != component[j] and 100 * both >= 80 * (n[i] + n[j] - both):
                assert keep[i] and keep[j]


def _sent(monkeypatch):
    """Bytes of each frame that is broadcast from now on, as a hash table's rows of 8 bytes a column or as binary."""
    from treelake.llm import common

    sent, plain = [], common.F.broadcast

    def broadcast(df):
        wide = [c for c, kind in df.dtypes if kind == "binary"]
        size = sum((common.F.octet_length(c) for c in wide), common.F.lit(16 + 8 * len(df.columns)))
        sent.append(df.agg(common.F.sum(size)).first()[0] or 0)
        return plain(df)

    monkeypatch.setattr(common.F, "broadcast", broadcast)
    return sent


def test_driver_holds_no_table_of_many_ids(spark, monkeypatch):
    """300,000 ids among 1,000,000 rows, null and repeated ones too: the driver gets a bitmap of them, and no row is lost or let in."""
    sent = _sent(monkeypatch)
    rows = spark.range(-1000, 1_000_000).selectExpr("nullif(id, 7) as doc", "cast(id as string) as text")
    rows = rows.union(rows.where("doc % 1000 = 0"))
    docs = spark.range(0, 900_000, 3).toDF("doc")
    join = jaccard._Join(rows, None, [], 3, 90, 100)
    got = join.some(docs).selectExpr("count(*) as n", "count(distinct doc) as docs", "count_if(doc % 3 <> 0 or doc < 0 or doc >= 900000 or text <> doc) as wrong").first()
    assert (got.n, got.docs, got.wrong) == (300_300, 300_000, 0)
    assert sum(sent) < 2_000_000


def test_labels_of_many_documents_are_not_broadcast(spark, monkeypatch):
    """Hubs of 60,000 links and chains, 240,000 documents: labels by dealt joins."""
    sent = _sent(monkeypatch)
    links = spark.range(240_000).selectExpr("id as a", "case when id < 120000 then id - id % 60000 else id - id % 4 + greatest(id % 4 - 1, 0) end as b").where("a <> b")
    now = jaccard._Join(None, None, [links], 3, 90, 100).labels()
    wrong = now.where("label <> case when doc < 120000 then doc - doc % 60000 else doc - doc % 4 end")
    assert now.count() == 240_000 and wrong.count() == 0
    assert sum(sent) < 2_000_000


def test_shuffled_joins_equal_brute_force(spark, monkeypatch):
    """All that is broadcast on small tables is shuffled, hot keys dealt: the same classes."""
    from treelake.llm import common

    for module, name, value in ((common, "BROADCAST_ROWS", 0), (jaccard, "BROADCAST_ROWS", 0), (common, "BROADCAST_BYTES", 40_000), (common, "TOGETHER", 3)):
        monkeypatch.setattr(module, name, value)
    r = random.Random(5)
    base = [" ".join(r.choice("abcdefghij") * r.randint(1, 3) for _ in range(60)) for _ in range(40)]
    rows = [(i, base[i % 40] if i < 90 else base[0] + f" x{i % 7}") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(x) for x in jaccard_join(df).collect()} == brute(rows)
