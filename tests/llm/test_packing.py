import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from treelake.llm import packing
from treelake.llm.wordbpe import WordIds

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_plan(hist, size, made):
    used = Counter()
    for contents, times in made:
        assert sum(contents) <= size and times > 0
        for n in contents:
            used[n] += times
    assert used == Counter({n: c for n, c in hist.items() if c})
    return sum(t for _, t in made)


def optimum(items, size):
    """Fewest bins by exhaustive search over small inputs."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= items[i]:
                nxt = list(rooms)
                nxt.remove(r)
                go(i + 1, [*nxt, r - items[i]])
        go(i + 1, [*rooms, size - items[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(40))
def test_small_plans_are_optimal(seed):
    rng = random.Random(seed)
    size = rng.choice([10, 20, 50])
    items = [rng.randint(1, size) for _ in range(rng.randint(0, 9))]
    hist = dict(Counter(items))
    made, proved = packing.plan(hist, size)
    assert proved and check_plan(hist, size, made) == (optimum(items, size) if items else 0)


@pytest.mark.parametrize(("size", "items", "least"), [(50, [6, 20, 9, 19, 6, 9, 17, 8, 6], 2), (20, [5, 8, 5, 10, 12, 4, 4, 8, 11, 11, 6, 7, 8], 5)])
def test_plans_that_need_many_pieces_or_a_filling_used_once(size, items, least):
    made, proved = packing.plan(dict(Counter(items)), size)
    assert proved and check_plan(Counter(items), size, made) == least == optimum(items, size)


def test_search_that_is_cut_proves_nothing():
    items = [5, 8, 5, 10, 12, 4, 4, 8, 11, 11, 6, 7, 8]
    hist = dict(Counter(items))
    first = packing.best_fit(hist, 20)
    made, proved = packing.complete(hist, 20, first, packing.lower_bound(hist, 20), nodes=1)
    assert not proved and check_plan(hist, 20, made) <= sum(t for _, t in first)
    assert packing.maximal([1, 2, 3, 4, 5], dict.fromkeys(range(1, 6), 9), 40, steps=10) is None


def test_fillings_are_maximal_and_dominance_counts_pieces():
    hist = {2: 3, 3: 1, 5: 2}
    every = packing.maximal([2, 3, 5], hist, 10)
    assert set(every) == {(5, 5), (5, 3, 2), (5, 2, 2), (3, 2, 2, 2)} | ({(5, 3, 2)} & set(every))
    assert packing.dominates((5, 5), (5, 3, 2)) and not packing.dominates((5, 5, 3), (5, 4, 2, 2))
    assert not packing.dominates((5, 3), (5, 3))


@pytest.mark.parametrize("seed", range(6))
def test_large_plans_hold_everything_and_reach_the_bound(seed):
    rng = random.Random(seed)
    hist = {n: rng.randint(1, 500) for n in rng.sample(range(1, 2049), 300)}
    made, _ = packing.plan(hist, 2048)
    assert check_plan(hist, 2048, made) <= packing.lower_bound(hist, 2048) * 1.01 + 1


def test_word_ids_equal_the_tokenizer():
    words, slow, rng = WordIds(PATH, kept=50), Tokenizer.from_file(PATH), random.Random(5)
    letters = "aAbÉé'sS \n\t!<|>.ÀŁıİΣσς́\xa0\x1cé×÷ßŐ中日1٣LL'veñƻǅ😀\x85  "
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) + ("<|endoftext|>" if rng.random() < 0.05 else "")
        assert np.frombuffer(words.document(text), "<u4").tolist() == slow.encode(text, add_special_tokens=False).ids


def test_pack_is_whole(spark):
    rng, slow = random.Random(2), Tokenizer.from_file(PATH)
    texts = [" ".join(rng.choice(["a", "of", "the", "xyzzy"]) for _ in range(rng.choice([0, 1, 5, 40, 300, 2047, 2048, 5000]))) for _ in range(60)]
    rows = [(i, t, 1) for i, t in enumerate([*texts, None, "", texts[0]])] + [(None, "a b", 2), (3, texts[3], 1)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, length int"), PATH).collect()
    expected = Counter()
    for i, t, _ in rows:
        ids = (slow.encode(t, add_special_tokens=False).ids if t else []) + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            expected[(i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
