"""Best-fit packing by bin completion.

Only the histogram of piece lengths is needed to plan: at most `size` numbers, whatever the corpus. Best-fit
decreasing over it gives a first plan (the incumbent). If that is above the lower bound, branch and bound
completes one sequence at a time around the longest piece left: it tries the undominated fillings, least
waste first, each as often as the histogram allows and then less often, and prunes where the waste so far cannot
beat the incumbent. The plan is a list of (lengths in one sequence, times), with whether it is proved that fewer
sequences don't do: it reaches the bound, or the search has ended by itself. A node with too many fillings to list goes on with a
choice of good ones, and the search stops after some nodes; then nothing is proved. Pieces are ranked within their
length by salted counts and looked up in the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .wordbpe import WordIds

Plan = list[tuple[tuple[int, ...], int]]
NODES = 20_000  # completions that branch and bound tries before it settles for the incumbent
LENGTHS, STEPS = 64, 3_000  # lengths that fit, and steps, that the list of all fillings of a node may take
FILLINGS = 6  # fillings that it branches on at a node where that isn't enough
SALTS = 256


def lower_bound(hist: dict[int, int], size: int) -> int:
    """Martello and Toth's bound: pieces over size - k are alone, those over size / 2 apart, the rest fills up, for the best k."""
    best = -(-sum(n * c for n, c in hist.items()) // size)
    lengths = np.array(sorted(hist), np.int64)
    counts = np.array([hist[n] for n in lengths.tolist()], np.int64)
    for k in range(0, size // 2 + 1):
        alone = counts[lengths > size - k].sum()
        apart = (lengths <= size - k) & (lengths > size // 2)
        rest = (lengths <= size // 2) & (lengths >= k)
        free = size * counts[apart].sum() - (lengths[apart] * counts[apart]).sum()
        over = (lengths[rest] * counts[rest]).sum() - free
        best = max(best, int(alone + counts[apart].sum() + max(0, -(-over // size))))
    return best


def best_fit(hist: dict[int, int], size: int) -> Plan:
    """Best-fit decreasing, on groups of alike sequences."""
    open_: dict[int, list[list]] = {}  # room left -> groups [contents, times]
    for n in sorted(hist, reverse=True):
        left = hist[n]
        for room in sorted(r for r in open_ if r >= n):
            fits = room // n
            for group in open_.pop(room):
                contents, times = group
                if left >= fits:
                    full = min(times, left // fits)
                    left -= full * fits
                    open_.setdefault(room - fits * n, []).append([contents + (n,) * fits, full])
                    times -= full
                if times and left:
                    # fewer than `fits` are left: they go into one more sequence
                    open_.setdefault(room - left * n, []).append([contents + (n,) * left, 1])
                    left, times = 0, times - 1
                if times:
                    open_.setdefault(room, []).append([contents, times])
            if not left:
                break
        if left:
            fits = size // n
            if left >= fits:
                open_.setdefault(size - fits * n, []).append([(n,) * fits, left // fits])
            if left % fits:
                open_.setdefault(size - (left % fits) * n, []).append([(n,) * (left % fits), 1])
    return [(tuple(c), t) for groups in open_.values() for c, t in groups if t]


def maximal(lengths: list[int], hist: dict[int, int], room: int, steps: int = STEPS) -> list[tuple[int, ...]] | None:
    """All fillings of the room to which no piece left can be added, pieces descending; None if listing them takes too many steps."""
    if bisect_right(lengths, room) > LENGTHS:
        return None
    down = [n for n in reversed(lengths) if n <= room]
    after = [0] * (len(down) + 1)  # what all shorter pieces hold
    for i in range(len(down) - 1, -1, -1):
        after[i] = after[i + 1] + down[i] * hist[down[i]]
    found: list[tuple[int, ...]] = []
    stack: list[tuple[int, int, int, tuple[int, ...]]] = [(0, room, room + 1, ())]  # next length, room left, what it must end below, chosen
    while stack:
        steps -= 1
        if steps < 0:
            return None
        i, left, below, chosen = stack.pop()
        if left - after[i] >= below:
            continue
        if i == len(down) or left < down[-1]:
            if left < below and all(left < n for n in down[i:]):
                found.append(chosen)
            continue
        n = down[i]
        most = min(hist[n], left // n)
        for take in range(most + 1):  # the largest is popped first
            stack.append((i + 1, left - take * n, min(below, n) if take < hist[n] else below, chosen + (n,) * take))
    return found


def dominates(f: tuple[int, ...], g: tuple[int, ...]) -> bool:
    """Whether f, with the pieces that both have left out, is one piece that holds all that is left of g: they could change places."""
    more, rest = Counter(f) - Counter(g), Counter(g) - Counter(f)
    return sum(more.values()) == 1 and sum(n * c for n, c in rest.items()) <= next(iter(more))


def options(lengths: list[int], hist: dict[int, int], room: int) -> tuple[list[tuple[int, ...]], bool]:
    """Undominated fillings, least waste first and then the longer pieces first; and whether they are all."""
    every = maximal(lengths, hist, room)
    if every is None:
        return good_fillings(lengths, hist, room, FILLINGS), False
    ranked = sorted(every, key=lambda f: _rank(f, room))
    if len(ranked) > 200:
        return ranked, True
    return [g for i, g in enumerate(ranked) if not any(dominates(f, g) for f in ranked[:i])], True


def _rank(f: tuple[int, ...], room: int) -> tuple:
    return room - sum(f), [-n for n in f]


def good_fillings(lengths: list[int], hist: dict[int, int], room: int, most: int) -> list[tuple[int, ...]]:
    """Some fillings of the room, by up to three pieces and a greedy rest, least waste first. lengths: ascending, with a count left."""
    found: dict[tuple[int, ...], None] = {}

    def greedy(chosen: tuple[int, ...], left: int, top: int) -> None:
        used: dict[int, int] = {}
        for n in chosen:
            used[n] = used.get(n, 0) + 1
        i = top
        while left > 0 and (i := min(i, bisect_right(lengths, left)) - 1) >= 0:
            n = lengths[i]
            take = min(hist[n] - used.get(n, 0), left // n)
            if take > 0:
                chosen += (n,) * take
                left -= take * n
        found[tuple(sorted(chosen, reverse=True))] = None

    top = bisect_right(lengths, room)
    for i in range(top - 1, max(-1, top - 1 - 4 * most), -1):
        n = lengths[i]
        greedy((n,), room - n, i + 1)
        other = room - n  # the pair that leaves least
        j = bisect_right(lengths, other) - 1
        if j >= 0 and (lengths[j] != n or hist[n] > 1):
            greedy((n, lengths[j]), other - lengths[j], j + 1)
        if lengths[0] * 2 <= other:
            for k in range(max(0, bisect_right(lengths, other // 2) - 3), bisect_right(lengths, other // 2)):
                m = lengths[k]
                j = bisect_right(lengths, other - m) - 1
                if j >= 0 and all(hist[x] >= (n, m, lengths[j]).count(x) for x in (n, m, lengths[j])):
                    greedy((n, m, lengths[j]), other - m - lengths[j], 0)
    return sorted(found, key=lambda f: _rank(f, room))[:most]


def complete(hist: dict[int, int], size: int, incumbent: Plan, bound: int, nodes: int = NODES) -> tuple[Plan, bool]:
    """Depth-first bin completion: the best plan found within the nodes (the incumbent if none beats it), and whether it is proved to be the least.

    Sequences around pieces of one length are taken in the order of their fillings' ranks: some least plan is so that each of them is maximal
    and undominated in what the ones before it leave, as pieces could otherwise change places and lower a rank.
    """
    best, total = incumbent, sum(n * c for n, c in hist.items())
    count, whole = sum(t for _, t in best), True
    left, lengths = {n: c for n, c in hist.items() if c}, sorted(n for n, c in hist.items() if c)  # changed along the path, and back again

    def take(n: int, times: int) -> None:
        now = left.get(n, 0) - times
        if not now:
            del left[n]
            del lengths[bisect_left(lengths, n)]
            return
        if n not in left:
            lengths.insert(bisect_left(lengths, n), n)
        left[n] = now

    def children(beyond: tuple | None):
        nonlocal whole
        n = lengths[-1]
        take(n, 1)
        found, all_of_them = options(lengths, left, size - n) if lengths else ([()], True)
        take(n, -1)
        whole = whole and all_of_them
        for f in found:
            rank = _rank(f, size - n)
            if beyond is not None and rank <= beyond:
                continue
            need = Counter((n, *f))
            for times in range(min(left[x] // c for x, c in need.items()), 0, -1):
                yield (n, *f), need, times, rank

    path: list[tuple] = [(children(None), None, 0, 0, 0)]  # what to try, and what led here: filling, times; sequences and waste so far
    while path and count > bound:
        if nodes <= 0:
            return best, False
        tries, _, _, used, waste = path[-1]
        step = next(tries, None)
        if step is None:
            _, contents, times, _, _ = path.pop()
            for n in contents or ():
                take(n, -times)
            continue
        nodes -= 1
        contents, need, times, rank = step
        wasted = waste + times * (size - sum(contents))
        if wasted > (count - 1) * size - total:
            continue
        for n, c in need.items():
            take(n, c * times)
        path.append((children(rank if contents[0] in left else None) if left else iter(()), contents, times, used + times, wasted))
        if not left:
            best, count = [(f, t) for _, f, t, _, _ in path[1:]], used + times
    return best, count <= bound or whole


def plan(hist: dict[int, int], size: int) -> tuple[Plan, bool]:
    """A plan, and whether it is proved that no plan has fewer sequences."""
    first = best_fit(hist, size)
    bound = lower_bound(hist, size) if hist else 0
    return (first, True) if sum(t for _, t in first) <= bound else complete(hist, size, first, bound)


def slots(made: Plan) -> tuple[np.ndarray, ...]:
    """Sorted by (length, first rank): which ranks of a length go to which sequences, at what offset."""
    rows, used, base = [], {}, 0
    for contents, times in made:
        offset = 0
        for n in contents:
            at = used.get(n, 0)
            rows.append((n, at, base, offset))
            used[n] = at + times
            offset += n
        base += times
    out = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return out[:, 0], out[:, 1], out[:, 2], out[:, 3]


def _pieces(path: str, size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(path)
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = words.document(text.as_py()) + b"\0\0\0\0"
                n = len(ids) // 4
                for i, start in enumerate(range(0, n, size)):
                    piece = ids[4 * start : 4 * (start + size)]
                    out.append((doc, i, start, len(piece) // 4, zlib.crc32(piece)))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, proved: every piece of every document in a sequence of at most `size` ids.

    proved is one value for all rows: whether fewer sequences are proved not to do (else the search was cut).

    A document is the ids of its whole text (null: none) and then id 0. Only longer ones are cut. Rows with a null
    or a repeated id are packed like any other; an empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    pieces = cut(texts.mapInArrow(_pieces(tokenizer, size), schema))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    counts = cut(salted.groupBy("length", "salt").agg(F.count("*").alias("rows")))  # at most size * SALTS rows
    hist = {r.length: r.rows for r in counts.groupBy("length").agg(F.sum("rows").alias("rows")).collect()}
    made, proved = plan(hist, size)
    shared = spark.sparkContext.broadcast(slots(made))
    before = counts.select("length", "salt", (F.sum("rows").over(Window.partitionBy("length").orderBy("salt")) - F.col("rows")).alias("before"))
    # the key comes from few lengths, of which one may hold a third of all rows: the salt splits it
    ranked = salted.withColumn("at", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("at") - 1)
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, first, base, offset = shared.value
        key = lengths << 44 | first
        for b in batches:
            n, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.searchsorted(key, n << 44 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(base[at] + rank - first[at]), pa.array(offset[at])], [*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long").withColumn("proved", F.lit(proved))
