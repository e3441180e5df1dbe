import numpy as np
import pytest

from treelake.llm import neardup


def brute(rows, cosine):
    ok = {}
    for i, (vec, x, label) in enumerate(rows):
        if vec is not None and label is not None and x is not None and len(x) and all(v is not None and np.isfinite(v) for v in x) and any(x):
            ok[i] = (label, len(x), np.array(x, np.float64) / np.linalg.norm(np.array(x, np.float64)))
    links = {i: [j for j in ok if j != i and ok[i][:2] == ok[j][:2] and ok[i][2] @ ok[j][2] >= cosine] if i in ok else [] for i in range(len(rows))}
    root = {r[0]: r[0] for r in rows}
    for _ in rows:
        for i in links:
            for j in links[i]:
                root[rows[i][0]] = root[rows[j][0]] = min(root[rows[i][0]], root[rows[j][0]])
    return sorted(((r[0], len(links[i]), root[r[0]], r[0] is not None and r[0] == root[r[0]]) for i, r in enumerate(rows)), key=str)


def sample(seed, spread, dims=6, n=220):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    rows = [[int(i), (centres[rng.integers(12)] + rng.normal(size=dims) * spread).tolist(), int(rng.integers(2))] for i in rng.permutation(n)]
    rows[3][1] = rows[4][1] = rows[5][1]
    rows += [[1000, None, 1], [1001, [0.0] * dims, 1], [1002, [], 0], [1003, [float("nan")] * dims, 0], [1004, [1.0, None, 2.0, 1.0, 1.0, 1.0], 1], [1005, rows[3][1], None], [1006, rows[3][1][:4], rows[3][2]], [1007, [float("inf")] + [1.0] * (dims - 1), 0]]
    rows += [[rows[9][0], rows[9][1], rows[9][2]], [rows[10][0], rows[11][1], rows[11][2]], [None, rows[9][1], rows[9][2]]]  # repeated rows, an id with two vectors, no id
    return rows


@pytest.mark.parametrize(("cell", "spread", "cosine"), [(1024, 0.1, 0.98), (16, 0.1, 0.98), (16, 0.02, 0.98), (12, 0.3, 0.999)])
def test_matches_brute_force(spark, monkeypatch, cell, spread, cosine):
    monkeypatch.setattr(neardup, "CELL", cell)
    monkeypatch.setattr(neardup, "PIVOTS", 4)
    rows = sample(1, spread)
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<float>, label int, dup string, d double")
    rows = [[a, None if x is None else [None if v is None else float(np.float32(v)) for v in x], b] for a, x, b in rows]
    got = neardup.near_duplicates(df, cosine).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, cosine)


def test_empty(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_pivots_run_with_the_default_cell(spark, monkeypatch):
    """Families far from each other: cells that pivots separate, no blocks of all pairs."""
    rng = np.random.default_rng(5)
    centres = np.linalg.qr(rng.normal(size=(32, 32)))[0]
    which = rng.integers(0, 32, 2 * neardup.CELL)
    x = centres[which] + rng.normal(size=(len(which), 32)) * 0.02
    seen = []
    real = neardup._spread
    monkeypatch.setattr(neardup, "_spread", lambda radius, tally: seen.append(tally) or real(radius, tally))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec: (r.n_links, r.component) for r in neardup.near_duplicates(df).collect()}
    assert False in seen  # points were copied by windows, not only counted
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for i in range(0, len(x), 37):
        linked = np.flatnonzero(unit @ unit[i] >= 0.98)
        assert got[i][0] == len(linked) - 1
        assert got[i][1] <= linked.min()


def test_cells_in_a_task_skip_only_what_is_far():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5))
    x[::3] = x[0] + rng.normal(size=(200, 5)) * 0.05
    x /= np.linalg.norm(x, axis=1)[:, None]
    a, o = np.arange(0, 600, 2), np.arange(600)
    met = np.zeros((600, 600), bool)
    for m, others in neardup.meetings(x, a, o, 0.2):
        met[np.ix_(m, others)] = True
    close = x @ x.T >= 0.98
    assert met[a][close[a]].all() and met[a].mean() < 0.9
