"""Chunks and copy plans cover every document: short, empty and long ones."""

import hashlib

from treelake import catalog
from treelake.operators import deltas as D

TEXTS = {1: "short", 2: "", 3: None, 4: "é" * 1600, 5: "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(2000))}


def altered(text):
    half = len(text) // 2
    return (text[:half] + "<new>" + text[half:] + "!").encode()


def test_every_document_is_chunked_and_rebuilt(spark, tmp_path):
    rows = [(i, t, None if t is None else len(t)) for i, t in TEXTS.items()]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    chunked = {}
    for r in catalog.QUERIES["c15_chunks"](spark, str(tmp_path)).collect():
        chunked.setdefault(r.checksum, []).append((r.start, r.length, r.digest))
    want = {}
    for i, t in TEXTS.items():
        data, at = (t or "").encode(), 0
        for end in D.cut_points(data):
            want.setdefault(str(i), []).append((at, end - at, hashlib.sha256(data[at:end]).hexdigest()))
            at = end
    assert {k: sorted(v) for k, v in chunked.items()} == want and set(want) == {"1", "4", "5"}
    plans = {}
    for r in catalog.QUERIES["c16_copy_plan"](spark, str(tmp_path)).collect():
        plans.setdefault(r.checksum, []).append((r.start, r.length, r["from"]))
    assert set(plans) == {"1", "2", "4", "5"}
    for k, runs in plans.items():
        old, new = TEXTS[int(k)].encode() if int(k) % 3 else b"", altered(TEXTS[int(k)])
        assert [a for a, _, _ in sorted(runs)] == [sum(n for _, n, _ in sorted(runs)[:i]) for i in range(len(runs))]
        assert b"".join(new[a : a + n] if origin is None else old[origin : origin + n] for a, n, origin in sorted(runs)) == new
    assert any(origin is not None for _, _, origin in plans["5"])
    for name in ("c17_bsdiff", "c18_delta_round_trip"):
        got = {r.checksum: r.rebuilt for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == {str(i): None if t is None else hashlib.sha256(altered(t)).hexdigest() for i, t in TEXTS.items()}
    counts = {r.op: r.n for r in catalog.QUERIES["a06_opcode_counts"](spark, str(tmp_path)).collect()}
    assert counts["o"] == counts["c"] and counts["S"] + counts["o"] == 4 and counts["r"] == counts["R"]
