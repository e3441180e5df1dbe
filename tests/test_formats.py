"""Golden checksums, the codec, chunking, deltas, archives and the update stream."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from treelake.functions import codecs, gvariant
from treelake.functions import hashing as H
from treelake.operators import deltas as D
from treelake.operators import history as Hi
from treelake.operators import trees as T
from treelake.sources import derived as S
from treelake.streaming import updates as U

SF = "/root/testdata/sf0.001"


def test_golden_tree(spark):
    """The small fixture tree, owner 0:0: known checksums of files, metadata, empty directory and content."""
    rows = [("/hello.txt", "hello ostree\n".encode(), H.FILE_MODE, ""), ("/empty.txt", b"", H.FILE_MODE, ""), ("/subdir/nested.txt", b"nested\n", H.FILE_MODE, ""), ("/link", b"", 0o120777, "hello.txt")]
    df = spark.createDataFrame(rows, "path string, payload binary, mode int, target string")
    files = df.select("path", H.content_checksum(F.col("payload"), mode=F.col("mode"), target=F.col("target")).alias("checksum"))
    by = {r.path: r.checksum for r in files.collect()}
    assert by["/hello.txt"][:8] == "cfffd52f" and by["/hello.txt"][-5:] == "c91db"
    assert by["/subdir/nested.txt"][:8] == "a4d80a62" and by["/subdir/nested.txt"][-4:] == "a125"
    assert spark.range(1).select(H.dirmeta_checksum()).first()[0][:8] == "446a0ef1"
    assert T.write_tree(files.limit(0)).first().checksum[:8] == "6e340b9c"
    root = T.content_root(T.write_tree(files)).first()
    assert root.content_checksum == "d79e5560a90877b47660b639e3d7c88c20ca5a7604f867960e155c552025e104"


def test_tree_bytes_equal_the_codec(spark):
    """Offsets of one, two and four bytes."""
    rng = random.Random(1)
    for n in (1, 7, 300, 2500):
        rows = [(f"/f{rng.randrange(10**9)}-{i}", hashlib.sha256(bytes([i % 256])).hexdigest()) for i in range(n)]
        tree = T.write_tree(spark.createDataFrame(rows, "path string, checksum string")).first()
        value = (sorted((p[1:], bytes.fromhex(c)) for p, c in rows), [])
        assert tree.checksum == hashlib.sha256(gvariant.encode(gvariant.TREE, value)).hexdigest()


@pytest.mark.parametrize(
    ("sig", "value"),
    [("b", True), ("y", 7), ("n", -2), ("u", 1 << 31), ("t", 1 << 63), ("d", 1.5), ("s", "é"), ("as", []), ("as", ["a", "", "bc"]), ("ms", None), ("ms", ("x",)), ("mu", (3,)), ("ay", b"\0\1"), ("a{sv}", [("k", ("u", 1)), ("k", ("as", ["q"]))]), ("(ys)", (1, "z")), ("()", ()), ("(yut)", (1, 2, 3)), ("a(say)", [("n" * 300, b"1" * 32)] * 3), ("v", ("(yv)", (1, ("s", "in")))), ("(sas)", ("a", ["b"]))],
)
def test_codec(sig, value):
    data = gvariant.encode(sig, value)
    assert gvariant.decode(sig, data) == value
    assert gvariant.show(sig, value)
    with pytest.raises((ValueError, IndexError, Exception)):
        gvariant.decode(sig, data + b"\xff\xff\xff") if sig != "ay" else gvariant.decode("s", data)


def test_known_forms():
    assert gvariant.encode("(uuua(ayay))", (0, 0, gvariant.big(0o40755, 4), [])) == bytes.fromhex("0000000000000000000041ed")
    assert gvariant.encode(gvariant.TREE, ([], [])) == b"\0"
    assert gvariant.show("a{sv}", [("a", ("u", 1))]) == "{'a': <uint32 1>}"
    made = gvariant.decode(gvariant.COMMIT, gvariant.commit_bytes(b"r" * 32, b"m" * 32, 1700000000, "s", metadata=[("k", ("s", "v"))]))
    assert made[3] == "s" and made[5] == gvariant.big(1700000000, 8)
    with pytest.raises(ValueError):
        gvariant.commit_bytes(b"", b"", 0, related=[("b", b""), ("a", b"")])


def test_chunks_and_deltas():
    rng = random.Random(3)
    data = rng.randbytes(300_000)
    ends = D.cut_points(data)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == len(data) and all(D.LEAST <= s <= D.MOST for s in sizes[:-1])
    shifted = D.cut_points(b"x" * 100 + data)
    assert len({e + 100 for e in ends} & set(shifted)) > len(ends) / 2
    assert D.cut_points(b"") == [] and D.cut_points(b"abc") == [3]
    for n in (0, 1, 127, 128, 300, 1 << 40):
        assert D.read_varint(D.varint(n), 0) == (n, len(D.varint(n)))
    blob = b"hello world" + hashlib.sha256(b"old text").digest()
    ops = b"S" + D.varint(0) + D.varint(0) + D.varint(5) + D.varint(0) + b"o" + D.varint(0) + D.varint(0) + D.varint(8) + b"w" + D.varint(5) + D.varint(6) + b"r" + D.varint(11) + b"w" + D.varint(3) + D.varint(0) + b"Rc"
    sha = lambda kind, payload: hashlib.sha256(payload).digest()
    want = [(1, sha(1, b"hello")), (1, sha(1, b"worldold"))]
    assert D.run_opcodes(ops, blob, {blob[11:]: b"old text"}, want, sha) == [b"hello", b"worldold"]
    # a metadata object's S has two operands
    assert D.run_opcodes(b"S" + D.varint(5) + D.varint(6), blob, {}, [(2, sha(2, b"world"))], sha) == [b"world"]
    for bad in (ops[:-1], ops[:-2], ops + b"c", b"X", ops.replace(b"R", b"B")):
        with pytest.raises((ValueError, IndexError)):
            D.run_opcodes(bad, blob, {blob[11:]: b"old text"}, want, sha)
    with pytest.raises(ValueError):  # the hash decides
        D.run_opcodes(ops, blob, {blob[11:]: b"bad text"}, want, sha)


def rolling(data):
    """The chunker one byte at a time."""
    a = b = at = 0
    window, ends = [0] * D.WINDOW, []
    for i, byte in enumerate(data):
        pos = i - at
        a += byte - (dropped := window[pos % D.WINDOW])
        window[pos % D.WINDOW] = byte
        b += a - D.WINDOW * dropped
        if pos + 1 == D.MOST or pos + 1 >= D.LEAST and b % D.MEAN == D.MEAN - 1:
            ends.append(i + 1)
            a, b, at, window = 0, 0, i + 1, [0] * D.WINDOW
    return ends if not data or ends and ends[-1] == len(data) else [*ends, len(data)]


@pytest.mark.parametrize("data", [b"", b"abc", b"\0" * 200_000, b"ab" * 70_000, random.Random(5).randbytes(150_000), ("word list " * 9000).encode()])
def test_chunks_equal_the_rolling_form(data):
    assert D.cut_points(data) == rolling(data)


def test_copies_go_on_behind_the_last_one():
    rng = random.Random(9)
    block = rng.randbytes(40_000)
    source = block + b"-" * 70_000 + block + rng.randbytes(5000)
    target = rng.randbytes(3000) + source[: len(block) + 70_000 + 20_000] + b"new" + block
    runs = D.plan_runs(source, target)
    assert [r[0] for r in runs] == [sum(r[1] for r in runs[:i]) for i in range(len(runs))] and sum(r[1] for r in runs) == len(target)
    assert b"".join(target[a : a + n] if o is None else source[o : o + n] for a, n, o in runs) == target
    twice = block + block + b"end"
    assert D.plan_runs(twice, twice) == [(0, len(twice), 0)]  # chunks that the source has before don't break a run
    assert D.plan_runs(b"", target) == [(0, len(target), None)] and D.plan_runs(source, b"") == [] and D.plan_runs(source, source) == [(0, len(source), 0)]


@pytest.mark.parametrize("seed", range(6))
def test_patches_rebuild(seed):
    rng = random.Random(seed)
    source = rng.randbytes(rng.choice([0, 10, 500, 20_000]))
    target = bytearray(source * rng.choice([1, 2]))
    for _ in range(rng.randint(0, 12)):
        at = rng.randrange(len(target) + 1)
        target[at : at + rng.randint(0, 30)] = rng.randbytes(rng.randint(0, 30))
    target = bytes(target)
    patch = D.bsdiff(source, target)
    assert D.bspatch(source, patch, len(target)) == target
    if len(target) > 5000:
        assert D.worth_it(patch, len(target)) and not D.worth_it(D.bsdiff(rng.randbytes(5000), target), len(target))
    if patch:
        with pytest.raises(ValueError):
            D.bspatch(source, patch + b"x", len(target))
        with pytest.raises(ValueError):
            D.bspatch(source, patch, len(target) + 1)


def test_parts_rebuild_their_objects():
    rng = random.Random(2)
    old = [rng.randbytes(n) for n in (0, 900, 30_000, 200_000)]
    new = [b"first", bytes([old[1][0] ^ 1]) + old[1][1:], old[2][:10_000] + b"x" * 5 + old[2][10_000:], old[3][50_000:]]
    sha = lambda b: hashlib.sha256(b).digest()
    ops, blob, modes = D.write_part([(sha(n), n, sha(o) if o else None, o or None) for n, o in zip(new, old, strict=True)])
    assert {bytes([c]) for c in b"SoBrRwc"} <= {ops[i : i + 1] for i in range(len(ops))} and modes == [0o100644]
    assert D.run_opcodes(ops, blob, {sha(o): o for o in old}, [(1, sha(n)) for n in new], lambda _, p: sha(p)) == new
    assert len(blob) < sum(map(len, new)) / 3


def test_parts_are_packed_greedily(spark):
    rng = random.Random(4)
    rows = [(d, rng.choice([1, 1, 2, 3]), f"{rng.randrange(16**6):06x}{i}", rng.choice([0, 10, 400, 1500])) for i, d in enumerate(rng.choices([1, 2, 3, None], k=300))]
    got = {(r.delta, r.otype, r.checksum): r.part for r in D.pack_parts(spark.createDataFrame(rows, "delta int, otype int, checksum string, size long").repartition(5), 1500).collect()}
    expected = {}
    for d in (1, 2, 3, None):
        part = held = 0
        for _, otype, checksum, size in sorted((r for r in rows if r[0] == d), key=lambda r: (r[1] == 1, r[1], r[2])):
            if held and held + size > 1500:
                part, held = part + 1, 0
            held += size
            expected[d, otype, checksum] = part
    assert got == expected


def test_verity_of_known_sizes():
    assert codecs.fsverity(b"nested\n") == "0f9d7f7dc777cf5426c769d8b0ed7a11922d92dbb76d45cf5ade227ac659903e"
    assert len({codecs.fsverity(bytes(n)) for n in (1, 4095, 4096, 4097, 4096 * 129)}) == 5


def test_laws(spark):
    a, b = (S.files(spark, SF, v).select("path", F.lit("f").alias("kind"), "checksum") for v in (1, 2))
    assert T.diff(a, a).count() == 0
    there, back = ({(r.change, r.path) for r in T.diff(x, y).collect()} for x, y in ((a, b), (b, a)))
    swap = {"A": "D", "D": "A", "M": "M"}
    assert {(swap[c], p) for c, p in there} == back
    merged = T.merge(a, a.limit(0))
    assert merged.select("path", "kind", "checksum").exceptAll(a).count() == 0 and merged.count() == a.count()


def test_ancestry_by_jumps(spark):
    """Also where histories fork: two children of a parent aren't each other's ancestors."""
    rng = random.Random(6)
    parent = {i: rng.choice([i - 1, rng.randrange(i), None]) if i else None for i in range(120)}
    rows = [(f"c{i}", None if p is None else f"c{p}") for i, p in parent.items()]
    commits = spark.createDataFrame(rows, "checksum string, parent string")

    def behind(i):
        out = [i]
        while parent[out[-1]] is not None:
            out.append(parent[out[-1]])
        return out

    back = Hi.jumps(commits)
    assert {r.checksum: r.depth for r in Hi.depths(commits, back).collect()} == {f"c{i}": len(behind(i)) - 1 for i in parent}
    some = commits.where("checksum in ('c7', 'c50', 'c119')")
    assert {r.checksum for r in Hi.behind(some, back).collect()} == {f"c{j}" for i in (7, 50, 119) for j in behind(i)}
    asked = [(f"r{n}", f"c{rng.randrange(120)}", f"c{rng.randrange(120)}") for n in range(400)] + [("x", "gone", "c5"), ("y", "c5", "gone"), ("z", None, "c5")]
    got = {r.ref: r.fast_forward for r in Hi.fast_forward(commits, spark.createDataFrame(asked, "ref string, old string, new string")).collect()}
    assert got == {r: old is not None and "gone" not in (old, new) and int(old[1:]) in behind(int(new[1:])) for r, old, new in asked}
    ups = {(r.n, r.s): r.up for r in Hi.climb(spark.createDataFrame([(f"c{i}", s) for i in range(0, 120, 7) for s in (0, 1, 2, 5, 9, 1 << 40)], "n string, s long"), "n", "s", back).collect()}
    assert ups == {(f"c{i}", s): f"c{behind(i)[s]}" if s < len(behind(i)) else None for i in range(0, 120, 7) for s in (0, 1, 2, 5, 9, 1 << 40)}


def test_diff_of_directories(spark):
    rows = lambda *x: spark.createDataFrame([(p, k, c, m) for p, k, c, m in x], "path string, kind string, checksum string, meta string")
    a = rows(("/d", "d", "", "1"), ("/d/x", "f", "1", ""), ("/d/e", "d", "", "1"), ("/d/e/y", "f", "1", ""), ("/t", "d", "", "1"), ("/t/z", "f", "1", ""), ("/m", "d", "", "1"), ("/same", "f", "1", ""))
    b = rows(("/t", "f", "9", ""), ("/m", "d", "", "2"), ("/n", "d", "", "1"), ("/n/q", "f", "1", ""), ("/same", "f", "1", ""))
    assert sorted(map(tuple, T.diff(a, b).collect())) == [("A", "/n"), ("A", "/n/q"), ("D", "/d"), ("M", "/m"), ("M", "/t")]
    assert sorted(map(tuple, T.diff(b, a).collect())) == [("A", "/d"), ("A", "/d/e"), ("A", "/d/e/y"), ("A", "/d/x"), ("D", "/n"), ("M", "/m"), ("M", "/t")]


def test_closure_on_a_cycle_with_bounds(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "src string, dst string")
    roots = lambda *x: spark.createDataFrame(list(x), "node string, bound int")
    got = lambda *x: {r.node: r.bound for r in Hi.closure(roots(*x), edges).collect()}
    assert got(("a", Hi.ALL)) == dict.fromkeys("abcde", Hi.ALL)
    assert got(("a", 1), ("c", 1)) == {"a": 1, "b": 0, "c": 1, "d": 0}
    resets = spark.createDataFrame([("c", 0)], "node string, bound int")
    assert {r.node for r in Hi.closure(roots(("a", Hi.ALL)), edges, resets).collect()} == {"a", "b", "c"}


def test_update_stream(spark, tmp_path):
    rows = S.updates(spark, SF).select("ref", "event_id", (F.col("event_id") * 7919 % 1000).alias("t"), F.when(F.col("kind") == "error", "delete").otherwise("set").alias("kind"), "checksum")
    rows.orderBy("event_id").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    U.run_available(stream, str(tmp_path / "state"), lambda df, i: df.write.mode("overwrite").parquet(str(tmp_path / f"out/{i}")))
    got = {r.event_id: r.outcome for r in spark.read.parquet(str(tmp_path / "out/*")).collect()}
    floor, expected = {}, {}
    for r in sorted(rows.collect(), key=lambda r: r.event_id):
        late = r.ref in floor and r.t < floor[r.ref]
        expected[r.event_id] = "late" if late else "deleted" if r.kind == "delete" else "set"
        floor[r.ref] = floor[r.ref] if late else r.t
    assert got == expected
