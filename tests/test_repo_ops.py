"""Whole-repository operators: known commit bytes, readers, ingest, checkout decisions, listings, rules and streams."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from treelake.functions import gvariant as G
from treelake.functions import hashing as H
from treelake.operators import deltas as D
from treelake.operators import history as Hi
from treelake.operators import refs as R
from treelake.operators import repo as P
from treelake.streaming import updates as U

ROOT = "1075002e681eb1fe7ff54ae6b76b1f65285e514b54d96deaa0952330b10c7983"
META = "446a0ef11b7cc167f3b603e585c7eeeeb675faa412d5ec73f62988eb0b6c5488"


def test_golden_commit(spark):
    """The small fixture's commit: known bytes from columns and from the codec, and read back."""
    meta = META
    row = spark.createDataFrame([("test/main", ROOT)], "ref string, r string")
    made = H.with_commit(H.with_binding(row, "ref", "m"), "hex", F.col("m"), F.lit(None).cast("string"), F.lit("fixture commit"), F.lit(""), F.lit(1700000000), F.col("r"), F.lit(meta))
    got = H.read_commit(made, "hex").first()
    data = bytes.fromhex(got.hex)
    assert hashlib.sha256(data).hexdigest() == "b3c8e8525e8a5c3409bf6e6db5f5d656da77ae76d08cbc4f8b75b71879757a89"
    assert data == G.commit_bytes(bytes.fromhex(ROOT), bytes.fromhex(meta), 1700000000, "fixture commit", metadata=[("ostree.ref-binding", ("as", ["test/main"]))])
    assert (got.parent, got.subject, got.body, got.ts, got.root, got.meta) == (None, "fixture commit", "", 1700000000, ROOT, meta)


def test_commit_columns_equal_the_codec(spark):
    rows = [(None, "", "", 0), ("ab" * 32, "s" * 300, "é" * 90, 1 << 40), ("cd" * 32, "x", "b" * 70_000, 5)]
    df = spark.createDataFrame(rows, "p string, s string, b string, t long")
    made = H.with_commit(df, "hex", F.lit(""), F.col("p"), F.col("s"), F.col("b"), F.col("t"), F.lit("11" * 32), F.lit("22" * 32))
    for r in H.read_commit(made.withColumn("p0", F.col("p")), "hex").collect():
        assert bytes.fromhex(r.hex) == G.commit_bytes(b"\x11" * 32, b"\x22" * 32, r.t, r.s, r.b, bytes.fromhex(r.p0 or ""))
        assert (r.parent, r.subject, r.body, r.ts) == (r.p0, r.s, r.b, r.t)
    mark = H.with_tombstone(spark.createDataFrame([("ef" * 32,)], "c string"), "c", "hex").first().hex
    assert bytes.fromhex(mark) == G.encode("a{sv}", [("commit", ("ay", ("ef" * 32).encode() + b"\0"))]) and len(mark) == 2 * 78


@pytest.mark.parametrize(
    ("sig", "value"),
    [("b", True), ("y", 7), ("n", -2), ("t", 1 << 63), ("d", 1.5), ("s", 'it\'s "q"\n'), ("as", []), ("as", ["a", "", "bc"]), ("ms", None), ("ay", b"\0\1"), ("a{sv}", [("k", ("u", 1)), ("k", ("as", ["q"]))]), ("(ys)", (1, "z")), ("()", ()), ("v", ("(yv)", (1, ("s", "in")))), ("amu", [None, (3,)]), ("a(si)", [("a", 1), ("b", 2)])],
)
def test_values_printed_and_parsed(sig, value):
    assert G.parse(G.show(sig, value)) == (sig, value) and G.parse(G.show(sig, value), sig) == (sig, value)


def test_parsing_infers_and_refuses():
    assert G.parse("[1, int64 2]") == ("ax", [1, 2]) and G.parse("[just 1, nothing]") == ("ami", [(1,), None]) and G.parse("0x10") == ("i", 16)
    assert G.parse("[]", "as") == ("as", []) and G.parse("'x'", "ms") == ("ms", ("x",)) and G.parse("{'a', 1}") == ("{si}", ("a", 1))
    for bad in ("", "[1, 'a']", "(1", "1 2", "[]", "nothing", "{'a'}", "<1", "[1 2]"):
        with pytest.raises(ValueError):
            G.parse(bad)


def test_stored_files_are_read(spark):
    header = (10).to_bytes(8, "big") + (5).to_bytes(4, "big") + (6).to_bytes(4, "big") + 0o100600.to_bytes(4, "big") + bytes(4) + b"\0" + bytes([25])
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    data = len(header).to_bytes(4, "big") + bytes(4) + header + c.compress(b"0123456789") + c.flush()
    assert P.parse_archive(data) == (5, 6, 0o100600, "", b"0123456789")
    with pytest.raises(ValueError):
        P.parse_archive(data[:15] + b"\x09" + data[16:])
    got = P.read_files(spark.createDataFrame([("a", "archive", bytearray(data)), ("b", "bare", bytearray(b"x"))], "checksum string, layout string, bytes binary")).collect()
    assert [(r.checksum, r.uid, r.mode, bytes(r.payload)) for r in got] == [("a", 5, 0o100600, b"0123456789"), ("b", 0, H.FILE_MODE, b"x")]
    objects = spark.createDataFrame([(2, "m", bytearray(b"1")), (1, "f", bytearray(b"2"))], "otype int, checksum string, payload binary")
    wanted = spark.createDataFrame([(2, "m"), (1, "f"), (1, "m"), (2, "m")], "otype int, checksum string")
    assert {(r.otype, r.checksum): r.outcome for r in P.read_objects(objects, wanted).collect()} == {(2, "m"): "found", (1, "f"): "found", (1, "m"): "absent"}


def test_ingest_of_a_folder(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_bytes(b"hello ostree\n")
    (tmp_path / "in/sub/b").write_bytes(b"")
    (tmp_path / "in/sub/skip.tmp").write_bytes(b"x")
    got = {r.path: r for r in P.ingest(spark, str(tmp_path / "in"), keep=~F.col("path").endswith(".tmp"), label=F.when(F.col("size") == 0, "empty")).collect()}
    assert set(got) == {"/a.txt", "/sub/b"} and got["/a.txt"].checksum[:8] == "cfffd52f" and got["/sub/b"].label == "empty" and got["/a.txt"].label is None
    other = P.ingest(spark, str(tmp_path / "in"), mode=0o100600).where("path = '/a.txt'").first()
    assert other.checksum != got["/a.txt"].checksum and other.mode == 0o100600


def test_checkout(spark):
    frame = lambda *x: spark.createDataFrame([tuple(r) for r in x], "path string, kind string, checksum string")
    tree = frame(("/d", "d", None), ("/d/new", "f", "1"), ("/d/same", "f", "2"), ("/d/other", "f", "3"), ("/f2d", "d", None), ("/d2f", "f", "4"), ("/d/.wh.old", "f", "0"))
    there = frame(("/d", "d", None), ("/d/same", "f", "2"), ("/d/other", "f", "9"), ("/f2d", "f", "5"), ("/d2f", "d", None), ("/d2f/x", "f", "6"), ("/d/old", "f", "7"), ("/stays", "f", "8"))
    run = lambda *a, **k: {r.path: r.action for r in P.checkout(tree, there, *a, **k).collect()}
    plain = {"/d/new": "add", "/d/.wh.old": "add"}
    assert run() == plain | dict.fromkeys(["/d", "/d/same", "/d/other", "/f2d", "/d2f"], "error")
    assert run("union") == plain | {"/d": "keep", "/d/same": "replace", "/d/other": "replace", "/f2d": "error", "/d2f": "error"}
    assert run("add") == plain | {"/d": "keep", "/d/same": "keep", "/d/other": "keep", "/f2d": "error", "/d2f": "keep"}
    assert run("identical") == plain | {"/d": "keep", "/d/same": "keep", "/d/other": "error", "/f2d": "error", "/d2f": "error"}
    assert run("union", whiteouts=True) == {"/d/new": "add", "/d/old": "delete", "/d": "keep", "/d/same": "replace", "/d/other": "replace", "/f2d": "replace", "/d2f": "replace", "/d2f/x": "delete"}
    gone = P.checkout(frame(("/.wh.nothing", "f", "0")), there, "union", whiteouts=True).collect()
    assert [(r.path, r.action) for r in gone] == [("/nothing", "error")]
    below = P.checkout(tree, there.limit(0), subpath="/d", keep=~F.col("path").startswith("/.wh")).collect()
    assert {(r.path, r.action) for r in below} == {("/new", "add"), ("/same", "add"), ("/other", "add")}
    with pytest.raises(ValueError):
        P.checkout(tree, there, "overwrite")


def test_specs_patterns_and_times(spark):
    forms = {"5GB": 5 << 30, "7MB": 7 << 20, "1TB": 1 << 40, "7KB": None, "7B": None, "10%": None, "GB": None, "5gb": None, "": None, None: None}
    got = {r.s: r.b for r in spark.createDataFrame([(s,) for s in forms], "s string").select("s", R.size_spec(F.col("s")).alias("b")).collect()}
    assert got == forms
    percent = {r.s: r.p for r in spark.createDataFrame([("0%",), ("100%",), ("101%",), ("5",), ("1000%",)], "s string").select("s", R.percent_spec(F.col("s")).alias("p")).collect()}
    assert percent == {"0%": 0, "100%": 100, "101%": None, "5": None, "1000%": None}
    refs = spark.createDataFrame([("local", None, "a/b"), ("remote", "o", "a/b"), ("remote", "p", "a/b"), ("collection", "org.x", "a/b"), ("collection", "own", "a/b")], "space string, qualifier string, name string")
    rules = ["**", "a/*", "*/b", "*:a/b", "o:**", "@org.x:**"]
    got = [r.rule for r in R.receive_rule(refs, rules, "own").collect()]
    assert got == [1, 4, 3, 5, 1]
    assert [r.rule for r in R.receive_rule(refs, rules).collect()] == [1, 4, 3, 5, None]


def test_receive_refuses_in_order(spark):
    rows = [(0, None, "n", False, True, "created"), (0, "o", "n", False, True, "not a fast-forward"), (0, "o", "n", True, True, "updated"), (0, "o", None, False, True, "delete refused"), (None, "o", "n", True, True, "no rule"), (1, "o", "n", True, True, "not accepted"), (2, "o", "n", False, False, "no valid signature"), (2, "o", "n", False, True, "updated"), (2, "o", None, False, False, "deleted"), (0, "n", "n", True, True, "unchanged")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "rule int, old string, new string, fast_forward boolean, verified boolean, want string, i int")
    rules = [{"accept": True, "delete": False, "verify": False, "force": False}, {"accept": False, "delete": True, "verify": False, "force": True}, {"accept": True, "delete": True, "verify": True, "force": True}]
    assert all(r.outcome == r.want for r in P.receive(df, rules).collect())
    hooked = {r.i: r.outcome for r in P.receive(df, rules, [lambda: F.col("i") == 2, lambda: F.col("i") < 4]).collect()}
    assert (hooked[0], hooked[1], hooked[2]) == ("hook 1", "not a fast-forward", "hook 0")


def test_keyfile_edits_keep_the_order(spark):
    lines = [(0, "a", None, "[a]"), (1, "a", "x", "x=1"), (2, "a", None, "# c"), (3, "b", None, "[b]"), (4, "b", "y", "y=2")]
    edits = [("a", "x", "x=9"), ("a", "w", "w=0"), ("b", "y", None), ("c", "q", "q=1"), ("d", None, None), ("a", "none", None)]
    out = R.edit_config(spark.createDataFrame([("f", *r) for r in lines], "file string, pos long, grp string, key string, text string"), spark.createDataFrame([("f", *r) for r in edits], "file string, grp string, key string, text string"))
    assert [r.text for r in out.orderBy("pos").collect()] == ["[a]", "x=9", "# c", "w=0", "[b]", "[c]", "q=1"]


def test_related_and_detached(spark):
    frame = lambda *x: spark.createDataFrame(list(x), "commit string, name string, checksum string")
    got = {tuple(r) for r in P.add_related(frame(("c", "a", "1"), ("c", "b", "2")), frame(("c", "a", "9"), ("c", "z", "3"))).collect()}
    assert got == {("c", "a", "9"), ("c", "b", "2"), ("c", "z", "3")}
    d = "array<struct<key:string,values:array<string>>>"
    df = spark.createDataFrame([([("s", ["x", "x"]), ("k", ["mine"])], [("s", ["y", "x"]), ("k", ["no"]), ("n", ["1"])]), ([], [])], f"a {d}, b {d}")
    merged = [[(e.key, e["values"]) for e in r.m] for r in df.select(P.merge_detached(F.col("a"), F.col("b"), ["s"], ["k"]).alias("m")).collect()]
    assert merged == [[("s", ["x", "x", "y"]), ("k", ["mine"]), ("n", ["1"])], []]


def test_chains_opcodes_and_sizes(spark):
    edges = spark.createDataFrame([("0", "1"), ("1", "2"), ("0", "2"), ("2", "3"), ("9", "9"), ("3", "0")], "src string, dst string")
    assert {r.node: r.deltas for r in Hi.chain_lengths(edges, spark.createDataFrame([("0",)], "checksum string")).collect()} == {"0": 0, "1": 1, "2": 1, "3": 2}
    ops, _, _ = D.write_part([(b"", b"abc", None, None), (b"", b"z" * 900 + b"!", hashlib.sha256(b"z" * 900).digest(), b"z" * 900)])
    assert D.opcodes(ops, [1, 1]) == ["S", "o", "r", "B", "R", "c"]
    with pytest.raises(ValueError):
        D.opcodes(ops, [1])
    rows = spark.createDataFrame([(5_001_564, "l"), (5_001_564, "B"), (0, "l")], "value long, order string")
    got = D.read_sizes(rows.withColumn("size", D.write_size(F.col("value"), F.col("order"))).withColumnRenamed("value", "was")).collect()
    assert [r.value for r in got] == [r.was for r in got] and got[1].size == "00000000004C515C" and got[0].size == "5C514C0000000000"


def test_varints_are_read(spark):
    numbers = [0, 1, 127, 128, 300, 1 << 20, (1 << 62) - 1]
    df = spark.createDataFrame([(n, D.varint(n).hex().upper() + "01") for n in numbers] + [(-1, "8000")], "n long, h string")
    got = {r.n: r.v for r in df.select("n", D.read_varint_hex(F.col("h")).alias("v")).collect()}
    assert got == {n: n for n in numbers} | {-1: None}


def test_stream_compares_the_expected_tip():
    class State:
        def __init__(self):
            self.exists, self.get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    import pandas as pd

    state = State()
    rows = [(1, 10, "set", None, "a"), (2, 11, "set", "x", "b"), (3, 12, "set", "a", "c"), (4, 5, "set", "*", "d"), (5, 13, "delete", "c", None), (6, 14, "set", None, "e")]
    (out,) = U.decide(("r",), iter([pd.DataFrame(rows, columns=["event_id", "t", "kind", "expected", "checksum"])]), state)
    assert out["outcome"].tolist() == ["set", "refused", "set", "late", "deleted", "set"] and state.get == ("e", 14)
    (again,) = U.decide(("r",), iter([pd.DataFrame(rows[:3], columns=["event_id", "t", "kind", "expected", "checksum"])]), state)
    assert set(again["outcome"]) == {"late"} and state.get == ("e", 14)


def test_operators_notice_a_fault(spark):
    """A changed byte, name or parent turns the row."""
    c = H.with_commit(spark.range(1), "hex", F.lit(""), F.lit(None).cast("string"), F.lit("s"), F.lit(""), F.lit(5), F.lit("11" * 32), F.lit("22" * 32))
    signed = R.sign(c.select(F.unhex("hex").alias("payload")), F.lit("k"))
    outcome = lambda p: signed.select(R.signature_outcome(p, F.col("signature"), F.lit("k"))).first()[0]
    assert outcome(F.col("payload")) == "ok" and outcome(F.concat("payload", F.lit("x").cast("binary"))) == "changed"
    refs = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "9")], "name string, checksum string")
    meta = spark.createDataFrame([("1", [("ref-binding", ["a"]), ("collection-binding", ["own"])])], "checksum string, metadata array<struct<key:string,value:array<string>>>")
    assert {r.name: r.outcome for r in R.check_bindings(refs, meta, "own").collect()} == {"a": "ok", "b": "not bound", "c": "no commit"}
    assert {r.name: r.outcome for r in R.check_bindings(refs, meta, "else").collect()}["a"] == "other collection"
