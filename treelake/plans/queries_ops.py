"""Registered queries of whole-repository operators: objects and their bytes, deltas, rules, streams, reports.

Where a query needs faults, related commits, signatures or claims, they are put into its inputs, and the operator has to find them; the SQL gets at the rows by another way.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codecs, gvariant
from ..functions import hashing as H
from ..operators import deltas as D
from ..operators import history as Hi
from ..operators import refs as R
from ..operators import repo as P
from ..operators import trees as T
from ..sources import derived as S
from ..sources.derived import table, with_
from .durable import cut
from .queries import META, query


def sha(prefix: str, value) -> F.Column:
    return F.sha2(F.concat(F.lit(prefix), value.cast("string")).cast("binary"), 256)


def text(col) -> F.Column:
    return F.col(col).cast("string") if isinstance(col, str) else col.cast("string")


# objects


def _commit_bytes(spark, d) -> DataFrame:
    """(k, branch, seq, hex) of commits: bound to their branch, with a root each."""
    c = H.with_binding(S.commits(spark, d).withColumn("ref", F.concat(F.lit("cust/"), text("branch"))), "ref", "metadata")
    made = H.with_commit(c, "hex", F.col("metadata"), F.col("parent"), F.concat(F.lit("order "), text("k")), F.lit(""), F.col("ts"), sha("root:", F.col("k")), F.lit(META))
    return made.select("k", "branch", "seq", "hex")


#: The same bytes: every offset of these small commits takes one byte.
COMMIT_SQL = with_("commits") + f""", cm AS (SELECT *, 'cust/' || branch AS ref, 'order ' || k AS subject FROM commits),
    m AS (SELECT *, hex('ostree.ref-binding') || '000000000000' || hex(ref) || '00' || printf('%02X', length(ref) + 1) || '006173' || '13' AS entry FROM cm),
    n AS (SELECT *, entry || printf('%02X', length(entry) // 2) AS md FROM m),
    p AS (SELECT *, length(md) // 2 AS e1, length(md) // 2 + CASE WHEN parent IS NULL THEN 0 ELSE 32 END AS e2 FROM n),
    q AS (SELECT *, e2 + length(subject) + 1 AS e4 FROM p), r AS (SELECT *, (8 - (e4 + 1) % 8) % 8 AS pad FROM q),
    made AS (SELECT k, branch, parent, ts, subject, md || coalesce(upper(parent), '') || hex(subject) || '0000' || repeat('00', pad) || lpad(hex(ts), 16, '0') || upper(sha256('root:' || k)) || upper('{META}')
    || printf('%02X%02X%02X%02X%02X%02X', e4 + 1 + pad + 40, e4 + 1, e4, e2, e2, e1) AS hex FROM r)"""


@query(COMMIT_SQL + " SELECT k, sha256(unhex(hex)) AS checksum, length(hex) // 2 AS size FROM made")
def k03_write_commit(spark, d):
    return _commit_bytes(spark, d).select("k", F.sha2(F.unhex("hex"), 256).alias("checksum"), H.size_of(F.col("hex")).alias("size"))


@query(with_("commits") + f" SELECT k, parent, ts, 'order ' || k AS subject, '' AS body, sha256('root:' || k) AS root, '{META}' AS meta FROM commits")
def s13_load_commits(spark, d):
    """Every field, read back from the bytes."""
    return H.read_commit(_commit_bytes(spark, d), "hex").select("k", "parent", "ts", "subject", "body", "root", "meta")


@query(COMMIT_SQL + " SELECT sha256(unhex(hex)) AS checksum, parent, ts FROM made")
def p04_commit_links(spark, d):
    """Only the link and the time are read."""
    return H.read_commit(_commit_bytes(spark, d).withColumn("checksum", F.sha2(F.unhex("hex"), 256)), "hex").select("checksum", "parent", "ts")


@query(with_("commits") + ", g AS (SELECT checksum FROM commits WHERE k % 13 = 0), e AS (SELECT checksum, hex('commit') || '0000' || hex(checksum) || '00' || '006179' || '07' AS entry FROM g) SELECT checksum, length(entry) // 2 + 1 AS size, sha256(unhex(entry || printf('%02X', length(entry) // 2))) AS sum FROM e")
def r29_tombstones(spark, d):
    made = H.with_tombstone(S.commits(spark, d).where("k % 13 = 0"), "checksum", "hex")
    return made.select("checksum", H.size_of(F.col("hex")).alias("size"), F.sha2(F.unhex("hex"), 256).alias("sum"))


@query(with_("commits") + " SELECT k, CASE WHEN k % 2 = 0 THEN 'version' || CASE WHEN k % 3 <> 0 THEN ',' ELSE '' END ELSE '' END || CASE WHEN k % 3 <> 0 THEN 'ostree.ref-binding' || CASE WHEN k % 5 = 0 THEN ',ostree.collection-binding' ELSE '' END ELSE '' END AS keys, CASE WHEN k % 3 <> 0 THEN 'a/' || branch || ',z/' || branch END AS bound FROM commits")
def r25_metadata_builder(spark, d):
    """The caller's entries in their order, then the binding, its names sorted, and the collection only beside it."""
    c = S.commits(spark, d)
    none = F.array().cast("array<struct<key:string,value:array<string>>>")
    entry = lambda k, *v: F.array(F.struct(F.lit(k).alias("key"), F.array(*v).alias("value")))
    own = F.when(F.col("k") % 2 == 0, entry("version", text("k"))).otherwise(none)
    names = F.when(F.col("k") % 3 != 0, F.array(F.concat(F.lit("z/"), text("branch")), F.concat(F.lit("a/"), text("branch"))))
    collection = F.when(F.col("k") % 5 == 0, F.lit("org.own"))
    made = P.commit_metadata(own, names, collection)
    binding = F.filter(made, lambda e: e["key"] == H.BINDING)[0]["value"]
    return c.withColumn("m", made).select("k", F.array_join(F.transform("m", lambda e: e["key"]), ",").alias("keys"), F.array_join(F.try_element_at(F.filter("m", lambda e: e["key"] == H.BINDING), F.lit(1))["value"], ",").alias("bound"))


@query(with_("content") + " SELECT DISTINCT CASE WHEN l_ % 4 = 0 THEN 2 ELSE 1 END AS otype, checksum, CASE WHEN size % 17 = 0 THEN 'absent' ELSE 'found' END AS outcome FROM (SELECT *, size AS l_ FROM content)")
def s12_read_objects(spark, d):
    """Bytes by type and checksum; some aren't stored."""
    c = S.content(spark, d).withColumn("otype", F.when(F.col("size") % 4 == 0, 2).otherwise(1))
    objects = S.stored_objects(spark, d).join(c.where("size % 17 <> 0").select("checksum", "otype").distinct(), "checksum").select("otype", "checksum", "payload")
    return P.read_objects(objects, c.select("otype", "checksum")).select("otype", "checksum", "outcome")


@query("SELECT doc_id, 33188 AS mode, octet_length(encode(text)) AS size, sha256(text) AS payload_sha256 FROM documents")
def s19_read_files(spark, d):
    """Files in three layouts, read back through their headers."""
    docs = table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("payload"))
    header = H.file_header(F.lit(0), F.lit(0), F.lit(H.FILE_MODE), F.lit(""))
    stream = F.concat(F.unhex(F.concat(H.be32((F.length(header) / 2).cast("long")), F.lit("00000000"), header)), F.col("payload"))
    layout = F.when(F.col("doc_id") % 3 == 0, "archive").when(F.col("doc_id") % 3 == 1, "content").otherwise("bare")
    packed = docs.withColumn("deflated", codecs.deflate("payload"))
    stored = packed.select(text("doc_id").alias("checksum"), layout.alias("layout"), F.when(layout == "archive", P.archive_bytes(F.col("payload"), F.col("deflated"))).when(layout == "content", stream).otherwise(F.col("payload")).alias("bytes"))
    return P.read_files(stored).select(F.col("checksum").cast("long").alias("doc_id"), "mode", F.octet_length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("payload_sha256"))


@query()
def s20_directory_ingest(spark, d):
    """The files of two small tables as a tree; tested on folders of known files."""
    found = [P.ingest(spark, f"{d}/{name}.parquet", mode=F.when(F.col("size") > 2000, 0o100600).otherwise(H.FILE_MODE)) for name in ("nation", "region")]
    return found[0].unionByName(found[1])


@query(with_("commits", "refs") + " SELECT split_part(name, '/', 2) AS grp, count(*) AS refs, CAST(max(c.ts) AS BIGINT) AS newest, arg_max(name, name) AS last FROM refs r JOIN commits c ON c.checksum = r.checksum GROUP BY 1")
def s26_summary_read(spark, d):
    """A catalog, serialised for each group and parsed again: the typed value (name, (size, checksum, time))."""
    rows = S.refs(spark, d).join(S.commits(spark, d).select("checksum", "ts"), "checksum").select(F.split("name", "/")[1].alias("grp"), "name", "checksum", "ts")
    sig = "(a(s(tayt))a{sv})"

    def pack(pdf):
        entries = [(r.name, (0, bytes.fromhex(r.checksum), gvariant.big(int(r.ts), 8))) for r in pdf.sort_values("name").itertuples(index=False)]
        data = gvariant.encode(sig, (entries, [("ostree.summary.mode", ("s", "archive"))]))
        refs, _ = gvariant.decode(sig, data)
        times = [gvariant.big(t, 8) for _, (_, _, t) in refs]
        return pdf.iloc[:1].assign(refs=len(refs), newest=max(times), last=refs[-1][0])[["grp", "refs", "newest", "last"]]

    return rows.groupBy("grp").applyInPandas(pack, "grp string, refs long, newest long, last string")


@query(with_("commits") + """, t AS (SELECT parent AS src, checksum AS dst, k FROM commits WHERE parent IS NOT NULL)
    SELECT src, dst, 'deltas/' || substr(a, 1, 2) || '/' || substr(a, 3) || '-' || b AS path, sha256('superblock:' || k) AS digest FROM (SELECT *, replace(replace(base64(unhex(src)), '/', '_'), '=', '') AS a, replace(replace(base64(unhex(dst)), '/', '_'), '=', '') AS b FROM t)""")  # fmt: skip
def s27_delta_inventory(spark, d):
    """Names from stored paths, with digests of their superblocks."""
    c = S.commits(spark, d).where("parent is not null")
    a, b = H.modified_base64(F.col("parent")), H.modified_base64(F.col("checksum"))
    stored = c.select(F.concat(F.lit("deltas/"), F.substring(a, 1, 2), F.lit("/"), F.substr(a, F.lit(3)), F.lit("-"), b).alias("path"), F.concat(F.lit("superblock:"), text("k")).cast("binary").alias("superblock"))
    return D.inventory(stored)


@query(with_("f0") + " SELECT regexp_replace(path, '/[^/]*$', '') AS dir, regexp_extract(path, '[^/]*$') AS name, checksum, row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY path) AS pos, 'f' AS kind FROM f0 UNION ALL SELECT '/' || source, lang, NULL, row_number() OVER (PARTITION BY source ORDER BY lang), 'd' FROM (SELECT DISTINCT source, lang FROM f0) UNION ALL SELECT '', source, NULL, row_number() OVER (ORDER BY source), 'd' FROM (SELECT DISTINCT source FROM f0)")
def s17_tree_dir(spark, d):
    """Every directory's entries: files, then directories, each in byte order."""
    files = S.files(spark, d).select("path", "checksum", F.lit("f").alias("kind"))
    dirs = T.directories(files).where("path <> ''").select("path", F.lit(None).cast("string").alias("checksum"), F.lit("d").alias("kind"))
    rows = files.unionByName(dirs).select(T.parent(F.col("path")).alias("dir"), T.base(F.col("path")).alias("name"), "checksum", "kind")
    return rows.select("dir", "name", "checksum", F.row_number().over(Window.partitionBy("dir", "kind").orderBy("name")).cast("long").alias("pos"), "kind")


@query(with_("content") + " SELECT k, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes, CAST(coalesce(sum(size) FILTER (WHERE size % 13 = 0), 0) AS BIGINT) AS missing FROM (SELECT DISTINCT k, checksum, size FROM content) GROUP BY k")
def s16_commit_sizes(spark, d):
    """Sizes from the packed entries of each commit; an anti-join against the store says what is missing."""
    c = S.content(spark, d).select("k", "checksum", "size").distinct()
    packed = c.select("k", F.concat(F.upper("checksum"), H.varint(F.col("size")), H.varint(F.col("size")), F.lit("01")).alias("entry"))
    read = packed.select("k", F.lower(F.substring("entry", 1, 64)).alias("checksum"), D.read_varint_hex(F.substr("entry", F.lit(65))).alias("size"))
    there = c.where("size % 13 <> 0").select("checksum", F.lit(True).alias("there")).distinct()
    both = read.join(there, "checksum", "left")
    return both.groupBy("k").agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"), F.coalesce(F.sum(F.when(F.col("there").isNull(), F.col("size"))), F.lit(0)).alias("missing"))


@query(with_("commits") + " SELECT k, text, regexp_matches(text, '^[0-9a-f]{64}$') AS shaped FROM (SELECT k, checksum AS text FROM commits UNION ALL SELECT k, upper(checksum) FROM commits UNION ALL SELECT k, substr(checksum, 2) FROM commits)")
def f06_checksum_shaped(spark, d):
    c = S.commits(spark, d)
    rows = c.select("k", F.explode(F.array(F.col("checksum"), F.upper("checksum"), F.substring("checksum", 2, 63))).alias("text"))
    return rows.select("k", "text", R.checksum_shaped(F.col("text")).alias("shaped"))


@query("SELECT doc_id, sha256(lang) AS s, n_chars AS t, sha256(text) AS ay, source AS key FROM documents")
def c07_codec_round_trip(spark, d):
    """Typed values, encoded and decoded again in Arrow batches."""
    sig = "(sta{sv}ay)"

    def rows(batches):
        for b in batches:
            back = [gvariant.decode(sig, gvariant.encode(sig, (lang, n, [(source, ("u", 7))], text.encode()))) for lang, source, n, text in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)]
            columns = [b.column(0), pa.array([hashlib.sha256(x[0].encode()).hexdigest() for x in back]), pa.array([x[1] for x in back], pa.int64()), pa.array([hashlib.sha256(x[3]).hexdigest() for x in back]), pa.array([x[2][0][0] for x in back])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "s", "t", "ay", "key"])

    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", "text").mapInArrow(rows, "doc_id long, s string, t long, ay string, key string")


@query("SELECT doc_id, '(' || '''' || lang || '''' || ', uint64 ' || n_chars || ', [''' || source || ''', ''x''], {''k'': <' || CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'int64 -' || doc_id END || '>})' AS shown FROM documents")
def c08_text_round_trip(spark, d):
    """Values printed, parsed with inferred types, and printed again."""
    sig = "(stasa{sv})"

    def rows(batches):
        for b in batches:
            shown = []
            for doc, lang, source, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                value = (lang, n, [source, "x"], [("k", ("b", True) if doc % 2 == 0 else ("x", -doc))])
                found, back = gvariant.parse(gvariant.show(sig, value))
                shown.append(gvariant.show(found, back) if found == sig else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shown, pa.string())], ["doc_id", "shown"])

    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").mapInArrow(rows, "doc_id long, shown string")


# deltas


def _altered(spark, d) -> DataFrame:
    """(checksum, payload, source): each text with a few bytes put in and a few changed, and the text as it was; every third one without a source."""
    docs = table(spark, d, "documents")
    half = F.floor(F.length("text") / 2).cast("int")
    new = F.concat(F.substr("text", F.lit(1), half), F.lit("<new>"), F.substr("text", half + 1), F.lit("!"))
    return docs.select(text("doc_id").alias("checksum"), new.cast("binary").alias("payload"), F.when(F.col("doc_id") % 3 != 0, F.col("text").cast("binary")).alias("source"))


ALTERED = "SELECT CAST(doc_id AS VARCHAR) AS checksum, sha256(substr(text, 1, length(text) // 2) || '<new>' || substr(text, length(text) // 2 + 1) || '!') AS rebuilt FROM documents"


@query()
def c15_chunks(spark, d):
    """Content-defined chunks of every text; tested against a rolling form of the rule, byte by byte."""
    return D.chunks(table(spark, d, "documents").select(text("doc_id").alias("checksum"), F.col("text").cast("binary").alias("payload")))


@query()
def c16_copy_plan(spark, d):
    """Which runs of altered texts come from the old ones; tested by rebuilding."""
    return D.copy_plan(_altered(spark, d))


@query(ALTERED)
def c17_bsdiff(spark, d):
    """Every altered text from a patch against the old one."""

    def rows(batches):
        for b in batches:
            out = [None if new is None else hashlib.sha256(D.bspatch(old or b"", D.bsdiff(old or b"", new), len(new))).hexdigest() for new, old in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["checksum", "rebuilt"])

    return _altered(spark, d).mapInArrow(rows, "checksum string, rebuilt string")


@query(ALTERED)
def c18_delta_round_trip(spark, d):
    """A part's opcodes are written and run for every altered text: copies, patches, splices, each checked by its hash."""

    def rows(batches):
        digest = lambda _, payload: hashlib.sha256(payload).digest()
        for b in batches:
            out = []
            for new, old in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if new is None:
                    out.append(None)
                    continue
                name = hashlib.sha256(old).digest() if old else None
                ops, blob, _ = D.write_part([(b"", new, name, old or None)])
                (back,) = D.run_opcodes(ops, blob, {name: old}, [(1, hashlib.sha256(new).digest())], digest)
                out.append(hashlib.sha256(back).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["checksum", "rebuilt"])

    return _altered(spark, d).mapInArrow(rows, "checksum string, rebuilt string")


@query()
def a06_opcode_counts(spark, d):
    """How often each opcode stands in the parts that rebuild altered texts; tested on parts of known opcodes."""

    def rows(batches):
        for b in batches:
            out = []
            for new, old in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if new is not None:
                    out += D.opcodes(D.write_part([(b"", new, hashlib.sha256(old).digest() if old else None, old or None)])[0], [1])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["op"])

    return _altered(spark, d).mapInArrow(rows, "op string").groupBy("op").agg(F.count("*").alias("n"))


PACK = """o AS (SELECT DISTINCT k AS delta, CASE WHEN size % 5 = 0 THEN 2 ELSE 1 END AS otype, checksum, size FROM content),
    p AS (SELECT *, row_number() OVER (PARTITION BY delta ORDER BY otype = 1, otype, checksum) AS n FROM o),
    pack(delta, n, otype, checksum, part, held) AS (SELECT delta, n, otype, checksum, CAST(0 AS BIGINT), size FROM p WHERE n = 1 UNION ALL SELECT p.delta, p.n, p.otype, p.checksum, pack.part + CASE WHEN held + size > 900 THEN 1 ELSE 0 END, CASE WHEN held + size > 900 THEN size ELSE held + size END FROM pack JOIN p ON p.delta = pack.delta AND p.n = pack.n + 1)"""  # fmt: skip


@query(with_("content", recursive=True) + ", " + PACK + " SELECT delta, otype, checksum, part FROM pack")
def a13_pack_parts(spark, d):
    o = S.content(spark, d).select(F.col("k").alias("delta"), F.when(F.col("size") % 5 == 0, 2).otherwise(1).alias("otype"), "checksum", "size").distinct()
    return D.pack_parts(o, 900)


@query("SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_orderkey % 2 = 0 THEN h ELSE substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || repeat('00', 4) END AS size, l_partkey AS value FROM (SELECT *, lpad(hex(l_partkey), 16, '0') AS h FROM lineitem)")
def r06_delta_endianness(spark, d):
    """Size fields in the byte order that each delta states, written and read."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("value"), F.when(F.col("l_orderkey") % 2 == 0, "B").otherwise("l").alias("order"))
    return D.read_sizes(rows.withColumn("size", D.write_size(F.col("value"), F.col("order")))).select("k", "n", "size", "value")


@query(with_("commits") + " SELECT checksum AS delta, CASE WHEN k % 19 = 0 THEN 'corrupt' WHEN k % 23 = 0 THEN 'missing part' ELSE 'ok' END AS outcome FROM commits WHERE parent IS NOT NULL AND k % 10 <> 3")
def r05_verify_deltas(spark, d):
    """Deltas after some are deleted; their parts are hashed against what the superblock names. Faults are put into the stored parts."""
    c = S.commits(spark, d).where("parent is not null")
    k = F.col("k")
    parts = c.select(F.col("checksum").alias("delta"), "k", F.explode(F.array(F.lit(0), F.lit(1))).alias("part")).withColumn("right", F.concat(F.lit("part:"), text("k"), F.lit(":"), text("part")))
    named = parts.select("delta", "part", F.sha2(F.col("right").cast("binary"), 256).alias("sum"))
    stored = parts.where(~((k % 23 == 0) & (F.col("part") == 1) & (k % 19 != 0))).select("delta", "part", F.when((k % 19 == 0) & (F.col("part") == 0), F.concat("right", F.lit("?"))).otherwise(F.col("right")).cast("binary").alias("payload"))
    gone = c.where(k % 10 == 3).select(F.col("checksum").alias("delta"))
    return D.verify(named.join(gone, "delta", "left_anti"), stored)


EDGES = "e AS (SELECT c_custkey AS node, sha256('n:' || c_custkey) AS dst, sha256('n:' || (c_custkey // 2)) AS src, c_custkey // 2 AS to_ FROM customer)"


@query("WITH RECURSIVE " + EDGES + """, up(start, node, step) AS (SELECT node, node, 1 FROM e UNION ALL SELECT start, node // 2, step + 1 FROM up WHERE node // 2 > 0)
    SELECT sha256('n:' || start) AS target, max(step) AS deltas FROM up WHERE start > 0 GROUP BY start""")  # fmt: skip
def j16_delta_chain(spark, d):
    """For every commit, how few deltas lead to it from what is there (only the empty one): the graph is searched once, from the source."""
    k = F.col("c_custkey")
    edges = table(spark, d, "customer").select(sha("n:", F.expr("c_custkey div 2")).alias("src"), sha("n:", k).alias("dst"))
    have = spark.range(1).select(sha("n:", F.col("id")).alias("checksum"))
    return Hi.chain_lengths(edges, have).where("deltas > 0").select(F.col("node").alias("target"), F.col("deltas").cast("int").alias("deltas"))


# history


@query(with_("commits", "refs") + " SELECT name, count(*) AS history, CAST(count(*) - 1 AS BIGINT) AS depth FROM refs JOIN commits USING (branch) GROUP BY name")
def w06_history_by_ref(spark, d):
    """Along the parents, by jumps."""
    refs = S.refs(spark, d)
    deep = Hi.depths(refs, Hi.jumps(S.commits(spark, d)))
    return refs.join(deep, "checksum").select("name", (F.col("depth") + 1).alias("history"), "depth")


SINCE = with_("commits", recursive=True) + """, tip AS (SELECT branch, max(seq) AS seq FROM commits GROUP BY branch),
    s(branch, seq) AS (SELECT branch, seq FROM tip UNION ALL SELECT p.branch, p.seq FROM s JOIN commits c ON c.branch = s.branch AND c.seq = s.seq JOIN commits p ON p.checksum = c.parent WHERE p.ts >= 883612800)"""  # fmt: skip


@query(SINCE + " SELECT checksum FROM commits JOIN s USING (branch, seq)")
def j05_prune_since(spark, d):
    return Hi.since(S.commits(spark, d), ["seq"], "ts", 883612800).select("checksum")


@query(SINCE + " SELECT branch, count(*) AS kept FROM s GROUP BY branch")
def w03_since(spark, d):
    return Hi.since(S.commits(spark, d), ["seq"], "ts", 883612800).groupBy("branch").agg(F.count("*").alias("kept"))


@query(with_("commits", "refs") + """, w(prio, name) AS (SELECT 0, name FROM refs UNION ALL SELECT 1, 'gone/' || branch FROM refs), t AS (SELECT name, checksum FROM refs UNION ALL SELECT 'alias/' || branch, checksum FROM refs)
    SELECT a.asked, t.checksum FROM (SELECT name AS asked, name AS target FROM w UNION ALL SELECT 'alias/' || branch, 'alias/' || branch FROM refs) a LEFT JOIN t ON t.name = a.target""")  # fmt: skip
def r19_resolve_ref(spark, d):
    """Every ref, every alias of one, and names that nothing has."""
    refs = S.refs(spark, d)
    aliases = refs.select(F.concat(F.lit("alias/"), text("branch")).alias("name"), F.col("name").alias("target"))
    asked = refs.select(F.col("name").alias("asked")).unionByName(refs.select(F.concat(F.lit("gone/"), text("branch")).alias("asked"))).unionByName(aliases.select(F.col("name").alias("asked")))
    return R.resolve(asked, refs.select("name", "checksum"), aliases)


# rules


@query("""WITH r AS (SELECT s_suppkey AS k, ['local', 'remote', 'collection'][1 + s_suppkey % 3] AS space, CASE s_suppkey % 3 WHEN 1 THEN CASE WHEN s_nationkey % 2 = 0 THEN 'o' ELSE 'x' END WHEN 2 THEN CASE WHEN s_nationkey % 2 = 0 THEN 'org.own' ELSE 'org.b' END END AS q, CASE WHEN s_suppkey % 4 = 0 THEN 'app/main' ELSE 'main' END AS name FROM supplier)
    SELECT k, coalesce(space = 'remote' AND q = 'o' AND name = 'main', false) AS one, space = 'remote' AND name NOT LIKE '%/%' AS any_remote, coalesce(space = 'local' OR q = 'org.own', false) AS own, coalesce(q = 'org.b', false) AND space = 'collection' AND name <> 'main' AS chosen FROM r""")  # fmt: skip
def f03_receive_pattern(spark, d):
    k, even = F.col("s_suppkey"), F.col("s_nationkey") % 2 == 0
    q = F.when(k % 3 == 1, F.when(even, "o").otherwise("x")).when(k % 3 == 2, F.when(even, "org.own").otherwise("org.b"))
    rows = table(spark, d, "supplier").select(k.alias("k"), F.when(k % 3 == 0, "local").when(k % 3 == 1, "remote").otherwise("collection").alias("space"), q.alias("q"), F.when(k % 4 == 0, "app/main").otherwise("main").alias("name"))
    s, q, n = F.col("space"), F.col("q"), F.col("name")
    return rows.select("k", R.receives(s, q, n, "o:main").alias("one"), R.receives(s, q, n, "*:*").alias("any_remote"), R.receives(s, q, n, "@org.own:**", "org.own").alias("own"), R.receive_selected(s, q, n, ["@org.b:**", "!@org.b:main"], "org.own").alias("chosen"))


@query("""WITH rules AS (SELECT c_mktsegment AS who, 'ns' || c_nationkey % 4 AS namespace, 'cust/' || c_nationkey AS ref, c_custkey % 97 = 0 AS deny, CAST(2 ** (c_custkey % 5) AS INT) AS modes FROM customer),
    claims AS (SELECT who, namespace, ref, deny, 1 AS modes FROM rules WHERE namespace = 'ns1' AND who <> 'AUTOMOBILE'),
    a AS (SELECT *, 'claim' AS source FROM claims UNION ALL SELECT *, 'group' FROM rules WHERE NOT (namespace = 'ns1' AND who <> 'AUTOMOBILE')),
    g AS (SELECT who, namespace, ref, source, coalesce(bit_or(modes) FILTER (WHERE NOT deny), 0) AS m, bool_or(deny) AS deny FROM a GROUP BY ALL)
    SELECT who, namespace, ref, CASE WHEN deny THEN 0 WHEN m & 22 <> 0 THEN m | 1 ELSE m END AS modes, source FROM g""")  # fmt: skip
def f13_claims(spark, d):
    """Certificates of all segments but one claim read access in one namespace: there the groups' rules don't count."""
    c = table(spark, d, "customer")
    rules = c.select(F.col("c_mktsegment").alias("who"), F.concat(F.lit("ns"), text(F.col("c_nationkey") % 4)).alias("namespace"), F.concat(F.lit("cust/"), text("c_nationkey")).alias("ref"), F.when(F.col("c_custkey") % 97 == 0, "deny").otherwise("allow").alias("effect"), F.pow(F.lit(2), F.col("c_custkey") % 5).cast("int").alias("modes"))
    claims = rules.where("namespace = 'ns1' and who <> 'AUTOMOBILE'").withColumn("modes", F.lit(1))
    return R.claimed_rights(rules, claims)


@query("""WITH r AS (SELECT c_mktsegment AS who, c_nationkey AS n, c_custkey % 97 = 0 AS deny, c_custkey % 5 AS b FROM customer WHERE c_custkey % 3 = 0),
    ok AS (SELECT who, n FROM r GROUP BY 1, 2 HAVING NOT bool_or(deny) AND bool_or(b IN (0, 1, 2, 4)))
    SELECT who, count(*) AS readable FROM ok JOIN customer ON c_nationkey = n GROUP BY who""")  # fmt: skip
def f10_read_access(spark, d):
    """Refs are counted for each namespace before the rights meet them."""
    from .queries import _rules

    ok = R.rights(_rules(spark, d)).where("modes & 1 <> 0")
    refs = table(spark, d, "customer").groupBy(F.concat(F.lit("cust/"), text("c_nationkey")).alias("ref")).agg(F.count("*").alias("n"))
    return ok.join(refs, "ref").groupBy("who").agg(F.sum("n").alias("readable"))


@query(with_("commits", "refs") + " SELECT name, CASE WHEN c.k % 8 = 0 THEN 'not bound' WHEN c.k % 5 = 0 THEN 'other collection' ELSE 'ok' END AS outcome FROM refs r JOIN commits c USING (checksum)")
def f16_binding_checks(spark, d):
    """The tips' binding metadata, against the refs that name them. Faults: tips bound to another ref or collection."""
    c = S.commits(spark, d)
    bound = F.when(F.col("k") % 8 == 0, F.array(F.lit("other"))).otherwise(F.array(F.lit("other"), F.concat(F.lit("b/"), text("branch"))))
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    metadata = c.select("checksum", F.array(entry("version", F.array(text("seq"))), entry("ref-binding", bound), entry("collection-binding", F.array(F.when(F.col("k") % 5 == 0, "org.other").otherwise("org.own")))).alias("metadata"))
    refs = S.refs(spark, d).withColumn("named", F.concat(F.lit("b/"), text("branch")))
    return R.check_bindings(refs, metadata, "org.own", "named").select("name", "outcome")


@query("SELECT p_partkey AS k, mode, special IN (0, 1) AND grp IN (0, 1, 4, 5) AND other IN (0, 1, 4, 5) AS canonical, special IN (0, 1) AS bare_user_only FROM (SELECT p_partkey, p_size * 100 AS mode, p_size * 100 // 512 % 8 // 2 * 2 AS special, p_size * 100 // 8 % 8 AS grp, p_size * 100 % 8 AS other FROM part)")
def f17_mode_checks(spark, d):
    """Whether a file's permission bits are canonical (nobody else may write, no set-id), and whether an unprivileged store takes them (no set-id)."""
    mode = F.col("p_size") * 100
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), mode.alias("mode"), R.canonical_mode(mode).alias("canonical"), R.unprivileged_mode(mode).alias("bare_user_only"))


@query("SELECT s_suppkey AS k, a.spec, a.bytes, a.percent FROM supplier, LATERAL (SELECT unnest([s_suppkey || 'GB', s_suppkey || 'MB', s_suppkey || 'TB', s_suppkey || 'KB', s_suppkey || 'B', s_suppkey || '%', 'x' || s_suppkey || 'GB', s_suppkey || ' GB']) AS spec, unnest([s_suppkey * 1073741824, s_suppkey * 1048576, s_suppkey * 1099511627776, NULL, NULL, NULL, NULL, NULL]) AS bytes, unnest([NULL, NULL, NULL, NULL, NULL, CASE WHEN s_suppkey <= 100 THEN CAST(s_suppkey AS INT) END, NULL, NULL]) AS percent) a")
def c12_size_spec(spark, d):
    k = text("s_suppkey")
    forms = F.array(*[F.concat(F.lit(a), k, F.lit(b)) for a, b in (("", "GB"), ("", "MB"), ("", "TB"), ("", "KB"), ("", "B"), ("", "%"), ("x", "GB"), ("", " GB"))])
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.explode(forms).alias("spec"))
    return rows.select("k", "spec", R.size_spec(F.col("spec")).alias("bytes"), R.percent_spec(F.col("spec")).alias("percent"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id WHEN event_id % 5 IN (1, 2) THEN user_id WHEN event_id % 5 = 3 THEN NULL ELSE CAST(floor(epoch(ts)) AS BIGINT) END AS t, event_id % 3 <> 0 AND event_id % 5 = 3 AS error FROM events")
def c13_timestamp_choice(spark, d):
    """Explicit, else the environment's (trimmed; an error where it is no number), else the clock."""
    k = F.col("event_id")
    env = F.when(k % 5 == 1, text("user_id")).when(k % 5 == 2, F.concat(F.lit("  "), text("user_id"), F.lit("\n"))).when(k % 5 == 3, F.concat(text("user_id"), F.lit("x")))
    t, error = R.commit_time(F.when(k % 3 == 0, k), env, F.unix_timestamp(F.col("ts").cast("timestamp")))
    return table(spark, d, "events").select("event_id", t.alias("t"), error.alias("error"))


@query("SELECT s_suppkey AS k, s_suppkey * 1000000 AS planned, CASE s_suppkey % 3 WHEN 0 THEN 100000000 - s_suppkey * 1000000 < 52428800 WHEN 1 THEN 100000000 - s_suppkey * 1000000 < 20000000 ELSE 100000000 - s_suppkey * 1000000 < 6000000 END AS refused FROM supplier")
def r32_free_space(spark, d):
    k = F.col("s_suppkey")
    size, percent = F.when(k % 3 == 0, "50MB"), F.when(k % 3 != 2, "10%")
    refused = R.free_space_refused(k * 1000000, F.lit(100000000), F.lit(200000000), size, percent)
    return table(spark, d, "supplier").select(k.alias("k"), (k * 1000000).alias("planned"), refused.alias("refused"))


@query("SELECT p_partkey AS k, m AS mode, CASE WHEN p_partkey % 3 = 0 THEN 511 ELSE (m & 493) | 420 END AS canonical, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 0 END AS uid FROM (SELECT *, p_size * 100 & 4095 AS m FROM part)")
def p06_canonical_mode(spark, d):
    """Files get owner 0, no set-id and no write bit of others; links keep 0777 and their owner stays unset."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 3 == 0, "l").otherwise("f").alias("kind"), (F.col("p_size") * 100).bitwiseAND(0o7777).alias("mode"))
    mode, uid = R.canonical_permissions(F.col("kind"), F.col("mode"))
    return rows.select("k", "mode", mode.alias("canonical"), uid.alias("uid"))


# signatures, trust, detached metadata


@query("SELECT doc_id, doc_id % 4 = 1 OR doc_id % 6 = 0 AS valid, CASE WHEN doc_id % 6 = 0 THEN 'a0,b' || doc_id % 4 ELSE 'a1,b' || doc_id % 4 END AS signatures FROM documents")
def c20_dummy_signature(spark, d):
    """Two signatures for each text; the plain engine trusts one that equals a trusted key."""
    doc = F.col("doc_id")
    a = F.struct(F.lit("plain").alias("engine"), F.when(doc % 6 == 0, "a0").otherwise("a1").alias("signature"))
    b = F.struct(F.lit("plain").alias("engine"), F.concat(F.lit("b"), text(doc % 4)).alias("signature"))
    rows = table(spark, d, "documents").select("doc_id", F.inline(F.array(a, b)))
    trusted = spark.createDataFrame([("plain", "a0"), ("plain", "b1"), ("other", "a1")], "engine string, signature string")
    return R.verified(rows, trusted, "doc_id").select("doc_id", "valid", F.array_join("signatures", ",").alias("signatures"))


@query("SELECT c_nationkey AS commit_, bool_or(c_custkey % 7 = 1 OR c_custkey % 10 = 0) AS valid, count(*) AS signatures FROM customer GROUP BY 1")
def a12_verify_outcome(spark, d):
    """Valid if any of two engines trusts any signature; all are listed."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("commit_"), F.when(k % 2 == 0, "x").otherwise("y").alias("engine"), F.concat(F.lit("s"), text("c_custkey")).alias("signature"))
    trusted = table(spark, d, "customer").where((k % 7 == 1) | (k % 10 == 0)).select(F.when(k % 2 == 0, "x").otherwise("y").alias("engine"), F.concat(F.lit("s"), text("c_custkey")).alias("signature"))
    return R.verified(rows, trusted, "commit_").select("commit_", "valid", F.size("signatures").cast("long").alias("signatures"))


@query(with_("commits", "refs") + " SELECT grp, CASE WHEN grp % 3 = 0 THEN 'changed' WHEN grp % 3 = 1 THEN 'ok' ELSE 'unsigned' END AS outcome FROM (SELECT DISTINCT CAST(split_part(name, '/', 2) AS INT) AS grp FROM refs)")
def r08_summary_signing(spark, d):
    """A keyed digest signs each group's catalog; some are changed behind it, some aren't signed. The check hashes again."""
    entry = F.concat_ws(" ", "name", "checksum")
    book = S.refs(spark, d).groupBy(F.split("name", "/")[1].cast("int").alias("grp")).agg(F.array_join(F.array_sort(F.collect_list(entry)), "\n").cast("binary").alias("payload"))
    signed = R.sign(book, F.lit("secret")).select("grp", F.when(F.col("grp") % 3 != 2, F.col("signature")).alias("signature"), F.when(F.col("grp") % 3 == 0, F.concat("payload", F.lit("x").cast("binary"))).otherwise(F.col("payload")).alias("payload"))
    return signed.select("grp", R.signature_outcome(F.col("payload"), F.col("signature"), F.lit("secret")).alias("outcome"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'ok' END AS outcome, sha256('k' || doc_id % 3 || sha256(text)) AS signature FROM documents")
def h07_sign_and_verify(spark, d):
    """A signer and a verifier passed as columns: the key depends on the row."""
    key = F.concat(F.lit("k"), text(F.col("doc_id") % 3))
    docs = R.sign(table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("payload")), key)
    read = docs.withColumn("payload", F.when(F.col("doc_id") % 5 == 0, F.concat("payload", F.lit("!").cast("binary"))).otherwise(F.col("payload")))
    return read.select("doc_id", R.signature_outcome(F.col("payload"), F.col("signature"), key).alias("outcome"), "signature")


@query("SELECT 'remote \"' || s_suppkey || '\"' AS grp, CASE WHEN s_suppkey % 2 = 0 THEN 'false' ELSE 'true' END AS gpg_verify, CASE WHEN s_suppkey % 3 = 0 THEN 'ed25519' ELSE 'none' END AS sign_verify, CASE WHEN s_suppkey % 3 = 0 THEN '/keys/' || s_suppkey ELSE '' END AS key_file FROM supplier")
def r09_trust_policy(spark, d):
    """Config text, parsed to one policy a remote: which checks apply, and with which keys; a repeated key's last value counts."""
    s, k = table(spark, d, "supplier"), text("s_suppkey")
    lines = F.array(F.concat(F.lit('[remote "'), k, F.lit('"]')), F.lit("gpg-verify = maybe"), F.when(F.col("s_suppkey") % 2 == 0, "gpg-verify=false").otherwise("gpg-verify=true"), F.when(F.col("s_suppkey") % 3 == 0, "sign-verify = ed25519").otherwise("# none"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("key-file=/keys/"), k)).otherwise(""))
    rows = s.select(F.col("s_name").alias("file"), F.posexplode(lines).alias("pos", "line"))
    parsed = R.parse_config(rows, keep_pos=True).select("grp", F.col("key").alias("name"), "value", "pos")
    return R.resolved_settings(parsed, "grp", {"gpg-verify": "true", "sign-verify": "none", "key-file": ""})


@query("""WITH l AS (SELECT s_name AS file, s_suppkey AS k FROM supplier), o AS (
    SELECT file, k, 1 AS p, 'core' AS grp, NULL AS key, '[core]' AS text FROM l UNION ALL SELECT file, k, 2, 'core', 'mode', 'mode=archive' FROM l UNION ALL SELECT file, k, 3, 'core', NULL, '# note' FROM l
    UNION ALL SELECT file, k, 4, 'core', 'new', 'new=' || k FROM l WHERE k % 2 = 0 UNION ALL SELECT file, k, 5, 'a', NULL, '[a]' FROM l WHERE k % 3 <> 0 UNION ALL SELECT file, k, 6, 'a', 'url', CASE WHEN k % 2 = 0 THEN 'url=new' ELSE 'url=old' END FROM l WHERE k % 3 <> 0
    UNION ALL SELECT file, k, 7, 'z', NULL, '[z]' FROM l WHERE k % 2 = 0 UNION ALL SELECT file, k, 8, 'z', 'list', 'list=a;b;' FROM l WHERE k % 2 = 0)
    SELECT file, row_number() OVER (PARTITION BY file ORDER BY p) AS pos, grp, key, text FROM o""")  # fmt: skip
def r13_keyfile_edits(spark, d):
    """Set in place, set anew, a new group, a removed key, a removed group; everything else keeps its order."""
    s = table(spark, d, "supplier").select(F.col("s_name").alias("file"), F.col("s_suppkey").alias("k"))
    line = lambda grp, key, text_: F.struct(F.lit(grp).alias("grp"), F.lit(key).cast("string").alias("key"), F.lit(text_).alias("text"))
    old = s.select("file", F.posexplode(F.array(line("core", None, "[core]"), line("core", "mode", "mode=archive"), line("core", None, "# note"), line("core", "gone", "gone=1"), line("a", None, "[a]"), line("a", "url", "url=old"))).alias("pos", "e")).select("file", F.col("pos").cast("long").alias("pos"), "e.*")
    edit = lambda grp, key, text_: F.struct(F.lit(grp).alias("grp"), F.lit(key).cast("string").alias("key"), text_.cast("string").alias("text"))
    always = s.select("file", F.inline(F.array(edit("core", "gone", F.lit(None)))))
    even = s.where("k % 2 = 0").select("file", F.inline(F.array(edit("core", "new", F.concat(F.lit("new="), text("k"))), edit("a", "url", F.lit("url=new")), edit("z", "list", F.lit("list=a;b;")))))
    third = s.where("k % 3 = 0").select("file", F.inline(F.array(edit("a", None, F.lit(None)))))
    return R.edit_config(old, always.unionByName(even.join(third.select("file", "grp"), ["file", "grp"], "left_anti")).unionByName(third))


@query("""SELECT c_custkey AS c, 'sign=' || CASE WHEN c_custkey % 3 = 0 THEN 'x,x,y,z' ELSE 'x,x' END || ';note=' || CASE WHEN c_custkey % 3 = 0 THEN 'theirs' ELSE 'mine' END || ';local=own' || CASE WHEN c_custkey % 3 = 0 THEN ';extra=e' ELSE '' END AS merged FROM customer""")
def k06_merge_detached(spark, d):
    """Signature lists unite (what is stored twice stays), other keys are replaced in place, a local key stays, new keys follow."""
    entry = lambda k, *v: F.struct(F.lit(k).alias("key"), F.array(*map(F.lit, v)).alias("values"))
    stored = F.array(entry("sign", "x", "x"), entry("note", "mine"), entry("local", "own"))
    incoming = F.when(F.col("c_custkey") % 3 == 0, F.array(entry("extra", "e"), entry("note", "theirs"), entry("local", "theirs"), entry("sign", "y", "x", "z", "y"))).otherwise(F.array().cast("array<struct<key:string,values:array<string>>>"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("c"), stored.alias("stored"), incoming.alias("incoming"))
    made = P.merge_detached(F.col("stored"), F.col("incoming"), ["sign"], ["local"])
    return c.select("c", F.array_join(F.transform(made, lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["values"], ","))), ";").alias("merged"))


@query(with_("commits") + " SELECT checksum AS commit_, name, target FROM (SELECT checksum, 'base' AS name, parent AS target FROM commits WHERE parent IS NOT NULL AND k % 2 <> 0 UNION ALL SELECT checksum, 'base', sha256('new:' || k) FROM commits WHERE k % 2 = 0 UNION ALL SELECT checksum, 'tool', sha256('tool:' || branch) FROM commits WHERE k % 4 = 0)")
def k05_detached_related(spark, d):
    """Related entries added to what a commit has: a name's entry is replaced, others stay."""
    c = S.commits(spark, d)
    row = lambda name, target: (F.col("checksum").alias("commit"), F.lit(name).alias("name"), target.alias("checksum"))
    stored = c.where("parent is not null").select(*row("base", F.col("parent")))
    new = c.where("k % 2 = 0").select(*row("base", sha("new:", F.col("k")))).unionByName(c.where("k % 4 = 0").select(*row("tool", sha("tool:", F.col("branch")))))
    return P.add_related(stored, new).select(F.col("commit").alias("commit_"), "name", F.col("checksum").alias("target"))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'sign=x' ELSE '' END || CASE WHEN c_custkey % 2 = 0 THEN ';' ELSE '' END || 'note=gone' AS kept FROM customer")
def r07_delete_signatures(spark, d):
    """One signature is taken out of its list; a list without any goes, other keys stay."""
    entry = lambda k, *v: F.struct(F.lit(k).alias("key"), F.array(*map(F.lit, v)).alias("values"))
    held = F.when(F.col("c_custkey") % 2 == 0, F.array(entry("sign", "x", "gone"), entry("note", "gone"))).otherwise(F.array(entry("sign", "gone"), entry("note", "gone")))
    left = P.drop_signatures(held, "sign", F.lit("gone"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.array_join(F.transform(left, lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["values"], ","))), ";").alias("kept"))


@query(with_("commits") + """ SELECT checksum AS commit_, 'dependencies' AS field, 0 AS index, 'base' AS name, parent AS target, NULL AS defect FROM commits WHERE parent IS NOT NULL
    UNION ALL SELECT checksum, 'dependencies', CASE WHEN parent IS NULL THEN 0 ELSE 1 END, '', sha256('dep:' || k), 'empty name' FROM commits WHERE k % 7 = 0
    UNION ALL SELECT checksum, 'sources', 0, 'src/' || branch, CASE WHEN k % 3 <> 0 THEN sha256('src:' || k) END, CASE WHEN k % 3 = 0 THEN 'checksum of 20 bytes' END FROM commits""")  # fmt: skip
def p08_related_split(spark, d):
    """Dependencies and build sources of every commit, in stored order, with the defects of their entries."""
    c = S.commits(spark, d)
    entry = lambda name, sum_: F.struct(name.alias("name"), F.unhex(sum_).alias("checksum"))
    some = lambda when, e: F.when(when, F.array(e)).otherwise(F.array().cast("array<struct<name:string,checksum:binary>>"))
    deps = F.concat(some(F.col("parent").isNotNull(), entry(F.lit("base"), F.col("parent"))), some(F.col("k") % 7 == 0, entry(F.lit(""), sha("dep:", F.col("k")))))
    right = sha("src:", F.col("k"))
    sources = F.array(entry(F.concat(F.lit("src/"), text("branch")), F.when(F.col("k") % 3 == 0, F.substring(right, 1, 40)).otherwise(right)))
    return P.split_related(c.select(F.col("checksum").alias("commit"), deps.alias("dependencies"), sources.alias("sources"))).select(F.col("commit").alias("commit_"), "field", "index", "name", F.col("checksum").alias("target"), "defect")


# listings, media, images


LISTING = with_("commits", "refs", recursive=True) + """, rr AS (SELECT c_mktsegment AS who, 'cust/' || c_nationkey AS ref, c_custkey % 97 = 0 AS deny, c_custkey % 5 AS b FROM customer WHERE c_custkey % 3 = 0),
    ok AS (SELECT ref FROM rr WHERE who = 'BUILDING' GROUP BY ref HAVING NOT bool_or(deny) AND bool_or(b IN (0, 1, 2, 4))),
    listed AS (SELECT name, 'cust/' || split_part(name, '/', 2) AS space, checksum FROM refs WHERE ('cust/' || split_part(name, '/', 2)) IN (SELECT ref FROM ok) AND split_part(name, '/', 2) <> '7')"""  # fmt: skip


def _listing(spark, d) -> tuple[DataFrame, DataFrame]:
    from .queries import _rules

    refs = S.refs(spark, d).select("name", F.substring_index("name", "/", 2).alias("space"), "checksum")
    deltas = S.commits(spark, d).where("parent is not null and k % 4 <> 0").select(F.col("parent").alias("src"), F.col("checksum").alias("dst"))
    return P.ref_listing(refs, R.selected(F.col("name"), ["cust/*/*", "!cust/7/*"]), R.rights(_rules(spark, d)), "BUILDING", deltas)


@query(LISTING + " SELECT name, space, checksum FROM listed")
def r31_ref_endpoint(spark, d):
    """What one reader is told of the refs: selected, and readable with its rights."""
    return _listing(spark, d)[0].select("name", "space", "checksum")


@query(LISTING + """, e AS (SELECT parent AS src, checksum AS dst FROM commits WHERE parent IS NOT NULL AND k % 4 <> 0),
    walk(node) AS (SELECT checksum FROM listed UNION SELECT e.src FROM walk JOIN e ON e.dst = walk.node) SELECT src, dst FROM e WHERE dst IN (SELECT node FROM walk)""")  # fmt: skip
def k15_ref_listing(spark, d):
    """The deltas that lead to the listed commits, along the chain of indexes."""
    return _listing(spark, d)[1].select("src", "dst")


@query(with_("commits", "refs", "content", recursive=True) + """, walk(checksum, left_) AS (SELECT checksum, 3 FROM refs WHERE branch % 3 = 0 UNION ALL SELECT c.parent, left_ - 1 FROM walk JOIN commits c USING (checksum) WHERE c.parent IS NOT NULL AND left_ > 0),
    kept AS (SELECT DISTINCT checksum FROM walk), whole AS (SELECT 'commit' AS kind, checksum FROM kept UNION ALL SELECT DISTINCT 'object', o.checksum FROM content o JOIN commits c USING (k) JOIN kept ON kept.checksum = c.checksum)
    SELECT kind, checksum FROM whole WHERE checksum NOT IN (SELECT checksum FROM commits WHERE k % 10 = 0) AND checksum NOT IN (SELECT checksum FROM content WHERE size % 10 = 0)""")  # fmt: skip
def k18_media_export(spark, d):
    """What an export still has to copy: commits of a third of the branches to a depth of three and their objects, less what the media holds."""
    c, o = S.commits(spark, d), S.content(spark, d)
    there = c.where("k % 10 = 0").select("checksum").unionByName(o.where("size % 10 = 0").select("checksum")).distinct()
    return P.media_copy(S.refs(spark, d).where("branch % 3 = 0"), c.select("checksum", "parent", "k"), o, there, 3)


@query("SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 = 0 THEN 'no volume' WHEN s_suppkey % 5 = 0 THEN 'untrusted' WHEN s_nationkey = 3 THEN 'no such ref' ELSE 'ok' END AS reason FROM supplier")
def r17_media_reasons(spark, d):
    """Why a wanted ref isn't taken from a medium: candidates, trust and what volumes hold are joined."""
    s = table(spark, d, "supplier")
    wanted = s.select(F.col("s_suppkey").alias("k"), text("s_nationkey").alias("collection"), F.lit("main").alias("name"))
    volumes = s.where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("k"))
    keys = s.where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("k"))
    held = s.select(text("s_nationkey").alias("collection"), F.when(F.col("s_nationkey") == 3, "other").otherwise("main").alias("name")).distinct()
    return P.import_reasons(wanted, volumes, keys, held).select("k", "reason")


@query("SELECT s_suppkey AS remote, 'org.c' || s_nationkey AS id, name FROM supplier, (SELECT unnest(['main', 'dev', 'app/x']) AS name) WHERE name <> 'dev' AND s_suppkey % 3 <> 0")
def r18_remote_collection_refs(spark, d):
    """Collection refs that remotes' catalogs list, with a selector; a remote without a catalog lists none."""
    s = table(spark, d, "supplier")
    book = s.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("remote"), F.concat(F.lit("org.c"), text("s_nationkey")).alias("id"), F.array(F.lit("main"), F.lit("dev"), F.lit("app/x")).alias("names"))
    return P.remote_refs(book, ["**", "!dev"])


@query(with_("f0", "f1") + " SELECT coalesce(a.checksum, b.checksum) AS checksum, CASE WHEN a.checksum IS NULL THEN 'missing' WHEN a.stray THEN 'stray' WHEN b.checksum IS NOT NULL THEN 'ok' ELSE 'unreachable' END AS finding FROM (SELECT checksum, bool_or(size % 9 = 0) AS stray FROM f0 GROUP BY 1) a FULL OUTER JOIN (SELECT checksum FROM f1 UNION SELECT sha256('lost:' || n_nationkey) FROM nation) b ON a.checksum = b.checksum")
def r15_bucket_fsck(spark, d):
    """A listing of stored keys against what refs reach: unreachable, missing, stray names."""
    f = S.files(spark, d).select("checksum", "size").distinct()
    keys = f.select(F.concat(F.lit("objects/"), F.substring("checksum", 1, 2), F.lit("/"), F.substr("checksum", F.lit(3)), F.when(F.col("size") % 9 == 0, ".tmp").otherwise(".filez")).alias("key"))
    named = keys.select(F.concat(F.regexp_extract("key", "^objects/([0-9a-f]{2})/", 1), F.regexp_extract("key", "/([0-9a-f]{62})[.]", 1)).alias("checksum"), (~F.col("key").rlike("[.](filez|commit|dirtree|dirmeta)$")).alias("stray"))
    wanted = S.files(spark, d, 1).select("checksum").unionByName(table(spark, d, "nation").select(sha("lost:", F.col("n_nationkey")).alias("checksum")))
    return P.reconcile(named.groupBy("checksum").agg(F.bool_or("stray").alias("stray")), wanted)


@query("SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'absent' WHEN doc_id % 13 = 0 THEN 'mismatch' ELSE 'ok' END AS outcome FROM documents")
def r24_image_check(spark, d):
    """Images beside commits: their Merkle digests are computed again and compared with what the commits record. Faults are put into the stored images."""
    docs = table(spark, d, "documents")
    recorded = docs.select("doc_id", codecs.fsverity_digest(F.col("text").cast("binary")).alias("recorded"))
    stored = docs.where("doc_id % 11 <> 0").select("doc_id", F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text")).cast("binary").alias("image"))
    return P.check_images(recorded, stored.select("doc_id", codecs.fsverity_digest("image").alias("digest")), "doc_id")


CHECKOUT = with_("f1", "f2") + """, t AS (SELECT path, checksum FROM f2 WHERE NOT starts_with(path, '/src5/')), o AS (SELECT path, checksum FROM f1 WHERE size % 3 <> 0)
    SELECT m.mode, t.path, CASE WHEN o.path IS NULL THEN 'add' ELSE CASE m.mode WHEN 'none' THEN 'error' WHEN 'union' THEN 'replace' WHEN 'add' THEN 'keep' ELSE CASE WHEN o.checksum = t.checksum THEN 'keep' ELSE 'error' END END END AS action FROM t LEFT JOIN o USING (path), (SELECT unnest(['none', 'union', 'add', 'identical']) AS mode) m"""


@query(CHECKOUT)
def k10_checkout(spark, d):
    """A tree written over another, in every mode, with a filter; what happens to each file."""
    tree = S.files(spark, d, 2).select("path", F.lit("f").alias("kind"), "checksum")
    there = S.files(spark, d, 1).where("size % 3 <> 0").select("path", F.lit("f").alias("kind"), "checksum")
    keep = ~F.startswith("path", F.lit("/src5/"))
    made = [P.checkout(tree, there, mode, keep=keep).select(F.lit(mode).alias("mode"), "path", "action") for mode in P.MODES]
    return made[0].unionByName(made[1]).unionByName(made[2]).unionByName(made[3])


@query(with_("f0") + " SELECT '/opt' || path AS path, size % 10 = 0 AS private FROM f0 WHERE NOT starts_with(path, '/src3/')")
def h01_ingest_hooks(spark, d):
    """Callbacks of an ingest as columns: what is kept, its path, its mode."""
    files = S.files(spark, d).where(~T.below("path", "/src3"))
    mode = F.when(F.col("size") % 10 == 0, 0o600).otherwise(0o644)
    return files.select(F.concat(F.lit("/opt"), "path").alias("path"), (mode == 0o600).alias("private"))


@query(with_("f0") + " SELECT source AS archive, regexp_replace(path, '^/src([0-9]+)/', '/data/\\1/') AS path FROM f0")
def h04_tar_rename(spark, d):
    """A rename hook while archives are read."""
    from ..sources import archives

    docs = table(spark, d, "documents")
    files = docs.select(F.col("source").alias("archive"), S._path().alias("path"), text("doc_id").alias("checksum"), F.lit("x").cast("binary").alias("payload"), F.lit(1700000000).alias("ts"))
    return archives.read_tars(archives.write_tars(files), rename=lambda p: F.regexp_replace(p, "^/src([0-9]+)/", "/data/$1/")).select("archive", "path")


@query(with_("commits", "refs") + " SELECT name, CASE WHEN branch % 4 = 0 THEN 'weak' ELSE 'strong' END AS kind, branch % 4 <> 0 AS root FROM refs")
def h03_weak_ref_classifier(spark, d):
    """A callback says which refs keep what they name."""
    refs = S.refs(spark, d)
    return Hi.roots(refs, weak=F.col("branch") % 4 == 0).select("name", "kind", "root")


# streams and reports


UPDATES = with_("commits", "refs") + """, u AS (SELECT event_id, user_id, event_type, e.ts, c.branch, c.seq, c.checksum FROM events e JOIN commits c ON c.k = 1 + event_id % (SELECT max(k) FROM commits)),
    s AS (SELECT *, lag(seq) OVER w AS before, lag(event_type) OVER w = 'error' AS dropped FROM u WINDOW w AS (PARTITION BY branch ORDER BY event_id))"""  # fmt: skip


def _pushes(spark, d) -> DataFrame:
    """(event_id, space, qualifier, name, old, new, kind): events as pushes of commits to their branch's ref; the value before is what the push before it left."""
    c = S.commits(spark, d)
    last = c.agg(F.max("k")).first()[0] or 1
    u = table(spark, d, "events").select("event_id", F.col("event_type").alias("kind"), (F.col("event_id") % last + 1).alias("k")).join(c.select("k", "branch", "checksum"), "k")
    new = F.when(F.col("kind") != "error", F.col("checksum"))
    w = Window.partitionBy("branch").orderBy("event_id")
    space = F.when(F.col("branch") % 3 == 0, "remote").otherwise("local")
    return u.select("event_id", space.alias("space"), F.when(F.col("branch") % 3 == 0, F.concat(F.lit("r"), text(F.col("branch") % 2))).alias("qualifier"), F.concat(F.lit("cust/"), text("branch")).alias("name"), F.lag(new).over(w).alias("old"), new.alias("new"), "kind", "branch")


RULES = [
    {"pattern": "**", "accept": True, "delete": False, "verify": False, "force": False}, {"pattern": "cust/*", "accept": True, "delete": False, "verify": False, "force": False},
    {"pattern": "r0:cust/*", "accept": True, "delete": True, "verify": False, "force": True}, {"pattern": "*:**", "accept": False, "delete": True, "verify": False, "force": True},
]


@query(UPDATES + """ SELECT event_id, CASE WHEN branch % 3 = 0 AND branch % 2 = 1 THEN 'not accepted' WHEN branch % 3 = 0 THEN CASE WHEN event_type = 'error' THEN 'deleted' WHEN before IS NULL OR dropped THEN 'created' WHEN before = seq THEN 'unchanged' ELSE 'updated' END
    WHEN event_type = 'error' THEN 'delete refused' WHEN before IS NULL OR dropped THEN 'created' WHEN before > seq THEN 'not a fast-forward' WHEN before = seq THEN 'unchanged' ELSE 'updated' END AS outcome FROM s""")  # fmt: skip
def t02_update_policy(spark, d):
    """The rule of each push, by the strongest pattern, and what it makes of it; ancestry is looked up in the commit graph."""
    pushes = cut(R.receive_rule(_pushes(spark, d), [r["pattern"] for r in RULES]))
    judged = Hi.fast_forward(S.commits(spark, d).select("checksum", "parent"), pushes)
    return P.receive(judged.withColumn("verified", F.lit(True)), RULES).select("event_id", "outcome")


@query(UPDATES + " SELECT event_id, CASE WHEN branch % 3 = 0 AND branch % 2 = 1 THEN 'not accepted' WHEN branch % 3 <> 0 AND event_type = 'error' THEN 'delete refused' WHEN branch % 3 <> 0 AND before > seq AND NOT dropped THEN 'not a fast-forward' WHEN event_id % 17 = 0 THEN 'hook 0' WHEN branch % 3 <> 0 AND branch % 19 = 0 THEN 'hook 1' ELSE 'done' END AS outcome FROM s")
def h05_receive_hooks(spark, d):
    """Hooks that may refuse what the rules accept."""
    pushes = cut(R.receive_rule(_pushes(spark, d), [r["pattern"] for r in RULES]))
    judged = Hi.fast_forward(S.commits(spark, d).select("checksum", "parent"), pushes)
    hooks = [lambda: F.col("event_id") % 17 == 0, lambda: (F.col("space") == "local") & (F.substring_index("name", "/", -1).cast("int") % 19 == 0)]
    made = P.receive(judged.withColumn("verified", F.lit(True)), RULES, hooks)
    return made.select("event_id", F.when(F.col("outcome").isin("deleted", "created", "unchanged", "updated"), "done").otherwise(F.col("outcome")).alias("outcome"))


@query(with_("commits", "refs") + " SELECT name, CASE WHEN c.k % 6 = 0 THEN 'server commit' WHEN c.k % 9 = 0 THEN 'no valid signature' ELSE 'taken' END AS outcome FROM refs r JOIN commits c USING (checksum)")
def r22_receive_policy(spark, d):
    """Pushed tips: some are wrapped in a commit that the server makes, some must be signed and aren't, the others are taken as they come."""
    tips = S.refs(spark, d).join(S.commits(spark, d).select("checksum", "k"), "checksum")
    rows = tips.select("name", "k", F.lit("local").alias("space"), F.lit(None).cast("string").alias("qualifier"), F.lit(None).cast("string").alias("old"), F.col("checksum").alias("new"), F.lit(False).alias("fast_forward"), (F.col("k") % 9 != 0).alias("verified"), (F.col("k") % 6 == 0).alias("raw"))
    ruled = R.receive_rule(rows, ["cust/**"])
    made = P.receive(ruled.withColumn("verified", F.col("verified") | F.col("raw")), [{"accept": True, "delete": False, "verify": True, "force": False}])
    return P.finish_updates(made, F.col("raw")).select("name", F.when(F.col("outcome") == "created", "taken").otherwise(F.col("outcome")).alias("outcome"))


@query(with_("commits", "content") + ", m AS (SELECT DISTINCT k FROM content WHERE size % 7 = 0) SELECT c.checksum, m.k IS NOT NULL AS still_partial FROM commits c LEFT JOIN m USING (k) WHERE c.k % 11 = 0")
def t04_resume(spark, d):
    """Markers of commits that a first run left partial; a second run brings objects, and a marker goes when none of its commit's is missing."""
    c, o = S.commits(spark, d), S.content(spark, d)
    arrived = o.where("size % 7 <> 0").select("checksum").distinct()
    return Hi.complete(S.partial_commits(spark, d), c.select("checksum", "k"), o.select("k", F.col("checksum").alias("object")), arrived)


@query(with_("updates") + ", a AS (SELECT *, max(epoch(ts)) OVER () AS now FROM updates) SELECT ref, count(*) FILTER (WHERE now - epoch(ts) > 86400 * 10) AS expired, count(*) FILTER (WHERE now - epoch(ts) <= 86400 * 10) AS kept FROM a GROUP BY ref")
def t06_expiry(spark, d):
    """What is older than ten days at the newest event's time expires."""
    u = S.updates(spark, d)
    # seconds with their fraction, of the plain clock time whatever the session's zone
    at = F.expr("cast(cast(cast(ts as timestamp_ntz) - timestamp_ntz'1970-01-01 00:00:00' as interval second) as decimal(18, 6))").cast("double")
    now = u.agg(F.max(at)).first()[0] or 0.0
    old = Hi.expired(at, F.lit(now), 86400 * 10)
    return u.groupBy("ref").agg(F.count_if(old).alias("expired"), F.count_if(~old).alias("kept"))


@query(with_("updates") + ", n AS (SELECT ref, event_id, checksum, kind, row_number() OVER (PARTITION BY ref ORDER BY event_id DESC) AS r, count(*) OVER (PARTITION BY ref) AS updates FROM updates) SELECT ref, CASE WHEN kind <> 'error' THEN checksum END AS tip, updates FROM n WHERE r = 1")
def t01_ref_stream(spark, d):
    """The stream's own rule, as one batch: the last update of each ref stands, a delete leaves none."""
    u = S.updates(spark, d)
    last = F.max_by(F.struct(F.when(F.col("kind") != "error", F.col("checksum")).alias("tip")), "event_id")
    return u.groupBy("ref").agg(last["tip"].alias("tip"), F.count("*").alias("updates"))


@query(with_("content", "commits") + ", n AS (SELECT DISTINCT branch % 10 AS remote, k, content.checksum, size FROM content JOIN commits USING (k)) SELECT remote, count(DISTINCT k) AS commits, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM n GROUP BY remote")
def a05_pull_stats(spark, d):
    """Counters of pulls, added over remotes."""
    o = S.content(spark, d).select("k", "checksum", "size").distinct()
    pulls = o.groupBy("k").agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))
    by = pulls.join(S.commits(spark, d).select("k", "branch"), "k")
    return by.groupBy((F.col("branch") % 10).alias("remote")).agg(F.count("*").alias("commits"), F.sum("objects").alias("objects"), F.sum("bytes").alias("bytes"))


@query(with_("updates") + " SELECT event_id, ref, count(*) OVER w AS done, CAST(count(*) FILTER (WHERE kind = 'error') OVER w AS BIGINT) AS failed FROM updates WINDOW w AS (PARTITION BY ref ORDER BY event_id)")
def h08_progress(spark, d):
    """Running counters of each transfer, as a progress callback sees them."""
    w = Window.partitionBy("ref").orderBy("event_id")
    return S.updates(spark, d).select("event_id", "ref", F.count("*").over(w).alias("done"), F.count_if(F.col("kind") == "error").over(w).alias("failed"))


@query(with_("commits", "refs") + " SELECT coalesce(c.checksum, r.checksum) AS checksum, r.name AS bound_to, c.checksum IS NULL AS dangling, r.checksum IS NULL AS unnamed FROM (SELECT * FROM commits WHERE k % 6 <> 0) c FULL OUTER JOIN refs r ON r.checksum = c.checksum")
def j11_bindings(spark, d):
    """Both ways: commits that no ref names, refs whose commit isn't there."""
    tips = S.refs(spark, d).select("checksum", F.col("name").alias("bound_to"))
    stored = S.commits(spark, d).where("k % 6 <> 0").select("checksum", F.lit(True).alias("there"))
    both = stored.join(tips, "checksum", "full_outer")
    return both.select("checksum", "bound_to", F.col("there").isNull().alias("dangling"), F.col("bound_to").isNull().alias("unnamed"))


@query("SELECT k, n AS pos, text, total FROM (SELECT conv_id AS k, text, row_number() OVER (PARTITION BY conv_id ORDER BY text, turn) AS n, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations) WHERE n <= 2")
def o03_capped_lists(spark, d):
    """The first two of each list, in byte order, and how many there are."""
    c = table(spark, d, "conversations")
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("text", "turn"))
    return c.select(F.col("conv_id").alias("k"), n.cast("long").alias("pos"), "text", F.count("*").over(Window.partitionBy("conv_id")).alias("total")).where("pos <= 2")


@query("SELECT s_suppkey AS k, CASE s_suppkey % 5 WHEN 0 THEN 'main' WHEN 1 THEN 'a' WHEN 3 THEN 'main' WHEN 4 THEN NULL END AS src, CASE s_suppkey % 5 WHEN 0 THEN 'main' WHEN 1 THEN 'b/' || s_suppkey WHEN 2 THEN 'gone' WHEN 3 THEN 'x' END AS dst, CASE WHEN s_suppkey % 5 IN (2, 3) THEN 'org.c' || s_nationkey END AS id, s_suppkey % 5 <> 4 AS valid FROM supplier")
def r20_refspec(spark, d):
    """`SRC`, `SRC:DST`, `:DST` (delete) and forms whose destination is a collection's, `@ID:DST`."""
    k, c = F.col("s_suppkey"), F.concat(F.lit("@org.c"), text("s_nationkey"), F.lit(":"))
    spec = F.when(k % 5 == 0, "main").when(k % 5 == 1, F.concat(F.lit("a:b/"), text("s_suppkey"))).when(k % 5 == 2, F.concat(F.lit(":"), c, F.lit("gone"))).when(k % 5 == 3, F.concat(F.lit("main:"), c, F.lit("x"))).otherwise("a:")
    src, dst, collection, valid = R.refspec(spec)
    return table(spark, d, "supplier").select(k.alias("k"), src.alias("src"), dst.alias("dst"), collection.alias("id"), valid.alias("valid"))


@query(with_("commits", "refs") + " SELECT name, CASE WHEN NOT regexp_matches(name, '^cust/[0-9]/') THEN 'namespace' WHEN c.k % 7 = 0 THEN 'binding' ELSE 'ok' END AS reason FROM refs r JOIN commits c USING (checksum)")
def r21_push_checks(spark, d):
    """Refs of a push: their namespace, and whether their tips' metadata names them."""
    tips = S.commits(spark, d).select("checksum", F.when(F.col("k") % 7 == 0, F.array(F.lit("else"))).otherwise(F.array(F.concat(F.lit("b/"), text("branch")))).alias("bound"))
    refs = S.refs(spark, d).join(tips, "checksum").withColumn("named", F.concat(F.lit("b/"), text("branch")))
    return refs.select("name", F.when(~R.matches(F.col("name"), "cust/*/*") | ~F.col("name").rlike("^cust/[0-9]/"), "namespace").when(~F.array_contains("bound", F.col("named")), "binding").otherwise("ok").alias("reason"))
