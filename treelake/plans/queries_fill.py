"""Registered queries of scalars, listings, merges and plans in their whole form."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..operators import deltas as D
from ..operators import fsck
from ..operators import history as Hi
from ..operators import refs as R
from ..operators import repo as P
from ..operators import trees as T
from ..sources import derived as S
from ..sources.derived import table, with_
from .queries import META, query
from .queries_ops import sha, text

# scalars


@query(with_("commits") + " SELECT checksum, base64(unhex(checksum)) AS std, replace(replace(base64(unhex(checksum)), '/', '_'), '=', '') AS modified, CASE WHEN k % 3 = 0 THEN NULL ELSE checksum END AS decoded FROM commits")
def c02_modified_base64(spark, d):
    """Encoded, and decoded where the text is the only form of its bytes: another last digit is refused."""
    c = S.commits(spark, d)
    std = F.base64(F.unhex("checksum"))
    given = F.when(F.col("k") % 3 == 0, F.concat(F.substring(std, 1, 42), F.translate(F.substring(std, 43, 1), "AEIMQUYcgkosw048", "BFJNRVZdhlptx159"), F.lit("="))).otherwise(std)
    return c.select("checksum", std.alias("std"), H.modified_base64(F.col("checksum")).alias("modified"), F.lower(F.hex(H.strict_base64(given))).alias("decoded"))


@query("""SELECT n, CASE WHEN n < 128 THEN printf('%02X', n) WHEN n < 16384 THEN printf('%02X', 128 + (n & 127)) || printf('%02X', n >> 7) WHEN n < 2097152 THEN printf('%02X', 128 + (n & 127)) || printf('%02X', 128 + ((n >> 7) & 127)) || printf('%02X', n >> 14)
    ELSE printf('%02X', 128 + (n & 127)) || printf('%02X', 128 + ((n >> 7) & 127)) || printf('%02X', 128 + ((n >> 14) & 127)) || printf('%02X', n >> 21) END AS leb, n AS back, CAST(NULL AS BIGINT) AS padded FROM (SELECT DISTINCT l_orderkey * 7 AS n FROM lineitem)""")  # fmt: skip
def c03_varint(spark, d):
    """Written and read; a form that ends in a zero group isn't the shortest and is refused."""
    n = table(spark, d, "lineitem").select((F.col("l_orderkey") * 7).alias("n")).distinct().withColumn("leb", H.varint(F.col("n")))
    longer = F.concat(F.lpad(F.hex(F.col("n") % 128 + 128), 2, "0"), F.lit("00"))
    return n.select("n", "leb", D.read_varint_hex(F.col("leb")).alias("back"), D.read_varint_hex(longer).alias("padded"))


@query(with_("content") + """, e AS (SELECT DISTINCT k, checksum, size FROM content), v AS (SELECT *, CASE WHEN size < 128 THEN printf('%02X', size) ELSE printf('%02X', 128 + (size & 127)) || printf('%02X', size >> 7) END AS leb FROM e)
    SELECT k, string_agg(upper(checksum) || leb || leb || CASE WHEN size % 4 = 0 THEN '02' ELSE '01' END, '' ORDER BY checksum) AS packed, CAST(sum(size) AS BIGINT) AS bytes FROM v GROUP BY k""")  # fmt: skip
def c04_size_entries(spark, d):
    """Each commit's size entries, sorted by checksum, packed and unpacked."""
    c = S.content(spark, d).select("k", "checksum", "size").distinct()
    packed = c.select("k", H.size_entry(F.col("checksum"), F.col("size"), F.col("size"), F.when(F.col("size") % 4 == 0, 2).otherwise(1)).alias("entry"))
    lists = packed.groupBy("k").agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    read = F.aggregate("entries", F.lit(0).cast("long"), lambda a, e: a + D.read_varint_hex(F.substr(e, F.lit(65))))
    return lists.select("k", F.array_join("entries", "").alias("packed"), read.alias("bytes"))


@query("SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN 'local' WHEN 1 THEN 'remote' ELSE 'collection' END AS space, CASE s_suppkey % 4 WHEN 1 THEN 'r' || s_nationkey WHEN 2 THEN 'org.own' WHEN 3 THEN 'org.x' END AS qualifier, 'main/' || s_suppkey AS name, CASE s_suppkey % 4 WHEN 1 THEN 'r' || s_nationkey || ':' WHEN 3 THEN '(org.x, ' ELSE '' END || 'main/' || s_suppkey || CASE s_suppkey % 4 WHEN 3 THEN ')' ELSE '' END AS ref FROM supplier")
def c11_canonical_ref(spark, d):
    """Refs, parsed, and written in one spelling."""
    k = F.col("s_suppkey")
    name = F.concat(F.lit("main/"), text("s_suppkey"))
    given = F.when(k % 4 == 0, name).when(k % 4 == 1, F.concat(F.lit("r"), text("s_nationkey"), F.lit(":"), name)).when(k % 4 == 2, F.concat(F.lit("(org.own, "), name, F.lit(")"))).otherwise(F.concat(F.lit("(org.x, "), name, F.lit(")")))
    space, qualifier, plain = R.parse_ref(given)
    rows = table(spark, d, "supplier").select(k.alias("k"), space.alias("space"), qualifier.alias("qualifier"), plain.alias("name"))
    return rows.withColumn("ref", R.canonical_ref(F.col("space"), F.col("qualifier"), F.col("name"), "org.own"))


NAMES = "['a/b', 'a..b', 'a.', '0ab', 'té', 'o.:main', 'é:main', '_o:main', 'a//b', '/a', 'a/', 'a:b:c', '-a', '.a', '~a', '+a', 'a+b', 'o r:main', 'a/b:x', 'a b', '²', '€', 'a/.b', '']"
VALID = "['a/b', 'a..b', 'a.', '0ab', 'té', 'o.:main', 'é:main', '_o:main', '²']"


@query(f"SELECT page_id, n AS name, list_contains({VALID}, n) AS valid FROM (SELECT page_id, unnest({NAMES}) AS n FROM pages) UNION ALL SELECT page_id, 'p/' || page_id, true FROM pages UNION ALL SELECT page_id, url, false FROM pages")
def f04_ref_name(spark, d):
    """Names of every kind beside pages' numbers and addresses."""
    p = table(spark, d, "pages")
    given = F.array(*[F.lit(n.strip("'")) for n in NAMES[1:-1].split(", ")], F.concat(F.lit("p/"), text("page_id")), F.col("url"))
    return p.select("page_id", F.explode(given).alias("name")).select("page_id", "name", R.valid_ref(F.col("name")).alias("valid"))


@query(with_("commits", "refs") + """, h AS (SELECT substr(checksum, 1, 4) AS head, count(DISTINCT checksum) AS n, min(checksum) AS c FROM commits GROUP BY 1),
    one AS (SELECT r.checksum AS tip, name FROM refs r), a AS (SELECT name AS asked, tip AS c, 0 AS up, 1 AS n FROM one UNION ALL SELECT name || '^', tip, 1, 1 FROM one UNION ALL SELECT checksum, checksum, 0, 1 FROM commits UNION ALL SELECT checksum || '^^', checksum, 2, 1 FROM commits
    UNION ALL SELECT head, c, 0, n FROM h UNION ALL SELECT 'gone/' || name, NULL, 0, 1 FROM one), p AS (SELECT a.*, c0.parent AS p1, c1.parent AS p2 FROM a LEFT JOIN commits c0 ON c0.checksum = a.c LEFT JOIN commits c1 ON c1.checksum = c0.parent)
    SELECT asked, CASE WHEN n = 1 THEN CASE up WHEN 0 THEN c WHEN 1 THEN p1 ELSE p2 END END AS checksum, CASE WHEN n > 1 THEN 'ambiguous' WHEN c IS NULL THEN 'no such revision' WHEN up > 0 AND CASE up WHEN 1 THEN p1 ELSE p2 END IS NULL THEN 'no parent' ELSE 'found' END AS outcome FROM p""")  # fmt: skip
def f07_resolve_prefix(spark, d):
    """Full checksums, beginnings, refs and names of nothing, some with parents asked for."""
    c, r = S.commits(spark, d), S.refs(spark, d)
    asked = [r.select("name"), r.select(F.concat("name", F.lit("^"))), c.select("checksum"), c.select(F.concat("checksum", F.lit("^^"))), c.select(F.substring("checksum", 1, 4)).distinct(), r.select(F.concat(F.lit("gone/"), "name"))]
    return R.resolve_revisions(reduce(DataFrame.union, [a.toDF("asked") for a in asked]), c, r, Hi.jumps(c))


@query("""WITH c AS (SELECT event_id AS client, event_id % 3 = 0 AS tls, CASE WHEN event_id % 5 = 0 THEN 't1' ELSE 't0' END AS token, 'u' || user_id % 4 AS u, 10 * 16777216 + (user_id % 7) * 65536 + (event_id % 250) AS n FROM events)
    SELECT client, 'all' AS item FROM c UNION ALL SELECT client, 'certificate' FROM c WHERE tls UNION ALL SELECT client, 'secret' FROM c WHERE token = 't1' UNION ALL SELECT client, 'person' FROM c WHERE u = 'u2'
    UNION ALL SELECT client, 'shell' FROM c WHERE client % 11 = 0 UNION ALL SELECT client, 'wide' FROM c UNION ALL SELECT client, 'mid' FROM c WHERE n >> 16 = (10 * 16777216 + 3 * 65536) >> 16 UNION ALL SELECT client, 'near' FROM c WHERE n >> 7 = (10 * 16777216 + 3 * 65536) >> 7""")  # fmt: skip
def f12_cidr(spark, d):
    """Which items of an access list each client matches, networks among them."""
    k = F.col("event_id")
    ip = F.concat(F.lit("10."), text(F.col("user_id") % 7), F.lit(".0."), text(k % 250))
    clients = table(spark, d, "events").select(k.alias("client"), (k % 3 == 0).alias("tls"), F.when(k % 5 == 0, "t1").otherwise("t0").alias("token"), F.concat(F.lit("u"), text(F.col("user_id") % 4)).alias("user"), F.when(k % 11 == 0, "k1").alias("key"), ip.alias("ip"))
    items = spark.createDataFrame([("all", "anonymous", None), ("certificate", "tls", None), ("secret", "token", "t1"), ("person", "basic", "u2"), ("shell", "ssh", "k1"), ("wide", "net", "10.0.0.0/8"), ("mid", "net", "10.3.0.0/16"), ("near", "net", "10.3.0.0/25")], "item string, kind string, value string")
    return R.auth_matches(items, clients)


@query(with_("commits", "refs") + """, r AS (SELECT name, split_part(name, '/', 2) AS n, split_part(name, '/', 3) AS b, branch FROM refs)
    SELECT name, CASE WHEN branch % 3 = 0 THEN CASE WHEN branch % 2 = 0 THEN 'r0:cust/**' ELSE '*:cust/*/*' END WHEN n = '7' THEN 'cust/7/*' WHEN b = '21' THEN 'cust/*/21' ELSE 'cust/*/*' END AS pattern FROM r""")  # fmt: skip
def f14_rule_for(spark, d):
    """The strongest pattern for every ref, a third of them remotes' refs: a literal remote wins, then parts from the left, then the longer pattern."""
    patterns = ["**", "cust/*/*", "cust/**", "cust/7/*", "cust/*/21", "*:cust/*/*", "r0:cust/**", "*:**"]
    remote = F.col("branch") % 3 == 0
    refs = S.refs(spark, d).select("name", F.when(remote, "remote").otherwise("local").alias("space"), F.when(remote, F.concat(F.lit("r"), text(F.col("branch") % 2))).alias("qualifier"))
    named = R.receive_rule(refs, patterns)
    return named.select("name", F.element_at(F.array(*map(F.lit, patterns)), F.col("rule") + 1).alias("pattern"))


# names, listings


@query(with_("content", "commits") + """, o AS (SELECT DISTINCT checksum, 'file' AS ext FROM content UNION ALL SELECT checksum, 'commit' FROM commits)
    SELECT m.mode, checksum, substr(checksum, 1, 2) || '/' || substr(checksum, 3) || '.' || ext || CASE WHEN m.mode = 'archive' AND ext = 'file' THEN 'z' ELSE '' END AS path FROM o, (SELECT unnest(['archive', 'bare', 'bare-user']) AS mode) m""")  # fmt: skip
def p09_loose_path(spark, d):
    """Where objects lie, by type and storage mode."""
    objects = S.content(spark, d).select("checksum").distinct().withColumn("otype", F.lit(1)).unionByName(S.commits(spark, d).select("checksum").withColumn("otype", F.lit(4)))
    modes = F.explode(F.array(*map(F.lit, ("archive", "bare", "bare-user"))))
    return objects.withColumn("mode", modes).select("mode", "checksum", P.loose_path(F.col("checksum"), F.col("otype"), F.col("mode")).alias("path"))


@query(with_("commits") + """, n AS (SELECT *, replace(replace(base64(unhex(checksum)), '/', '_'), '=', '') AS b, replace(replace(base64(unhex(parent)), '/', '_'), '=', '') AS a FROM commits)
    SELECT checksum, b AS short, coalesce(parent || '-', '') || checksum AS name, 'deltas/' || CASE WHEN parent IS NULL THEN substr(b, 1, 2) || '/' || substr(b, 3) ELSE substr(a, 1, 2) || '/' || substr(a, 3) || '-' || b END AS path FROM n""")  # fmt: skip
def p10_delta_name(spark, d):
    """Names and fan-out paths, also of deltas from nothing."""
    short = H.modified_base64(F.col("checksum"))
    c = S.commits(spark, d)
    return c.select("checksum", short.alias("short"), F.concat_ws("-", "parent", "checksum").alias("name"), P.delta_path(F.col("parent"), F.col("checksum")).alias("path"))


@query(with_("f0") + f""" SELECT '-00644 0 0 ' || size || ' ' || checksum || ' ' || path AS line FROM f0 UNION ALL SELECT 'l00777 0 0 0 ' || sha256('link:' || path) || ' ' || path || '.lnk -> ' || regexp_extract(path, '[^/]*$') FROM f0 WHERE size % 5 = 0
    UNION ALL SELECT DISTINCT 'd00755 0 0 0 {META} /' || source || '/' || lang FROM f0 UNION ALL SELECT DISTINCT 'd00755 0 0 0 {META} /' || source FROM f0""")  # fmt: skip
def p05_ls(spark, d):
    """Files, links and directories, with checksums and where links lead; modes and owners come from rows."""
    files = S.files(spark, d)
    zero, none = F.lit(0), F.lit(None).cast("string")
    regular = files.select(F.lit("-").alias("kind"), F.lit(H.FILE_MODE & 0o7777).alias("mode"), "size", "path", "checksum", none.alias("target"))
    links = files.where("size % 5 = 0").select(F.lit("l").alias("kind"), F.lit(0o777).alias("mode"), F.lit(0).cast("long").alias("size"), F.concat("path", F.lit(".lnk")).alias("path"), sha("link:", F.col("path")).alias("checksum"), T.base(F.col("path")).alias("target"))
    dirs = T.directories(files).where("path <> ''").select(F.lit("d").alias("kind"), F.lit(H.DIR_MODE & 0o7777).alias("mode"), F.lit(0).cast("long").alias("size"), "path", H.dirmeta_checksum().alias("checksum"), none.alias("target"))
    rows = regular.unionByName(links).unionByName(dirs)
    return rows.select(P.ls_line(F.col("kind"), F.col("mode"), zero, zero, F.col("size"), F.col("path"), F.col("checksum"), F.col("target")).alias("line"))


@query(with_("f0") + """, e AS (SELECT path, size, '100644' AS mode, 1 AS nlink, CASE WHEN size = 0 THEN '-' ELSE substr(checksum, 1, 2) || '/' || substr(checksum, 3) || '.file' END AS payload FROM f0 UNION ALL SELECT '/' || source || '/' || lang, 0, '40755', 2, '-' FROM f0 GROUP BY source, lang
    UNION ALL SELECT '/' || source, 0, '40755', 2 + count(DISTINCT lang), '-' FROM f0 GROUP BY source UNION ALL SELECT '/', 0, '40755', 2 + count(DISTINCT source), '-' FROM f0)
    SELECT path, CAST(size AS BIGINT) AS size, mode, CAST(nlink AS BIGINT) AS nlink, 0 AS uid, 0 AS gid, 0 AS rdev, '0.0' AS mtime, payload, '-' AS content, '-' AS digest FROM e""")  # fmt: skip
def k13_dump_listing(spark, d):
    return P.dump(S.files(spark, d).withColumn("mode", F.lit(H.FILE_MODE)).withColumn("digest", F.lit(None).cast("string")), digests=False)


@query(with_("commits", "refs") + """, p AS (SELECT * FROM (VALUES (0, 'cust/9'), (1, 'cust/1'), (2, 'cust')) p(pos, prefix)), h AS (SELECT pos, name, CASE WHEN name = prefix THEN name ELSE substr(name, length(prefix) + 2) END AS below FROM refs JOIN p ON name = prefix OR starts_with(name, prefix || '/'))
    SELECT row_number() OVER (ORDER BY pos, name) AS row, pos, name, below FROM h""")  # fmt: skip
def o04_prefix_groups(spark, d):
    """Refs below each prefix in the order of the prefixes, then of the names, with the part below."""
    return R.prefix_groups(S.refs(spark, d).select("name"), ["cust/9", "cust/1", "cust"])


# objects and transactions


@query(with_("f0", "f1") + """, o AS (SELECT checksum, size, count(*) AS offered FROM f0 GROUP BY 1, 2 UNION ALL SELECT '446a0ef11b7cc167f3b603e585c7eeeeb675faa412d5ec73f62988eb0b6c5488', 12, 3) SELECT CASE WHEN checksum LIKE '446a0ef11b%' THEN 3 ELSE 1 END AS otype, checksum, size, offered, checksum NOT IN (SELECT checksum FROM f1) AS written FROM o""")
def k01_content_checksum(spark, d):
    """Files and directory metadata offered for writing: hashed, each object once, and which of them the store lacks."""
    files = S.files(spark, d).select(F.lit(1).alias("otype"), "checksum", "size")
    metas = spark.range(3).select(F.lit(3).alias("otype"), H.dirmeta_checksum().alias("checksum"), F.lit(12).cast("long").alias("size"))
    return P.stage(files.unionByName(metas), S.files(spark, d, 1).select(F.lit(1).alias("otype"), "checksum"))


@query(with_("content") + """, new AS (SELECT DISTINCT checksum, size FROM content WHERE k % 2 = 0), old AS (SELECT DISTINCT checksum FROM content WHERE k % 2 = 1)
    SELECT (SELECT count(*) FROM content WHERE k % 2 = 0) AS offered, count(*) AS objects, count(*) FILTER (WHERE checksum NOT IN (SELECT checksum FROM old)) AS written,
    CAST(coalesce(sum(size) FILTER (WHERE checksum NOT IN (SELECT checksum FROM old)), 0) AS BIGINT) AS bytes FROM new""")  # fmt: skip
def a04_tx_stats(spark, d):
    c = S.content(spark, d).withColumn("otype", F.lit(1))
    none = S.refs(spark, d).select("name", "checksum")
    return P.publish(P.stage(c.where("k % 2 = 0"), c.where("k % 2 = 1")), none, none.limit(0))[0]


@query(with_("commits", "refs") + " SELECT name, CASE WHEN branch % 4 = 1 THEN sha256('new:' || branch) ELSE checksum END AS checksum FROM refs WHERE branch % 4 <> 2 UNION ALL SELECT 'fresh/' || branch, checksum FROM refs WHERE branch % 9 = 0")
def k09_transaction(spark, d):
    """Refs when a transaction has ended: set, dropped, made."""
    r = S.refs(spark, d)
    ups = r.where("branch % 4 in (1, 2)").select("name", F.when(F.col("branch") % 4 == 1, sha("new:", F.col("branch"))).alias("checksum"))
    fresh = r.where("branch % 9 = 0").select(F.concat(F.lit("fresh/"), text("branch")).alias("name"), "checksum")
    staged = P.stage(S.content(spark, d).withColumn("otype", F.lit(1)), S.content(spark, d).withColumn("otype", F.lit(1)).limit(0))
    return P.publish(staged, r.select("name", "checksum"), ups.unionByName(fresh))[1]


# merges and edits


@query(with_("f1", "f2") + """, l AS (SELECT path, 'f' AS kind, checksum FROM f1 UNION ALL SELECT DISTINCT '/' || source, 'd', NULL FROM f1), r AS (SELECT path, 'f' AS kind, checksum FROM f2 WHERE NOT starts_with(path, '/src3/') UNION ALL SELECT DISTINCT '/' || source, 'd', NULL FROM f2 WHERE source <> 'src3' UNION ALL SELECT '/src3', 'f', 'x'),
    m AS (SELECT coalesce(l.path, r.path) AS path, l.kind AS lk, r.kind AS rk, l.checksum AS lc, r.checksum AS rc FROM l FULL OUTER JOIN r ON l.path = r.path), c AS (SELECT *, lk IS NOT NULL AND rk IS NOT NULL AND NOT (lk = 'd' AND rk = 'd') AND (lk <> rk OR lc <> rc) AS clash FROM m)
    SELECT 'stop' AS mode, path, coalesce(lk, rk) AS kind, CASE WHEN lk IS NOT NULL THEN lc ELSE rc END AS checksum, clash AS conflict FROM c UNION ALL SELECT 'right', path, coalesce(rk, lk), CASE WHEN rk IS NOT NULL THEN rc ELSE lc END, false FROM c WHERE NOT (rk IS NULL AND starts_with(path, '/src3/'))""")  # fmt: skip
def j09_tree_merge(spark, d):
    """Two trees with directories, one of which is a file on the right: clashes marked, or won by the right, which then buries what was below."""
    top = lambda f: T.directories(f).where(T.depth(F.col("path")) == 1).select("path", F.lit("d").alias("kind"), F.lit(None).cast("string").alias("checksum"))
    a, b = S.files(spark, d, 1), S.files(spark, d, 2).where(~T.below("path", "/src3"))
    rows = lambda f: f.select("path", F.lit("f").alias("kind"), "checksum").unionByName(top(f.select("path")))
    left, right = rows(a), rows(b).unionByName(spark.range(1).select(F.lit("/src3").alias("path"), F.lit("f").alias("kind"), F.lit("x").alias("checksum")))
    out = [T.merge(left, right, right_wins=w).select(F.lit(m).alias("mode"), "path", "kind", "checksum", "conflict") for m, w in (("stop", False), ("right", True))]
    return out[0].unionByName(out[1])


STEPS = [
    ("mkdir", "/new", None), ("mkdir", "/new", None), ("mkdir", "/x/y", None), ("mkdirs", "/x/y/z", None), ("write", "/x/f", "aa"), ("write", "/none/f", "bb"), ("symlink", "/x/l", "f"), ("link", "/x/h", "/x/f"), ("link", "/x/i", "/gone"),
    ("write", "/x/y", "cc"), ("remove", "/src1", None), ("remove", "/gone", None), ("clear", "/src4", None), ("rename", "/src2", "/moved"), ("rename", "/src3", "/a/b"), ("rename", "/x/h", "/x/f"),
]
OUTCOMES = ["done", "there already", "no parent", "done", "done", "no parent", "done", "done", "no such path", "a directory", "done", "no such path", "done", "done", "no parent", "there already"]


@query(with_("f0") + """, t AS (SELECT path, 'f' AS kind, checksum FROM f0 UNION ALL SELECT DISTINCT '/' || source, 'd', NULL FROM f0 UNION ALL SELECT DISTINCT '/' || source || '/' || lang, 'd', NULL FROM f0)
    SELECT CASE WHEN path = '/src2' THEN '/moved' WHEN starts_with(path, '/src2/') THEN '/moved/' || substr(path, 7) ELSE path END AS path, kind, checksum FROM t WHERE path <> '/src1' AND NOT starts_with(path, '/src1/') AND NOT starts_with(path, '/src4/')
    UNION ALL SELECT * FROM (VALUES ('/new', 'd', NULL), ('/x', 'd', NULL), ('/x/y', 'd', NULL), ('/x/y/z', 'd', NULL), ('/x/f', 'f', 'aa'), ('/x/l', 'l', 'f'), ('/x/h', 'f', 'aa')) v""")  # fmt: skip
def r01_staging_edits(spark, d):
    """All kinds of edits in one order; those that fail change nothing."""
    return T.edit(_tree(spark, d), STEPS)[0]


def _tree(spark, d) -> DataFrame:
    files = S.files(spark, d).select("path", F.lit("f").alias("kind"), "checksum")
    return files.unionByName(T.directories(files).where("path <> ''").select("path", F.lit("d").alias("kind"), F.lit(None).cast("string").alias("checksum")))


@query("SELECT unnest(range(1, 17)) AS pos, unnest(" + str([s[0] for s in STEPS]) + ") AS op, unnest(" + str(OUTCOMES) + ") AS outcome")
def r04_edit_outcomes(spark, d):
    """What each edit came to."""
    outcomes = T.edit(_tree(spark, d), STEPS)[1]
    return spark.createDataFrame([(i + 1, s[0], o) for i, (s, o) in enumerate(zip(STEPS, outcomes, strict=True))], "pos long, op string, outcome string")


@query(with_("f0") + f", p AS (SELECT DISTINCT '/' || source AS path FROM f0 UNION SELECT '') SELECT path, CASE WHEN path = '/src1' THEN 'own' ELSE '{META}' END AS meta, CASE WHEN path = '/src1' THEN 'own' WHEN path = '' THEN NULL ELSE '{META}' END AS required FROM p")
def r03_implied_metadata(spark, d):
    """Directories that files imply get the usual metadata; the root's may be required of the caller."""
    own = spark.range(1).select(F.lit("/src1").alias("path"), F.lit("own").alias("own"))
    dirs = T.directories(S.files(spark, d)).where((T.depth(F.col("path")) == 1) | (F.col("path") == ""))
    return T.with_metadata(dirs, own).join(T.with_metadata(dirs, own, root="required").withColumnRenamed("meta", "required"), "path")


# plans


@query(with_("f1", "f2") + """, n AS (SELECT DISTINCT 1 AS otype, checksum, 18 AS header, size FROM f2 UNION ALL SELECT DISTINCT 2, sha256('tree:' || source), 0, 100 FROM f2), o AS (SELECT 1 AS otype, checksum FROM f1 UNION SELECT 2, sha256('tree:' || source) FROM f1 WHERE source <> 'src1')
    SELECT otype, checksum, CAST(size AS BIGINT) AS size, CASE WHEN otype <> 1 THEN 'metadata' WHEN 18 + 7 + size >= 4000 THEN 'fallback' ELSE 'content' END AS travels FROM n WHERE (otype, checksum) NOT IN (SELECT otype, checksum FROM o)""")  # fmt: skip
def j06_delta_objects(spark, d):
    """What a delta carries: metadata and content that the old closure lacks; the header counts towards the size beyond which content travels beside it."""
    tree = lambda f: f.select(F.split("path", "/")[1].alias("source")).distinct().select(F.lit(2).alias("otype"), sha("tree:", F.col("source")).alias("checksum"), F.lit(0).alias("header"), F.lit(100).cast("long").alias("size"), "source")
    rows = lambda v: S.files(spark, d, v).select(F.lit(1).alias("otype"), "checksum", F.lit(18).alias("header"), "size")
    new = rows(2).unionByName(tree(S.files(spark, d, 2)).drop("source"))
    old = rows(1).unionByName(tree(S.files(spark, d, 1)).where("source <> 'src1'").drop("source"))
    return D.select_objects(new, old, 4000)


@query(with_("commits", "content") + """, c AS (SELECT * FROM commits WHERE k % 4 <> 0), w AS (SELECT DISTINCT 1 AS otype, o.checksum FROM content o JOIN c USING (k) UNION SELECT 4, checksum FROM c), l AS (SELECT * FROM w WHERE NOT (otype = 1 AND checksum IN (SELECT checksum FROM content WHERE size % 3 = 0)))
    SELECT otype, checksum, row_number() OVER (ORDER BY otype, checksum) AS pos FROM l""")  # fmt: skip
def j08_pull_plan(spark, d):
    """What to fetch, in order: a quarter of the commits is complete already, a third of the objects is there."""
    c, o = S.commits(spark, d), S.content(spark, d)
    return D.pull_plan(o.select("k", F.lit(1).alias("otype"), "checksum"), c.select("k", "checksum"), c.where("k % 4 = 0").select("checksum"), o.where("size % 3 = 0").select(F.lit(1).alias("otype"), "checksum").distinct())


@query(with_("content") + ", gone AS (SELECT DISTINCT checksum FROM content WHERE k % 3 = 0 AND checksum NOT IN (SELECT checksum FROM content WHERE size % 17 <> 0)) SELECT (SELECT count(*) FROM gone) AS missing, (SELECT string_agg(checksum, ',' ORDER BY checksum) FROM (SELECT checksum FROM gone ORDER BY checksum LIMIT 5)) AS first")
def j18_completeness(spark, d):
    """How much is missing, and the first few."""
    c = S.content(spark, d)
    return P.completeness(c.where("k % 3 = 0"), c.where("size % 17 <> 0"), 5).select("missing", F.array_join("first", ",").alias("first"))


@query("SELECT part, mode, row_number() OVER (PARTITION BY part ORDER BY first) - 1 AS idx FROM (SELECT p_partkey % 16 AS part, p_size AS mode, min(p_partkey) AS first FROM part GROUP BY 1, 2)")
def a14_interning(spark, d):
    """A table of modes for each part, by first appearance."""
    rows = table(spark, d, "part").select((F.col("p_partkey") % 16).alias("part"), F.col("p_partkey").alias("pos"), F.col("p_size").alias("mode"))
    return D.intern(rows, "part", "pos", "mode")


OWN = with_("commits", "refs", "collections") + """, nr AS (SELECT *, CAST(split_part(name, '/', 2) AS INT) AS nation FROM refs), h AS (SELECT 'org.own' AS id, name, checksum, 'local' AS space, '' AS remote FROM nr WHERE nation = 0),
    m AS (SELECT CASE WHEN branch % 5 = 0 THEN 'org.own' ELSE id END AS id, name, checksum, 'mirror', '' FROM nr JOIN collections USING (nation) WHERE nation <> 0 AND branch % 2 = 0),
    r AS (SELECT CASE WHEN s_suppkey % 7 = 0 THEN 'bad id' ELSE id END AS id, 'main' AS name, sha256('tip:' || s_suppkey) AS checksum, 'remote', lower(replace(s_name, '#', '-')) AS remote FROM supplier JOIN collections ON s_nationkey = nation),
    a AS (SELECT * FROM h UNION ALL SELECT * FROM m WHERE id <> 'org.own' UNION ALL SELECT * FROM r WHERE id <> 'bad id'), n AS (SELECT *, row_number() OVER (PARTITION BY id, name ORDER BY space = 'remote', remote) AS rank FROM a)"""  # fmt: skip


@query(OWN + " SELECT id, name, checksum, space FROM n WHERE rank = 1")
def s08_collection_refs(spark, d):
    """Refs of all collections: mirrors under the own id don't count, remotes of broken ids neither, and of several remotes the first by name."""
    ids, refs = S.collections(spark, d), S.refs(spark, d).withColumn("nation", F.split("name", "/")[1].cast("int"))
    mirrors = refs.where("nation <> 0 and branch % 2 = 0").join(ids, "nation").select(F.when(F.col("branch") % 5 == 0, "org.own").otherwise(F.col("id")).alias("id"), "name", "checksum")
    s = table(spark, d, "supplier").join(ids, F.col("s_nationkey") == F.col("nation"))
    remotes = s.select(F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))).alias("remote"), F.when(F.col("s_suppkey") % 7 == 0, "bad id").otherwise(F.col("id")).alias("id"), F.lit("main").alias("name"), sha("tip:", F.col("s_suppkey")).alias("checksum"))
    return R.collection_refs(refs.where("nation = 0").select("name", "checksum"), mirrors, remotes, "org.own")


# trees of objects, integrity, deltas as a whole


def _snapshots(spark, d) -> tuple[DataFrame, DataFrame]:
    """(roots, entries) of three snapshots as directory objects; equal subtrees are one object."""
    roots, entries = [], []
    for v in range(3):
        files = S.files(spark, d, v).select("path", "checksum")
        trees = T.write_tree(files)
        roots.append(trees.where("path = ''").select(F.lit(v).alias("root"), F.col("checksum").alias("dirtree")))
        entries.append(T.tree_entries(files, trees))
    return reduce(DataFrame.unionByName, roots), reduce(DataFrame.unionByName, entries).distinct()


@query(with_("f0", "f1", "f2") + "".join(f" {'UNION ALL ' if v else ''}SELECT {v} AS root, path, 'f' AS kind, checksum AS object FROM f{v} UNION ALL SELECT DISTINCT {v}, '/' || source, 'd', NULL FROM f{v} UNION ALL SELECT DISTINCT {v}, '/' || source || '/' || lang, 'd', NULL FROM f{v}" for v in range(3)))
def j03_tree_walk(spark, d):
    """Paths of three snapshots, by walking their directory objects from the roots."""
    return T.walk(*_snapshots(spark, d)).select("root", "path", "kind", F.when(F.col("kind") == "f", F.col("child")).alias("object"))


@query(with_("f0", "f1", "f2") + "".join(f" {'UNION ALL ' if v else ''}SELECT 'commit{v}' AS commit_, path, checksum AS object FROM f{v} WHERE size % 97 = 0" for v in range(3)))
def j10_fsck_attribution(spark, d):
    """Stored files are hashed again; each damaged one is traced to the commits whose trees hold it, and to its paths there. Faults: a byte more where the size is a multiple of 97."""
    bad = fsck.damaged_files(S.stored_files(spark, d)).select("checksum")
    commits = spark.range(3).select(F.concat(F.lit("commit"), text("id")).alias("checksum"), F.col("id").cast("int").alias("root"))
    return fsck.reached_by(bad, T.walk(*_snapshots(spark, d)), commits).withColumnRenamed("commit", "commit_")


@query(with_("commits", "content") + """, c AS (SELECT 4 AS otype, CASE WHEN k % 97 = 0 THEN 'corrupt' WHEN k % 11 = 0 THEN 'partial' ELSE 'ok' END AS kind FROM commits UNION ALL SELECT 1, CASE WHEN size % 97 = 0 THEN 'corrupt' ELSE 'ok' END FROM (SELECT DISTINCT checksum, size FROM content))
    SELECT otype, kind, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY otype) AS BIGINT) AS checked FROM c GROUP BY 1, 2""")  # fmt: skip
def a03_fsck_report(spark, d):
    """Commits and objects hashed again: how many are damaged, partial, sound, of how many checked."""
    commits = fsck.report(S.stored_commits(spark, d), S.partial_commits(spark, d)).select(F.lit(4).alias("otype"), "kind")
    objects = fsck.report(S.stored_objects(spark, d), S.partial_commits(spark, d).limit(0)).select(F.lit(1).alias("otype"), "kind")
    return fsck.summary(commits.unionByName(objects))


@query(with_("commits") + ", g AS (SELECT *, max(k % 29 = 0) OVER w AS gone, row_number() OVER w - 1 AS depth, lead(k % 29 = 0) OVER w AS next FROM commits WINDOW w AS (PARTITION BY branch ORDER BY seq DESC)) SELECT branch, checksum, depth, coalesce(next, false) AS stop FROM g WHERE NOT gone")
def w01_log(spark, d):
    """Every branch's log; some commits aren't stored, and a log ends before them."""
    c = S.commits(spark, d)
    return Hi.log(c, c.where("k % 29 <> 0"), ["seq"])


@query(with_("commits") + """, e AS (SELECT checksum AS dst, parent || '-' || checksum AS name, sha256('s:' || k) AS digest FROM commits WHERE parent IS NOT NULL UNION ALL SELECT checksum, checksum, sha256('e:' || k) FROM commits WHERE k % 2 = 0)
    SELECT dst AS target, string_agg(name || '=' || digest, ',' ORDER BY name) AS entries FROM e GROUP BY dst""")  # fmt: skip
def k17_reindex_deltas(spark, d):
    """For each target its deltas, from its parent and from nothing, with the digests of their superblocks."""
    c = S.commits(spark, d)
    deltas = c.where("parent is not null").select(F.col("parent").alias("src"), F.col("checksum").alias("dst"), sha("s:", F.col("k")).alias("digest")).unionByName(c.where("k % 2 = 0").select(F.lit(None).cast("string").alias("src"), F.col("checksum").alias("dst"), sha("e:", F.col("k")).alias("digest")))
    return D.reindex(deltas).select(F.col("dst").alias("target"), F.array_join(F.transform("entries", lambda e: F.concat(e["name"], F.lit("="), e["digest"])), ",").alias("entries"))


@query("""WITH RECURSIVE a AS (SELECT source AS delta, sha256(CAST(doc_id AS VARCHAR)) AS checksum, octet_length(encode(substr(text, 1, length(text) // 2) || '<new>' || substr(text, length(text) // 2 + 1) || '!')) AS size FROM documents),
    p AS (SELECT *, row_number() OVER (PARTITION BY delta ORDER BY checksum) AS n FROM a), pack(delta, n, part, held) AS (SELECT delta, n, CAST(0 AS BIGINT), size FROM p WHERE n = 1 UNION ALL
    SELECT p.delta, p.n, pack.part + CASE WHEN held > 0 AND held + size > 20000 THEN 1 ELSE 0 END, CASE WHEN held > 0 AND held + size > 20000 THEN size ELSE held + size END FROM pack JOIN p ON p.delta = pack.delta AND p.n = pack.n + 1)
    SELECT delta, part, count(*) AS objects, true AS rebuilt FROM pack GROUP BY delta, part""")  # fmt: skip
def k16_static_delta(spark, d):
    """Deltas of every source's altered texts: packed, written as opcode streams, and run again against the old texts, each object checked by its hash."""
    docs = table(spark, d, "documents").where("text is not null")
    half = F.floor(F.length("text") / 2).cast("int")
    new = F.concat(F.substr("text", F.lit(1), half), F.lit("<new>"), F.substr("text", half + 1), F.lit("!")).cast("binary")
    objects = docs.select(F.col("source").alias("delta"), F.sha2(text("doc_id").cast("binary"), 256).alias("checksum"), new.alias("payload"), F.when(F.col("doc_id") % 3 != 0, F.col("text").cast("binary")).alias("source"))
    parts = D.build_parts(objects, 20_000)
    wanted = parts.select("delta", "part", "objects", "ops", "blob", F.posexplode("names").alias("pos", "checksum")).join(objects.select("delta", "checksum", F.sha2("payload", 256).alias("sum"), "source"), ["delta", "checksum"])

    def check(pdf):
        pdf = pdf.sort_values("pos")
        old = {hashlib.sha256(s).digest(): bytes(s) for s in pdf["source"] if s}
        made = D.run_opcodes(bytes(pdf["ops"].iloc[0]), bytes(pdf["blob"].iloc[0]), old, [(1, bytes.fromhex(x)) for x in pdf["sum"]], lambda _, b: hashlib.sha256(b).digest())
        return pdf.iloc[:1][["delta", "part", "objects"]].assign(rebuilt=len(made) == len(pdf))

    return wanted.groupBy("delta", "part").applyInPandas(check, "delta string, part long, objects long, rebuilt boolean")
