"""More registered queries: reports, metadata, policies, replication bookkeeping, staging edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..operators import refs as R
from ..operators import trees as T
from ..sources import derived as S
from ..sources.derived import table, with_
from .queries import query

REMOTES = "remotes AS (SELECT s_suppkey AS k, s_name AS name, CASE WHEN s_suppkey % 4 <> 0 THEN 'https://h/' || s_suppkey END AS url, CASE WHEN s_suppkey % 3 = 0 THEN 'ssh://p/' || s_suppkey END AS pull_url FROM supplier)"


def _config(spark, d) -> DataFrame:
    """(k, name, key, value): remotes as keyed settings."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    pairs = F.array(F.struct(F.lit("url").alias("key"), F.when(k % 4 != 0, F.concat(F.lit("https://h/"), k.cast("string"))).alias("value")), F.struct(F.lit("pull-url").alias("key"), F.when(k % 3 == 0, F.concat(F.lit("ssh://p/"), k.cast("string"))).alias("value")))
    return s.select(k.alias("k"), F.col("s_name").alias("name"), F.inline(pairs)).where("value is not null")


def _metadata(spark, d) -> DataFrame:
    """(checksum, metadata): ordered dictionaries, in which a key may repeat and its first entry counts."""
    c = S.commits(spark, d)
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    binding = entry("ref-binding", F.concat(F.lit("cust/"), F.col("branch").cast("string")))
    version = entry("version", F.concat(F.lit("v"), F.col("seq").cast("string")))
    again = entry("version", F.lit("shadowed"))
    return c.select("checksum", "k", "branch", F.when(F.col("k") % 2 == 0, F.array(binding, version, again)).otherwise(F.array(binding)).alias("metadata"))


@query(with_("f0") + ", k AS (SELECT 'objects/' || substr(checksum, 1, 2) || '/' || substr(checksum, 3) || CASE WHEN size % 9 = 0 THEN '.tmp' ELSE '.filez' END AS key FROM (SELECT DISTINCT checksum, size FROM f0)) SELECT key, regexp_matches(key, '^objects/[0-9a-f]{2}/[0-9a-f]{62}[.](filez|commit|dirtree|dirmeta)$') AS object FROM k")
def s24_bucket_listing(spark, d):
    f = S.files(spark, d).select("checksum", "size").distinct()
    key = F.concat(F.lit("objects/"), F.substring("checksum", 1, 2), F.lit("/"), F.substring("checksum", 3, 62), F.when(F.col("size") % 9 == 0, ".tmp").otherwise(".filez"))
    return f.select(key.alias("key"), key.rlike("^objects/[0-9a-f]{2}/[0-9a-f]{62}[.](filez|commit|dirtree|dirmeta)$").alias("object"))


@query(with_("commits") + " SELECT checksum, 'commit ' || substr(checksum, 1, 10) || ' parent ' || coalesce(substr(parent, 1, 10), '(none)') || ' at ' || ts AS report FROM commits")
def p01_show(spark, d):
    report = F.concat(F.lit("commit "), F.substring("checksum", 1, 10), F.lit(" parent "), F.coalesce(F.substring("parent", 1, 10), F.lit("(none)")), F.lit(" at "), F.col("ts").cast("string"))
    return S.commits(spark, d).select("checksum", report.alias("report"))


@query(with_("commits") + " SELECT checksum, CASE WHEN k % 2 = 0 THEN 'ref-binding,version,version' ELSE 'ref-binding' END AS keys, CASE WHEN k % 2 = 0 THEN 'v' || seq END AS version FROM commits")
def p02_metadata_keys(spark, d):
    value = F.try_element_at(F.filter("metadata", lambda e: e["key"] == "version"), F.lit(1))["value"]
    return _metadata(spark, d).select("checksum", F.array_join(F.transform("metadata", lambda e: e["key"]), ",").alias("keys"), value.alias("version"))


@query(with_("commits") + " SELECT checksum, 'cust/' || branch AS bound FROM commits")
def p03_bindings(spark, d):
    first = F.filter("metadata", lambda e: e["key"] == "ref-binding")[0]["value"]
    return _metadata(spark, d).select("checksum", first.alias("bound"))


@query("""WITH r AS (SELECT c_mktsegment AS who, 'cust/' || c_nationkey AS ref, c_custkey % 97 = 0 AS deny, CAST(2 ** (c_custkey % 5) AS INT) AS modes FROM customer WHERE c_custkey % 3 = 0)
    SELECT who, ref FROM r GROUP BY 1, 2 HAVING bool_or(NOT deny AND modes & 23 <> 0) AND NOT bool_or(deny)""")  # fmt: skip
def f11_read_selector(spark, d):
    from .queries import _rules

    rules = _rules(spark, d)
    yes = rules.where("effect = 'allow' and modes & 23 <> 0").select("who", "ref").distinct()
    return yes.join(rules.where("effect = 'deny'").select("who", "ref"), ["who", "ref"], "left_anti")


@query(with_("commits") + ", dep AS (SELECT checksum, branch, 'dep' || k % 3 AS name, k, seq FROM commits) SELECT n.checksum, min(o.k) AS source FROM dep n JOIN dep o ON o.branch = n.branch AND o.name = n.name AND o.seq < n.seq AND o.k % 11 <> 0 GROUP BY n.checksum")
def j15_dependency_pairing(spark, d):
    dep = S.commits(spark, d).withColumn("name", F.concat(F.lit("dep"), (F.col("k") % 3).cast("string")))
    # the first complete one before it: a running minimum, not a join of all pairs
    w = Window.partitionBy("branch", "name").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return dep.withColumn("source", F.min(F.when(F.col("k") % 11 != 0, F.col("k"))).over(w)).where("source is not null").select("checksum", "source")


@query("SELECT key, arg_max(v, pos) AS value, min(pos) AS pos FROM (SELECT c_mktsegment AS key, c_custkey AS pos, c_nationkey AS v FROM customer) GROUP BY key")
def a10_last_value_first_place(spark, d):
    c = table(spark, d, "customer")
    return c.groupBy(F.col("c_mktsegment").alias("key")).agg(F.max_by("c_nationkey", "c_custkey").alias("value"), F.min("c_custkey").alias("pos"))


@query(with_("f1", "f2") + " SELECT checksum, bool_or(v = 1) AS in_old, bool_or(v = 2) AS in_new FROM (SELECT checksum, 1 AS v FROM f1 UNION ALL SELECT checksum, 2 FROM f2) GROUP BY checksum")
def u01_union(spark, d):
    both = S.files(spark, d, 1).select("checksum", F.lit(1).alias("v")).unionByName(S.files(spark, d, 2).select("checksum", F.lit(2).alias("v")))
    return both.groupBy("checksum").agg(F.bool_or(F.col("v") == 1).alias("in_old"), F.bool_or(F.col("v") == 2).alias("in_new"))


@query(with_("f1", "f2") + " SELECT checksum FROM f1 INTERSECT SELECT checksum FROM f2")
def u02_intersect(spark, d):
    return S.files(spark, d, 1).select("checksum").intersect(S.files(spark, d, 2).select("checksum"))


@query(with_("f1", "f2") + " SELECT checksum FROM f1 EXCEPT SELECT checksum FROM f2")
def u03_except(spark, d):
    return S.files(spark, d, 1).select("checksum").distinct().join(S.files(spark, d, 2).select("checksum"), "checksum", "left_anti")


@query("SELECT doc_id, sha256(text) AS hex, CASE WHEN doc_id % 2 = 0 THEN sha256(text) END AS strict FROM documents")
def c01_sha256(spark, d):
    h = F.sha2(F.col("text").cast("binary"), 256)
    spelled = F.when(F.col("doc_id") % 2 == 0, h).otherwise(F.upper(h))
    return table(spark, d, "documents").select("doc_id", h.alias("hex"), F.when(R.checksum_shaped(spelled), spelled).alias("strict"))


@query("SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS seconds FROM events")
def c22_date_parse(spark, d):
    """`@SECONDS` and absolute times with an offset."""
    e = table(spark, d, "events")
    at = F.concat(F.lit("@"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string"))
    iso = F.concat(F.date_format(F.col("ts") + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    text = F.when(F.col("event_id") % 2 == 0, at).otherwise(iso)
    parsed = F.when(F.startswith(text, F.lit("@")), F.substr(text, F.lit(2)).cast("long")).otherwise(F.unix_timestamp(F.to_timestamp(text, "yyyy-MM-dd'T'HH:mm:ssXXX")))
    return e.select("event_id", parsed.alias("seconds"))


@query(with_("updates") + ", stop AS (SELECT ref, min(event_id) AS at FROM updates WHERE kind = 'signup' GROUP BY ref) SELECT u.event_id, u.ref FROM updates u LEFT JOIN stop s USING (ref) WHERE s.at IS NULL OR u.event_id <= s.at")
def t05_stop_at_commit(spark, d):
    """Each ref's stream up to its first stop mark."""
    stop = F.min(F.when(F.col("kind") == "signup", F.col("event_id"))).over(Window.partitionBy("ref"))
    return S.updates(spark, d).withColumn("at", stop).where("at is null or event_id <= at").select("event_id", "ref")


LINKS = [("/l/a", "/l/b"), ("/l/b", "/src1"), ("/loop/x", "/loop/y"), ("/loop/y", "/loop/x"), ("/gone", "/nope")]



@query("SELECT * FROM (VALUES ('/l/a', '/src1', 'found'), ('/l/b', '/src1', 'found'), ('/loop/x', NULL, 'loop'), ('/loop/y', NULL, 'loop'), ('/gone', NULL, 'absent'), ('/src1', '/src1', 'found')) t(path, target, outcome)")
def r02_follow_links(spark, d):
    """Links are followed up to a limit over the link map; who still stands on a link then is in a loop."""
    links = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("at"), F.lit(b).alias("to")) for a, b in LINKS])))
    now = links.select(F.col("at").alias("path"), F.col("at").alias("target")).unionByName(spark.range(1).select(F.lit("/src1").alias("path"), F.lit("/src1").alias("target")))
    for _ in range(8):
        now = now.join(F.broadcast(links), now.target == links.at, "left").select("path", F.coalesce("to", "target").alias("target"))
    dirs = T.directories(S.files(spark, d)).select(F.col("path").alias("target"), F.lit(True).alias("there"))
    out = now.join(F.broadcast(links.select(F.col("at").alias("target"), F.lit(True).alias("loop"))), "target", "left").join(dirs, "target", "left")
    return out.select("path", F.when(F.col("there"), F.col("target")).alias("target"), F.when(F.col("loop"), "loop").when(F.col("there"), "found").otherwise("absent").alias("outcome"))


@query("WITH " + REMOTES + " SELECT k, name, coalesce(CASE WHEN k % 5 = 0 THEN 'file:///o' END, pull_url, url) AS endpoint FROM remotes")
def r12_config_view(spark, d):
    """One row for each remote, the settings as columns with their defaults; an override goes first."""
    wide = _config(spark, d).groupBy("k", "name").pivot("key", ["url", "pull-url"]).agg(F.first("value"))
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return names.join(wide.drop("name"), "k", "left").select("k", "name", F.coalesce(F.when(F.col("k") % 5 == 0, "file:///o"), F.col("pull-url"), F.col("url")).alias("endpoint"))


@query("WITH " + REMOTES + " SELECT k, 'url' AS key, 'new' AS value FROM remotes WHERE k % 2 = 0 UNION ALL SELECT k, 'url', url FROM remotes WHERE k % 2 = 1 AND url IS NOT NULL UNION ALL SELECT k, 'pull-url', pull_url FROM remotes WHERE pull_url IS NOT NULL AND k % 7 <> 0")
def r11_config_edits(spark, d):
    """Set `url` of every second remote, unset `pull-url` of every seventh."""
    now = _config(spark, d).select("k", "key", "value")
    sets = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("k"), F.lit("url").alias("key"), F.lit("new").alias("new"))
    both = now.join(sets, ["k", "key"], "full_outer").select("k", "key", F.coalesce("new", "value").alias("value"))
    return both.where("not (key = 'pull-url' and k % 7 = 0)")


@query(with_("f0") + " SELECT path, sha256(unhex('0000000000000000000081a400000000' || '0011') || encode(text)) AS other FROM f0 JOIN documents d ON f0.path = '/' || d.source || '/' || d.lang || '/d' || lpad(CAST(d.doc_id AS VARCHAR), 8, '0') || '.txt'")
def r26_header_forms(spark, d):
    """The same header without the framing in front, as another layout hashes it."""
    header = H.file_header(F.lit(0), F.lit(0), F.lit(H.FILE_MODE), F.lit(""))
    return table(spark, d, "documents").select(S._path().alias("path"), F.sha2(F.concat(F.unhex(header), F.col("text").cast("binary")), 256).alias("other"))


@query(with_("f0") + " SELECT path, size % 19 <> 0 AS verified FROM f0")
def r27_verifying_read(spark, d):
    """Recomputed against recorded checksums; every nineteenth payload is damaged on the way."""
    docs = table(spark, d, "documents")
    size = F.octet_length("text")
    read = F.when(size % 19 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text"))
    return docs.select(S._path().alias("path"), (H.content_checksum(read) == H.content_checksum(F.col("text"))).alias("verified"))


