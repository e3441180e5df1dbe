"""Registered queries of the tree store, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codecs
from ..functions import hashing as H
from ..operators import deltas as D
from ..operators import history as Hi
from ..operators import refs as R
from ..operators import trees as T
from ..sources import archives
from ..sources import derived as S
from ..sources.derived import table, with_

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def le_sql(n: str, z: str) -> str:
    full = f"lpad(hex(CAST({n} AS BIGINT)), 16, '0')"
    byte = [f"substr({full}, {15 - 2 * i}, 2)" for i in range(8)]
    return f"CASE {z} WHEN 1 THEN {byte[0]} WHEN 2 THEN {byte[0]} || {byte[1]} ELSE {' || '.join(byte[:4])} END"


def width_sql(data: str, n: str) -> str:
    return f"CASE WHEN {data} + {n} <= 255 THEN 1 WHEN {data} + 2 * ({n}) <= 65535 THEN 2 ELSE 4 END"


META = "446a0ef11b7cc167f3b603e585c7eeeeb675faa412d5ec73f62988eb0b6c5488"


def array_sql(name: str, rows: str) -> str:
    """CTE name(dir, hex): the container of the elements (dir, name, el)."""
    return f"""{name}_e AS (SELECT dir, name, el, length(el) // 2 AS n FROM ({rows})),
        {name}_o AS (SELECT *, sum(n) OVER (PARTITION BY dir ORDER BY name) AS e, sum(n) OVER (PARTITION BY dir) AS total, count(*) OVER (PARTITION BY dir) AS c FROM {name}_e),
        {name} AS (SELECT dir, string_agg(el, '' ORDER BY name) || string_agg({le_sql("e", width_sql("total", "c"))}, '' ORDER BY name) AS hex, count(*) AS c FROM {name}_o GROUP BY dir)"""


def level_sql(name: str, array: str, kind: str) -> str:
    """CTE name(path, checksum, files, dirs): directories that hold only files, or only directories."""
    size = "length(hex) // 2"
    end = size if kind == "f" else "0"
    counts = "c AS files, CAST(0 AS BIGINT) AS dirs" if kind == "f" else "CAST(0 AS BIGINT) AS files, c AS dirs"
    return f"{name} AS (SELECT dir AS path, sha256(unhex(hex || {le_sql(end, width_sql(size, '1'))})) AS checksum, {counts} FROM {array})"


def trees_sql(files: str) -> str:
    file_el = f"SELECT '/' || source || '/' || lang AS dir, regexp_extract(path, '[^/]*$') AS name, hex(regexp_extract(path, '[^/]*$')) || '00' || upper(checksum) || printf('%02X', length(regexp_extract(path, '[^/]*$')) + 1) AS el FROM {files}"
    dir_el = lambda src: f"SELECT regexp_replace(path, '/[^/]*$', '') AS dir, regexp_extract(path, '[^/]*$') AS name, hex(regexp_extract(path, '[^/]*$')) || '00' || upper(checksum) || upper('{META}') || printf('%02X', length(regexp_extract(path, '[^/]*$')) + 33) || printf('%02X', length(regexp_extract(path, '[^/]*$')) + 1) AS el FROM {src}"
    return ",\n".join([
        array_sql(f"{files}_a3", file_el), level_sql(f"{files}_t3", f"{files}_a3", "f"), array_sql(f"{files}_a2", dir_el(f"{files}_t3")), level_sql(f"{files}_t2", f"{files}_a2", "d"),
        array_sql(f"{files}_a1", dir_el(f"{files}_t2")), level_sql(f"{files}_t1", f"{files}_a1", "d"), f"{files}_trees AS (SELECT * FROM {files}_t3 UNION ALL SELECT * FROM {files}_t2 UNION ALL SELECT * FROM {files}_t1)",
    ])


# sources


@query(with_("content") + " SELECT DISTINCT checksum, size FROM content")
def s01_list_objects(spark, d):
    return S.content(spark, d).select("checksum", "size").distinct()


@query(with_("commits") + " SELECT checksum, ts FROM commits")
def s02_commits(spark, d):
    return S.commits(spark, d).select("checksum", "ts")


@query(with_("content") + " SELECT size > 500 AS large, count(DISTINCT checksum) AS objects FROM content GROUP BY 1")
def s03_count_objects(spark, d):
    return S.content(spark, d).groupBy((F.col("size") > 500).alias("large")).agg(F.count_distinct("checksum").alias("objects"))


@query(with_("commits", "refs") + " SELECT name, checksum FROM refs WHERE name = 'cust/7' OR starts_with(name, 'cust/7/')")
def s04_refs_prefix(spark, d):
    return S.refs(spark, d).where(R.below(F.col("name"), "cust/7")).select("name", "checksum")


@query(with_("commits", "refs") + " SELECT name, checksum FROM refs WHERE regexp_matches(name, '^cust/1[0-9]/[0-9]*7$')")
def s05_refs_where(spark, d):
    return S.refs(spark, d).where(F.col("name").rlike("^cust/1[0-9]/[0-9]*7$")).select("name", "checksum")


@query("SELECT lower(replace(s_name, '#', '-')) || ':main' AS name, sha256('tip:' || s_suppkey) AS checksum FROM supplier")
def s06_remote_refs(spark, d):
    s = table(spark, d, "supplier")
    return s.select(F.concat(F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))), F.lit(":main")).alias("name"), F.sha2(F.concat(F.lit("tip:"), F.col("s_suppkey").cast("string")).cast("binary"), 256).alias("checksum"))


def _spaces(spark, d) -> DataFrame:
    """Local heads of one nation, mirrors of all collections, remote refs of suppliers with a collection."""
    ids = S.collections(spark, d)
    refs = S.refs(spark, d).withColumn("nation", F.split("name", "/")[1].cast("int"))
    tip = F.sha2(F.concat(F.lit("tip:"), F.col("s_suppkey").cast("string")).cast("binary"), 256)
    local = refs.where("nation = 0").join(ids, "nation").select("id", "name", "checksum", F.lit("local").alias("space"))
    mirror = refs.where("nation <> 0 and branch % 2 = 0").join(ids, "nation").select("id", "name", "checksum", F.lit("mirror").alias("space"))
    remote = table(spark, d, "supplier").withColumnRenamed("s_nationkey", "nation").join(ids, "nation").select("id", F.lit("main").alias("name"), tip.alias("checksum"), F.lit("remote").alias("space"))
    return local.unionByName(mirror).unionByName(remote)


SPACES = with_("commits", "refs", "collections") + """,
    nr AS (SELECT *, CAST(split_part(name, '/', 2) AS INT) AS nation FROM refs),
    spaces AS (SELECT id, name, checksum, 'local' AS space FROM nr JOIN collections USING (nation) WHERE nation = 0
    UNION ALL SELECT id, name, checksum, 'mirror' FROM nr JOIN collections USING (nation) WHERE nation <> 0 AND branch % 2 = 0
    UNION ALL SELECT id, 'main', sha256('tip:' || s_suppkey), 'remote' FROM supplier JOIN collections ON s_nationkey = nation)"""  # fmt: skip


@query(SPACES + " SELECT id, name, checksum FROM spaces WHERE space = 'mirror'")
def s07_mirror_refs(spark, d):
    return _spaces(spark, d).where("space = 'mirror'").select("id", "name", "checksum")


@query(SPACES + " SELECT space, name, checksum FROM spaces WHERE id = (SELECT id FROM collections WHERE nation = 3)")
def s09_refs_of_collection(spark, d):
    one = S.collections(spark, d).where("nation = 3").select("id")
    return _spaces(spark, d).join(one, "id").select("space", "name", "checksum")


@query(with_("commits", "refs") + " SELECT 'alias/' || branch AS name, name AS target FROM refs WHERE branch % 10 = 0")
def s10_ref_aliases(spark, d):
    return S.refs(spark, d).where("branch % 10 = 0").select(F.concat(F.lit("alias/"), F.col("branch").cast("string")).alias("name"), F.col("name").alias("target"))


@query(SPACES + " SELECT DISTINCT checksum FROM spaces")
def s11_ref_targets(spark, d):
    return _spaces(spark, d).select("checksum").distinct()


@query(with_("f0", "f1") + " SELECT path FROM f0 WHERE checksum IN (SELECT checksum FROM f1)")
def s14_has_object(spark, d):
    return S.files(spark, d).join(S.files(spark, d, 1).select("checksum"), "checksum", "left_semi").select("path")


@query(with_("commits") + " SELECT checksum, CASE WHEN k % 11 = 0 THEN 'partial' ELSE 'normal' END AS state FROM commits")
def s15_commit_state(spark, d):
    c = S.commits(spark, d)
    markers = c.where("k % 11 = 0").select("checksum", F.lit("partial").alias("kind"))
    return c.join(markers, "checksum", "left").select("checksum", F.coalesce("kind", F.lit("normal")).alias("state"))


@query(with_("f0") + " SELECT w.path AS asked, f0.checksum FROM (VALUES ('/src3//./en/d00000003.txt', '/src3/en/d00000003.txt'), ('/src3/../x', '/src3/../x'), ('/nope', '/nope')) w(path, plain) LEFT JOIN f0 ON f0.path = w.plain")
def s18_path_lookup(spark, d):
    asked = spark.range(1).select(F.explode(F.array(F.lit("/src3//./en/d00000003.txt"), F.lit("/src3/../x"), F.lit("/nope"))).alias("asked"))
    return asked.withColumn("path", T.normal_path(F.col("asked"))).join(S.files(spark, d), "path", "left").select("asked", "checksum")


def _layers(spark, d) -> tuple[DataFrame, DataFrame]:
    lower = S.files(spark, d, 1).select("path", "checksum")
    up = S.files(spark, d, 2)
    marks = spark.range(1).select(F.inline(F.array(F.struct(F.lit("/src1").alias("path"), F.lit("w").alias("kind")), F.struct(F.lit("/src2/en").alias("path"), F.lit("o").alias("kind")))))
    upper = up.where(F.pmod(F.length("path"), F.lit(1)) == 0).where("size % 2 = 0").select("path", F.lit("f").alias("kind"), "checksum").unionByName(marks.withColumn("checksum", F.lit(None).cast("string")))
    return lower, upper


@query(with_("f1", "f2") + """, kept AS (SELECT path, checksum FROM f1 WHERE NOT starts_with(path, '/src1/') AND NOT starts_with(path, '/src2/en/')),
    up AS (SELECT path, checksum FROM f2 WHERE size % 2 = 0)
    SELECT coalesce(k.path, u.path) AS path, coalesce(u.checksum, k.checksum) AS checksum FROM kept k FULL OUTER JOIN up u ON k.path = u.path""")  # fmt: skip
def s23_overlay(spark, d):
    return T.overlay(*_layers(spark, d))


@query(with_("f1", "f2") + " SELECT coalesce(a.path, b.path) AS path, coalesce(b.checksum, a.checksum) AS checksum FROM f1 a FULL OUTER JOIN f2 b ON a.path = b.path")
def s21_committed_tree_ingest(spark, d):
    merged = T.merge(S.files(spark, d, 1).withColumn("kind", F.lit("f")), S.files(spark, d, 2).withColumn("kind", F.lit("f")), right_wins=True)
    return merged.select("path", "checksum")


@query("""SELECT s_name AS file, 'remote "' || s_suppkey || '"' AS grp, key, value FROM (SELECT s_name, s_suppkey, 'url' AS key, 'https://h/' || s_suppkey || '?a=b' AS value FROM supplier
    UNION ALL SELECT s_name, s_suppkey, 'branches', 'a;b;' || s_nationkey || ';' FROM supplier UNION ALL SELECT s_name, s_suppkey, 'gpg-verify', 'true' FROM supplier WHERE s_suppkey % 2 = 0)""")  # fmt: skip
def s25_config_keys(spark, d):
    s, text = table(spark, d, "supplier"), F.col("s_suppkey").cast("string")
    lines = F.array(F.lit("# head"), F.concat(F.lit('[remote "'), text, F.lit('"]')), F.concat(F.lit("url = https://h/"), text, F.lit("?a=b")), F.concat(F.lit("branches=a;b;"), F.col("s_nationkey").cast("string"), F.lit(";")), F.lit(""), F.when(F.col("s_suppkey") % 2 == 0, F.lit(" gpg-verify = true ")).otherwise(F.lit("# off")))
    return R.parse_config(s.select(F.col("s_name").alias("file"), F.posexplode(lines).alias("pos", "line")))


@query("SELECT s_suppkey AS remote, e.item, e.pos FROM supplier, (SELECT unnest(['a', 'b', NULL]) AS item, unnest([0, 1, 2]) AS pos) e WHERE e.pos < 2 UNION ALL SELECT s_suppkey, CAST(s_nationkey AS VARCHAR), 2 FROM supplier")
def c10_keyfile_list(spark, d):
    s = table(spark, d, "supplier").withColumn("text", F.concat(F.lit("a;b;"), F.col("s_nationkey").cast("string"), F.lit(";")))
    return s.select(F.col("s_suppkey").alias("remote"), F.posexplode(F.split(F.regexp_replace("text", ";$", ""), ";")).alias("pos", "item"))


@query(with_("f0") + ", m AS (SELECT source AS dev, checksum AS c, min(path) AS p FROM f0 GROUP BY 1, 2) SELECT f0.path, m.p AS known FROM f0 JOIN m ON m.dev = f0.source AND m.c = f0.checksum")
def s28_devino_cache(spark, d):
    f = S.files(spark, d).withColumn("dev", F.split("path", "/")[1])
    memo = f.groupBy("dev", "checksum").agg(F.min("path").alias("known"))
    return f.join(memo, ["dev", "checksum"]).select("path", "known")


# sinks


@query(with_("f0") + ",\n" + trees_sql("f0") + " SELECT path, checksum, files, dirs FROM f0_trees")
def k02_dirtree_checksum(spark, d):
    return T.write_tree(S.files(spark, d).select("path", "checksum"))


@query(with_("f0", "f1", "f2") + ",\n" + ",\n".join(trees_sql(f) for f in ("f0", "f1", "f2")) + "".join(f" {'UNION ALL ' if v else ''}SELECT {v} AS snapshot, checksum AS root, sha256(unhex(checksum || '{META}')) AS content_checksum FROM f{v}_t1" for v in range(3)))
def k03_root_content_checksum(spark, d):
    roots = [T.content_root(T.write_tree(S.files(spark, d, v).select("path", "checksum"))).select(F.lit(v).alias("snapshot"), F.col("checksum").alias("root"), "content_checksum") for v in range(3)]
    return roots[0].unionByName(roots[1]).unionByName(roots[2])


@query(with_("commits") + """, rel AS (SELECT checksum, k FROM commits WHERE k % 5 = 0) SELECT c.checksum, CASE WHEN r.k IS NULL THEN 'absent' WHEN r.k % 11 = 0 THEN 'partial' ELSE 'complete' END AS dependency
    FROM commits c LEFT JOIN rel r ON r.k = c.k - 1 WHERE c.k % 5 IN (1, 2)""")  # fmt: skip
def k04_check_related(spark, d):
    c = S.commits(spark, d)
    dep = c.where("k % 5 = 0").select((F.col("k") + 1).alias("k"), F.col("k").alias("of"))
    return c.where("k % 5 in (1, 2)").join(dep, "k", "left").select("checksum", F.when(F.col("of").isNull(), "absent").when(F.col("of") % 11 == 0, "partial").otherwise("complete").alias("dependency"))


@query(with_("commits", "refs") + """, u AS (SELECT name, CASE WHEN branch % 3 = 0 THEN 'x' ELSE checksum END AS expected, CASE WHEN branch % 4 = 0 THEN NULL ELSE sha256('new:' || name) END AS new FROM refs WHERE branch % 2 = 0
    UNION ALL SELECT 'fresh/' || branch, NULL, sha256('new:' || branch) FROM refs WHERE branch % 7 = 0)
    SELECT coalesce(r.name, u.name) AS name, CASE WHEN u.name IS NULL OR u.expected IS DISTINCT FROM r.checksum THEN r.checksum ELSE u.new END AS checksum,
    CASE WHEN u.name IS NULL THEN 'kept' WHEN u.expected IS DISTINCT FROM r.checksum THEN 'refused' WHEN u.new IS NULL THEN 'deleted' ELSE 'set' END AS outcome
    FROM refs r FULL OUTER JOIN u ON r.name = u.name""")  # fmt: skip
def k07_cas_refs(spark, d):
    refs = S.refs(spark, d)
    sha = lambda c: F.sha2(F.concat(F.lit("new:"), c.cast("string")).cast("binary"), 256)
    u = refs.where("branch % 2 = 0").select("name", F.when(F.col("branch") % 3 == 0, "x").otherwise(F.col("checksum")).alias("expected"), F.when(F.col("branch") % 4 != 0, sha(F.col("name"))).alias("new"))
    fresh = refs.where("branch % 7 = 0").select(F.concat(F.lit("fresh/"), F.col("branch").cast("string")).alias("name"), F.lit(None).cast("string").alias("expected"), sha(F.col("branch")).alias("new"))
    return R.compare_and_set(refs.select("name", "checksum"), u.unionByName(fresh).withColumn("asked", F.lit(True)))


@query(with_("commits", "refs") + " SELECT name FROM refs WHERE branch % 6 <> 0 OR branch % 10 = 0")
def k08_remove_refs(spark, d):
    refs = S.refs(spark, d)
    doomed = refs.where("branch % 6 = 0").join(refs.where("branch % 10 = 0").select("name"), "name", "left_anti")
    return refs.join(doomed.select("name"), "name", "left_anti").select("name")


@query(with_("f0") + " SELECT path, count(*) OVER (PARTITION BY checksum) AS nlink, nullif(first_value(path) OVER (PARTITION BY checksum ORDER BY path), path) AS link_to FROM f0")
def k11_link_groups(spark, d):
    return T.link_groups(S.files(spark, d)).select("path", "nlink", "link_to")


@query(with_("commits", "refs") + " SELECT row_number() OVER (ORDER BY r.name) AS pos, r.name, r.checksum, c.ts FROM refs r JOIN commits c ON c.checksum = r.checksum")
def k14_summary(spark, d):
    rows = S.refs(spark, d).join(S.commits(spark, d).select("checksum", "ts"), "checksum").select("name", "checksum", "ts")
    by = rows.withColumn("head", F.substring_index("name", "/", 2))
    before = by.groupBy("head").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)))
    # ranks within the many heads run apart; only one row for each head is numbered alone
    # (`/` sorts below digits, so names and heads have one order)
    at = F.row_number().over(Window.partitionBy("head").orderBy("name")) + F.coalesce("before", F.lit(0))
    return by.join(before, "head").select(at.cast("long").alias("pos"), "name", "checksum", "ts")


# projections



@query(with_("f0") + " SELECT CASE WHEN starts_with(path, '/src1/') THEN '/usr/src1/' || substr(path, 7) ELSE path END AS path FROM f0")
def p07_path_rewrite(spark, d):
    return T.rename(S.files(spark, d).select("path"), "/src1", "/usr/src1")


@query(with_("f0") + " SELECT source, count(*) AS found, CASE count(*) WHEN 1 THEN min(path) END AS kernel FROM f0 WHERE lang = 'es' AND size > 2000 GROUP BY source")
def p11_bootable(spark, d):
    f = S.files(spark, d).where(F.col("path").rlike("^/[^/]+/es/[^/]+$") & (F.col("size") > 2000))
    return f.groupBy(F.split("path", "/")[1].alias("source")).agg(F.count("*").alias("found"), F.when(F.count("*") == 1, F.min("path")).alias("kernel"))


# filters


@query("SELECT page_id, regexp_matches(p, '^[^/]+/[^/]+$') AS two, regexp_matches(p, '^[^/]+(/[^/]+)*/[0-9]+$') AS deep FROM (SELECT page_id, regexp_replace(url, '^https?://|[?#].*$', '', 'g') AS p FROM pages)")
def f01_pattern(spark, d):
    p = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^https?://|[?#].*$", "").alias("p"))
    return p.select("page_id", R.matches(F.col("p"), "*/*").alias("two"), (R.matches(F.col("p"), "**/*") & F.col("p").rlike("/[0-9]+$")).alias("deep"))


@query(with_("commits", "refs") + " SELECT name FROM refs WHERE (regexp_matches(name, '^cust/3/[^/]+$') OR regexp_matches(name, '^cust/[^/]+/1[0-9]$')) AND NOT name = 'cust/3/11'")
def f02_selector(spark, d):
    refs = S.refs(spark, d)
    keep = R.selected(F.col("name"), ["cust/3/*", "!cust/3/11"]) | (R.selected(F.col("name"), ["cust/*/*", "!cust/3/11"]) & F.col("name").rlike("/1[0-9]$"))
    return refs.where(keep).select("name")


@query(with_("collections") + " SELECT id, regexp_matches(id, '^[A-Za-z_][A-Za-z0-9_]*([.][A-Za-z_][A-Za-z0-9_]*)+$') AND octet_length(encode(id)) <= 255 AS valid FROM (SELECT id FROM collections UNION ALL SELECT n_name FROM nation UNION ALL SELECT '1.' || n_name FROM nation)")
def f05_collection_id(spark, d):
    n = table(spark, d, "nation")
    ids = S.collections(spark, d).select("id").unionByName(n.select(F.col("n_name").alias("id"))).unionByName(n.select(F.concat(F.lit("1."), "n_name").alias("id")))
    return ids.select("id", R.valid_collection(F.col("id")).alias("valid"))


@query(with_("f0") + " SELECT path FROM f0 WHERE starts_with(path, '/src1/en/') OR starts_with(path, '/src2/')")
def f08_subpath_scope(spark, d):
    return T.in_scope(S.files(spark, d).select("path"), ["/src1/en", "/src2/"])


def _rules(spark, d) -> DataFrame:
    c = table(spark, d, "customer")
    who, ref = F.col("c_mktsegment"), F.concat(F.lit("cust/"), F.col("c_nationkey").cast("string"))
    return c.select(who.alias("who"), ref.alias("ref"), F.when(F.col("c_custkey") % 97 == 0, "deny").otherwise("allow").alias("effect"), F.pow(F.lit(2), F.col("c_custkey") % 5).cast("int").alias("modes")).where("c_custkey % 3 = 0")


@query("""WITH r AS (SELECT c_mktsegment AS who, 'cust/' || c_nationkey AS ref, c_custkey % 97 = 0 AS deny, CAST(2 ** (c_custkey % 5) AS INT) AS modes FROM customer WHERE c_custkey % 3 = 0),
    g AS (SELECT who, ref, coalesce(bit_or(modes) FILTER (WHERE NOT deny), 0) AS m, bool_or(deny) AS deny FROM r GROUP BY 1, 2)
    SELECT who, ref, CASE WHEN deny THEN 0 WHEN m & 22 <> 0 THEN m | 1 ELSE m END AS modes FROM g""")  # fmt: skip
def f09_rights(spark, d):
    return R.rights(_rules(spark, d))


@query(with_("f0") + " SELECT path FROM f0 WHERE NOT starts_with(path, '/src4/') AND NOT starts_with(path, '/src5/de/') AND lang <> 'es'")
def f15_filter_callbacks(spark, d):
    files = S.files(spark, d).select("path")
    skipped = T.directories(files).where("path in ('/src4', '/src5/de') or path like '/%/es'")
    return T.skip_subtrees(files, skipped)


@query(with_("commits") + ", c AS (SELECT *, k // 3 AS content FROM commits) SELECT c.checksum FROM c LEFT JOIN c p ON p.checksum = c.parent WHERE p.content IS DISTINCT FROM c.content")
def f18_skip_unchanged(spark, d):
    c = S.commits(spark, d).withColumn("content", F.expr("k div 3"))
    p = c.select(F.col("checksum").alias("parent"), F.col("content").alias("before"))
    return c.join(p, "parent", "left").where(~F.col("before").eqNullSafe(F.col("content"))).select("checksum")


# joins


def _listing(spark, d, v: int) -> DataFrame:
    files = S.files(spark, d, v).select("path", "checksum")
    dirs = T.directories(files).where("path <> ''").select("path", F.lit("d").alias("kind"), F.lit("").alias("checksum"))
    return files.select("path", F.lit("f").alias("kind"), "checksum").unionByName(dirs)


@query(with_("f1", "f2") + """, l1 AS (SELECT path, 'f' AS kind, checksum FROM f1 UNION SELECT '/' || source, 'd', '' FROM f1 UNION SELECT '/' || source || '/' || lang, 'd', '' FROM f1),
    l2 AS (SELECT path, 'f' AS kind, checksum FROM f2 UNION SELECT '/' || source, 'd', '' FROM f2 UNION SELECT '/' || source || '/' || lang, 'd', '' FROM f2),
    x AS (SELECT coalesce(l1.path, l2.path) AS path, CASE WHEN l1.path IS NULL THEN 'A' WHEN l2.path IS NULL THEN 'D' ELSE 'M' END AS change, l1.kind FROM l1 FULL OUTER JOIN l2 ON l1.path = l2.path WHERE l1.checksum IS DISTINCT FROM l2.checksum)
    SELECT change, path FROM x WHERE NOT (change = 'D' AND EXISTS (SELECT 1 FROM x y WHERE y.change = 'D' AND y.kind = 'd' AND starts_with(x.path, y.path || '/')))""")  # fmt: skip
def j01_diff(spark, d):
    return T.diff(_listing(spark, d, 1), _listing(spark, d, 2))


@query(with_("f1", "f2") + """, a AS (SELECT DISTINCT checksum, size FROM f1), b AS (SELECT DISTINCT checksum FROM f2)
    SELECT (SELECT count(*) FROM a) AS from_count, (SELECT count(*) FROM b) AS to_count, count(*) AS common_count, CAST(coalesce(sum(size), 0) AS BIGINT) AS common_bytes FROM a WHERE checksum IN (SELECT checksum FROM b)""")  # fmt: skip
def j02_diff_stats(spark, d):
    return T.diff_stats(S.files(spark, d, 1), S.files(spark, d, 2))


REACH = with_("commits", "refs", "content", recursive=True) + """, walk(checksum, left_) AS (SELECT checksum, 2 FROM refs WHERE branch % 2 = 0 UNION SELECT c.parent, left_ - 1 FROM walk JOIN commits c USING (checksum) WHERE c.parent IS NOT NULL AND left_ > 0),
    kept AS (SELECT DISTINCT checksum FROM walk)"""  # fmt: skip


def _kept(spark, d, bound: int = 2) -> DataFrame:
    c = S.commits(spark, d)
    roots = S.refs(spark, d).where("branch % 2 = 0").select(F.col("checksum").alias("node"), F.lit(bound).alias("bound"))
    edges = c.where("parent is not null").select(F.col("checksum").alias("src"), F.col("parent").alias("dst"))
    return Hi.closure(roots, edges).select(F.col("node").alias("checksum"))


def _reached_objects(spark, d, kept: DataFrame) -> DataFrame:
    ks = S.commits(spark, d).select("checksum", "k").join(kept, "checksum", "left_semi").select("k")
    return S.content(spark, d).join(ks, "k", "left_semi").select("checksum", "size").distinct()



@query(REACH + " SELECT checksum FROM kept UNION ALL SELECT DISTINCT o.checksum FROM content o JOIN commits c USING (k) JOIN kept ON kept.checksum = c.checksum")
def j04_reachable(spark, d):
    kept = _kept(spark, d)
    return kept.unionByName(_reached_objects(spark, d, kept).select("checksum"))


@query(REACH + """, alive AS (SELECT DISTINCT o.checksum FROM content o JOIN commits c USING (k) JOIN kept ON kept.checksum = c.checksum), objects AS (SELECT DISTINCT checksum, size FROM content)
    SELECT checksum, size FROM objects WHERE checksum NOT IN (SELECT checksum FROM alive)""")  # fmt: skip
def j05_prune_depth(spark, d):
    objects = S.content(spark, d).select("checksum", "size").distinct().withColumn("otype", F.lit(1))
    return Hi.prune(objects, _reached_objects(spark, d, _kept(spark, d))).select("checksum", "size")


@query(REACH + """, alive AS (SELECT DISTINCT o.checksum FROM content o JOIN commits c USING (k) JOIN kept ON kept.checksum = c.checksum), objects AS (SELECT DISTINCT checksum, size FROM content)
    SELECT count(*) AS total, count(*) FILTER (WHERE checksum NOT IN (SELECT checksum FROM alive)) AS pruned, CAST(coalesce(sum(size) FILTER (WHERE checksum NOT IN (SELECT checksum FROM alive)), 0) AS BIGINT) AS freed FROM objects""")  # fmt: skip
def a02_prune_stats(spark, d):
    alive = _reached_objects(spark, d, _kept(spark, d)).select("checksum", F.lit(True).alias("alive"))
    both = S.content(spark, d).select("checksum", "size").distinct().join(alive, "checksum", "left")
    gone = F.col("alive").isNull()
    return both.agg(F.count("*").alias("total"), F.count_if(gone).alias("pruned"), F.coalesce(F.sum(F.when(gone, F.col("size"))), F.lit(0)).alias("freed"))


@query(with_("f1", "f2") + " SELECT checksum, source, path FROM (SELECT b.checksum, a.checksum AS source, b.path, row_number() OVER (PARTITION BY b.checksum ORDER BY b.path) AS n FROM f2 b JOIN f1 a ON a.path = b.path WHERE a.checksum <> b.checksum) WHERE n = 1")
def j07_delta_pairs(spark, d):
    return D.pair_sources(S.files(spark, d, 1), S.files(spark, d, 2))


@query(with_("commits") + ", h AS (SELECT * FROM commits WHERE k % 9 <> 0) SELECT h.checksum, CASE WHEN p.checksum IS NULL THEN 'absent' WHEN p.k % 11 = 0 THEN 'partial' ELSE 'ok' END AS state FROM h LEFT JOIN h p ON p.checksum = h.parent WHERE h.parent IS NOT NULL")
def j12_dependencies(spark, d):
    h = S.commits(spark, d).where("k % 9 <> 0")
    p = h.select(F.col("checksum").alias("parent"), F.col("k").alias("pk"))
    return h.where("parent is not null").join(p, "parent", "left").select("checksum", F.when(F.col("pk").isNull(), "absent").when(F.col("pk") % 11 == 0, "partial").otherwise("ok").alias("state"))


@query(with_("commits") + ", h AS (SELECT * FROM commits WHERE k % 9 <> 0) SELECT checksum FROM h WHERE parent IS NOT NULL AND parent NOT IN (SELECT checksum FROM h)")
def j13_orphans(spark, d):
    h = S.commits(spark, d).where("k % 9 <> 0")
    return h.where("parent is not null").join(h.select(F.col("checksum").alias("parent")), "parent", "left_anti").select("checksum")


@query("SELECT name, s_suppkey AS remote, ts FROM (SELECT 'n/' || s_nationkey AS name, s_suppkey, (s_suppkey * 7) % 5 AS ts, row_number() OVER (PARTITION BY s_nationkey ORDER BY (s_suppkey * 7) % 5 DESC, s_suppkey) AS n FROM supplier) WHERE n = 1")
def j14_collection_select(spark, d):
    rows = table(spark, d, "supplier").select(F.concat(F.lit("n/"), F.col("s_nationkey").cast("string")).alias("name"), F.col("s_suppkey").alias("remote"), (F.col("s_suppkey") * 7 % 5).alias("ts"))
    return R.newest(rows, "name", "ts", "remote")


@query(with_("commits", "refs", recursive=True) + """, u AS (SELECT r.name, c.checksum AS old, r.checksum AS new FROM refs r JOIN commits c ON (c.branch = r.branch AND c.seq = 2) UNION ALL SELECT r.name, c.checksum, r.checksum FROM refs r JOIN commits c ON c.branch = r.branch + 1 AND c.seq = 1),
    anc(new, node) AS (SELECT DISTINCT new, new FROM u UNION SELECT anc.new, c.parent FROM anc JOIN commits c ON c.checksum = anc.node WHERE c.parent IS NOT NULL)
    SELECT u.name, u.old, u.new, EXISTS (SELECT 1 FROM anc WHERE anc.new = u.new AND anc.node = u.old) AS fast_forward FROM u""")  # fmt: skip
def j17_fast_forward(spark, d):
    c, r = S.commits(spark, d), S.refs(spark, d).withColumnRenamed("checksum", "new")
    own = r.join(c.where("seq = 2").select("branch", F.col("checksum").alias("old")), "branch").select("name", "old", "new")
    other = r.join(c.where("seq = 1").select((F.col("branch") - 1).alias("branch"), F.col("checksum").alias("old")), "branch").select("name", "old", "new")
    return Hi.fast_forward(c.select("checksum", "parent"), own.unionByName(other)).select("name", "old", "new", "fast_forward")


@query(with_("f0", "f2") + " SELECT f0.path, CASE WHEN f2.path IS NULL THEN 'absent' WHEN f2.checksum <> f0.checksum THEN 'mismatch' ELSE 'ok' END AS image FROM f0 LEFT JOIN f2 ON f2.path = f0.path")
def j19_image_check(spark, d):
    stored = S.files(spark, d, 2).select("path", F.col("checksum").alias("stored"))
    return S.files(spark, d).join(stored, "path", "left").select("path", F.when(F.col("stored").isNull(), "absent").when(F.col("stored") != F.col("checksum"), "mismatch").otherwise("ok").alias("image"))


@query(with_("commits", "refs") + " SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'unlisted' WHEN a.name IS NULL THEN 'gone' ELSE 'differs' END AS finding FROM (SELECT * FROM refs WHERE branch % 5 <> 0) a FULL OUTER JOIN (SELECT name, CASE WHEN branch % 4 = 0 THEN 'x' ELSE checksum END AS checksum FROM refs WHERE branch % 3 <> 0) b ON a.name = b.name WHERE a.checksum IS DISTINCT FROM b.checksum")
def j20_summary_consistency(spark, d):
    refs = S.refs(spark, d)
    listed = refs.where("branch % 3 <> 0").select("name", F.when(F.col("branch") % 4 == 0, "x").otherwise(F.col("checksum")).alias("listed"))
    both = refs.where("branch % 5 <> 0").select("name", "checksum").join(listed, "name", "full_outer").where("not (checksum <=> listed)")
    return both.select("name", F.when(F.col("listed").isNull(), "unlisted").when(F.col("checksum").isNull(), "gone").otherwise("differs").alias("finding"))


# aggregates, windows


@query(SPACES + " SELECT id, count(*) AS refs, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT id, name FROM spaces) GROUP BY id")
def a09_refs_by_collection(spark, d):
    return _spaces(spark, d).groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("n")).select("id", F.size("n").cast("long").alias("refs"), F.array_join("n", ",").alias("names"))


@query(with_("commits") + " SELECT checksum FROM (SELECT checksum, row_number() OVER (PARTITION BY branch ORDER BY seq DESC) AS n FROM commits) WHERE n <= 3")
def w02_depth(spark, d):
    return Hi.positions(S.commits(spark, d), ["seq"]).where("depth <= 2").select("checksum")


@query(with_("commits") + " SELECT checksum FROM (SELECT checksum, branch, row_number() OVER (PARTITION BY branch ORDER BY seq DESC) - 1 AS depth FROM commits) WHERE depth <= CASE WHEN branch % 3 = 0 THEN 4 WHEN branch % 3 = 1 THEN 1 ELSE 1000000 END")
def w04_branch_override(spark, d):
    c = S.commits(spark, d)
    listed = c.select("branch").distinct().where("branch % 3 <> 2")
    # the last entry for a branch wins; a depth of 0 means the global depth, 1
    entries = listed.select("branch", F.posexplode(F.array(F.lit(9), F.when(F.col("branch") % 3 == 0, 4).otherwise(0))).alias("pos", "depth_"))
    own = entries.groupBy("branch").agg(F.max_by("depth_", "pos").alias("own"))
    keep = F.when(F.col("own").isNull(), F.lit(Hi.ALL)).when(F.col("own") == 0, 1).otherwise(F.col("own"))
    return Hi.positions(c, ["seq"]).join(own, "branch", "left").where(F.col("depth") <= keep).select("checksum")


@query(with_("commits", "refs", recursive=True) + """, walk(checksum) AS (SELECT checksum FROM refs WHERE branch % 2 = 0 UNION SELECT c.parent FROM walk JOIN commits c USING (checksum) WHERE c.parent IS NOT NULL)
    SELECT 'weak/' || c.k AS name, c.checksum IN (SELECT checksum FROM walk) AS kept FROM commits c WHERE c.k % 6 = 0""")  # fmt: skip
def w05_weak_refs(spark, d):
    strong = S.refs(spark, d).where("branch % 2 = 0")
    reached = Hi.behind(strong, Hi.jumps(S.commits(spark, d))).withColumn("kept", F.lit(True))
    weak = S.commits(spark, d).where("k % 6 = 0").select(F.concat(F.lit("weak/"), F.col("k").cast("string")).alias("name"), "checksum")
    return weak.join(reached, "checksum", "left").select("name", F.coalesce("kept", F.lit(False)).alias("kept"))


@query(with_("commits") + " SELECT c.checksum, p.checksum AS back3 FROM commits c LEFT JOIN commits p ON p.branch = c.branch AND p.seq = c.seq - 3")
def w07_nth_parent(spark, d):
    return S.commits(spark, d).select("checksum", F.lag("checksum", 3).over(Window.partitionBy("branch").orderBy("seq")).alias("back3"))


# scalars



@query("SELECT o_orderkey AS k, lpad(hex(o_orderkey), 8, '0') AS be FROM orders")
def c06_big_endian(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), H.be32(F.col("o_orderkey")).alias("be"))


@query("SELECT o_orderkey AS k, substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS swapped FROM (SELECT o_orderkey, lpad(hex(o_orderkey), 8, '0') AS h FROM orders)")
def c09_byte_swap(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), H.le(F.col("o_orderkey"), F.lit(4)).alias("swapped"))


@query(with_("f0") + " SELECT '/' || path || '/./' AS raw, path AS plain FROM f0")
def c23_normal_path(spark, d):
    raw = F.concat(F.lit("/"), "path", F.lit("/./"))
    return S.files(spark, d).select(raw.alias("raw"), T.normal_path(raw).alias("plain"))


# codecs and archives, by round trip


def _documents(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("payload"))



@query("SELECT doc_id, sha256(text) AS inflated FROM documents")
def c14_deflate_round_trip(spark, d):
    return _documents(spark, d).select("doc_id", F.sha2(codecs.inflate(codecs.deflate("payload")), 256).alias("inflated"))


@query()
def c19_fsverity(spark, d):
    """Merkle digest and xxHash32 of each payload; tested on known vectors."""
    return _documents(spark, d).select("doc_id", codecs.fsverity_digest("payload").alias("digest"), codecs.xxh32("payload").alias("xxh32"))


@query(with_("f0") + " SELECT source AS archive, path, sha256(text) AS payload_sha256 FROM f0 JOIN documents d ON f0.path = '/' || d.source || '/' || d.lang || '/d' || lpad(CAST(d.doc_id AS VARCHAR), 8, '0') || '.txt'".replace("SELECT source AS", "SELECT f0.source AS"))
def s22_tar_round_trip(spark, d):
    """Export of a source's files as a tar, with hard links, and import of it."""
    docs = table(spark, d, "documents")
    files = docs.select(F.col("source").alias("archive"), S._path().alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("checksum"), F.col("text").cast("binary").alias("payload"), F.lit(1700000000).alias("ts"))
    back = archives.resolve_hardlinks(archives.read_tars(archives.write_tars(files)))
    return back.select("archive", "path", F.sha2("payload", 256).alias("payload_sha256"))


# the rest of the surface



@query("SELECT page_id, CASE WHEN regexp_matches(url, '^https') THEN 'tls' WHEN regexp_matches(url, '^http') THEN 'http' ELSE 'file' END AS class FROM pages")
def r14_endpoint_class(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", F.when(u.rlike("^https"), "tls").when(u.rlike("^http"), "http").otherwise("file").alias("class"))


@query(with_("f0") + " SELECT path, CASE WHEN size % 10 = 0 THEN 511 ELSE 420 END AS mode FROM f0 WHERE size % 7 <> 0")
def r30_statoverride(spark, d):
    f = S.files(spark, d)
    over, skip = f.where("size % 10 = 0").select("path", F.lit(511).alias("over")), f.where("size % 7 = 0").select("path")
    return f.join(skip, "path", "left_anti").join(over, "path", "left").select("path", F.coalesce("over", F.lit(H.FILE_MODE & 0o7777)).alias("mode"))


# update streams, as batch


LATE = with_("updates") + """, s AS (SELECT event_id, ref, event_id * 7919 % 1000 AS t FROM updates),
    m AS (SELECT event_id, ref, t, max(t) OVER (PARTITION BY ref ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)"""  # fmt: skip



@query(LATE + " SELECT event_id, ref, t, coalesce(t >= before, true) AS accepted FROM m")
def t03_timestamp_check(spark, d):
    """An update whose time lies before the newest accepted one is refused; equal passes. The newest accepted is the running maximum."""
    s = S.updates(spark, d).select("event_id", "ref", (F.col("event_id") * 7919 % 1000).alias("t"))
    before = F.max("t").over(Window.partitionBy("ref").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
    return s.withColumn("accepted", F.coalesce(F.col("t") >= before, F.lit(True)))


