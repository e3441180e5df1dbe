"""A repository derived from the driver's tables: files, commits, refs, objects, collections, remotes, updates.

Each frame has a DuckDB CTE of the same rows in CTE, so that a query and its SQL start from the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing as H


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path():
    return F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/d"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".txt"))


def files(spark: SparkSession, sf_dir: str, version: int = 0) -> DataFrame:
    """(path, checksum, size): documents as files; snapshots 1 and 2 differ in what they hold and in some payloads."""
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    if version == 1:
        docs = docs.where("doc_id % 7 <> 0")
    if version == 2:
        docs = docs.where("doc_id % 5 <> 0")
        text = F.when(F.col("doc_id") % 3 == 0, F.concat(text, F.lit("!"))).otherwise(text)
    return docs.select(_path().alias("path"), H.content_checksum(text).alias("checksum"), F.octet_length(text).cast("long").alias("size"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, branch, checksum, parent, ts, seq): one linear branch for each customer."""
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    name = lambda k: F.sha2(F.concat(F.lit("commit:"), k.cast("string")).cast("binary"), 256)
    return o.select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("branch"), name(F.col("o_orderkey")).alias("checksum"), name(F.lag("o_orderkey").over(w)).alias("parent"),
        (F.unix_date(F.col("o_orderdate").cast("date")).cast("long") * 86400).alias("ts"), F.row_number().over(w).alias("seq"),
    )


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, checksum, branch): the tip of each customer's branch."""
    c = commits(spark, sf_dir)
    tips = c.groupBy("branch").agg(F.max_by("checksum", "seq").alias("checksum"))
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("branch"), F.concat(F.lit("cust/"), F.col("c_nationkey").cast("string"), F.lit("/"), F.col("c_custkey").cast("string")).alias("name"))
    return names.join(tips, "branch").select("name", "checksum", "branch")


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, name, checksum, size): entries of each commit's tree, shared by part and supplier."""
    key = F.concat_ws(":", F.lit("obj"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.concat(F.lit("l"), F.col("l_linenumber").cast("string")).alias("name"), F.sha2(key.cast("binary"), 256).alias("checksum"), (F.col("l_partkey") % 1000 + 1).cast("long").alias("size"))


def stored_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(checksum, payload): each commit's bytes as stored. Injected faults: one more byte where k % 97 = 0."""
    k = F.col("o_orderkey")
    right = F.concat(F.lit("commit:"), k.cast("string"))
    stored = F.when(k % 97 == 0, F.concat(right, F.lit("?"))).otherwise(right)
    return table(spark, sf_dir, "orders").select(F.sha2(right.cast("binary"), 256).alias("checksum"), stored.cast("binary").alias("payload"))


def partial_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(checksum): markers of commits that haven't arrived whole, where k % 11 = 0."""
    return commits(spark, sf_dir).where("k % 11 = 0").select("checksum")


def stored_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(checksum, payload): each object's bytes as stored. Injected faults: one more byte where its size % 97 = 0."""
    part = F.col("l_partkey")
    right = F.concat_ws(":", F.lit("obj"), part.cast("string"), F.col("l_suppkey").cast("string"))
    stored = F.when((part % 1000 + 1) % 97 == 0, F.concat(right, F.lit("?"))).otherwise(right)
    keys = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return keys.select(F.sha2(right.cast("binary"), 256).alias("checksum"), stored.cast("binary").alias("payload"))


def stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(checksum, payload): files of all snapshots as stored. Injected faults: one more byte where the size % 97 = 0."""
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select(F.explode(F.array(text, F.when(F.col("doc_id") % 3 == 0, F.concat(text, F.lit("!"))).otherwise(text))).alias("text"))
    stored = F.when(F.octet_length("text") % 97 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text"))
    return docs.select(H.content_checksum(F.col("text")).alias("checksum"), stored.cast("binary").alias("payload")).distinct()


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, nation): org.<region>.<nation>."""
    plain = lambda c: F.lower(F.translate(c, " ", "_"))
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("org."), plain("r_name"), F.lit("."), plain("n_name")).alias("id"), F.col("n_nationkey").alias("nation"))


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ref, ts, kind, checksum): events as a stream of ref updates."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("ref"), F.col("ts"), F.col("event_type").alias("kind"), F.sha2(F.concat(F.lit("e:"), F.col("event_id").cast("string")).cast("binary"), 256).alias("checksum"))


_PREFIX = "0000001200000000" + "0000000000000000000081a400000000" + "0011"


def _files(version: int) -> str:
    text = "CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END" if version == 2 else "text"
    where = {0: "", 1: "WHERE doc_id % 7 <> 0", 2: "WHERE doc_id % 5 <> 0"}[version]
    return f"""f{version} AS (SELECT '/' || source || '/' || lang || '/d' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.txt' AS path, source, lang,
        sha256(unhex('{_PREFIX}') || encode({text})) AS checksum, CAST(octet_length(encode({text})) AS BIGINT) AS size FROM documents {where})"""


CTE = {
    "f0": _files(0),
    "f1": _files(1),
    "f2": _files(2),
    "commits": """commits AS (SELECT o_orderkey AS k, o_custkey AS branch, sha256('commit:' || o_orderkey) AS checksum,
        sha256('commit:' || lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) AS parent,
        CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 86400 AS ts,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq FROM orders)""",
    "refs": """refs AS (SELECT 'cust/' || c_nationkey || '/' || c_custkey AS name, t.checksum, c_custkey AS branch FROM customer
        JOIN (SELECT branch, arg_max(checksum, seq) AS checksum FROM commits GROUP BY branch) t ON t.branch = c_custkey)""",
    "content": """content AS (SELECT l_orderkey AS k, 'l' || l_linenumber AS name, sha256('obj:' || l_partkey || ':' || l_suppkey) AS checksum,
        CAST(l_partkey % 1000 + 1 AS BIGINT) AS size FROM lineitem)""",
    "collections": """collections AS (SELECT 'org.' || lower(replace(r_name, ' ', '_')) || '.' || lower(replace(n_name, ' ', '_')) AS id, n_nationkey AS nation
        FROM nation JOIN region ON n_regionkey = r_regionkey)""",
    "updates": """updates AS (SELECT event_id, 'u/' || user_id AS ref, ts, event_type AS kind, sha256('e:' || event_id) AS checksum FROM events)""",
}


def with_(*names: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(CTE[n] for n in names)
