"""Integrity checks: stored bytes are hashed again and compared with the names they are stored under."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import content_checksum


def mismatches(objects: DataFrame) -> DataFrame:
    """Rows of (checksum, payload) whose payload is lost or has another SHA-256 than its name."""
    return objects.where(~F.col("checksum").eqNullSafe(F.sha2("payload", 256)))


def damaged_files(files: DataFrame) -> DataFrame:
    """Rows of (checksum, payload) of regular files whose payload, behind the usual header, has another checksum than its name."""
    return files.where(~F.col("checksum").eqNullSafe(content_checksum(F.col("payload"))))


def report(commits: DataFrame, partial: DataFrame) -> DataFrame:
    """The input's rows of (checksum, payload), and kind: corrupt before partial (a marker names it) before ok."""
    marked = commits.join(partial.select("checksum").distinct().withColumn("marked", F.lit(True)), "checksum", "left")
    kind = F.when(~F.col("checksum").eqNullSafe(F.sha2("payload", 256)), "corrupt").when(F.col("marked"), "partial").otherwise("ok")
    return marked.withColumn("kind", kind).drop("marked")


def summary(findings: DataFrame) -> DataFrame:
    """(otype, kind, n, checked) of findings (otype, kind): how many of each kind, and how many objects of the type were checked."""
    each = findings.groupBy("otype", "kind").agg(F.count("*").alias("n"))
    return each.join(each.groupBy("otype").agg(F.sum("n").alias("checked")), "otype")


def reached_by(bad: DataFrame, walked: DataFrame, commits: DataFrame) -> DataFrame:
    """(commit, path, object): every commit (checksum, root) whose tree holds a bad object (checksum), and where; walked is (root, path, child)."""
    held = walked.join(bad.select(F.col("checksum").alias("child")).distinct(), "child", "left_semi").select("root", "path", F.col("child").alias("object"))
    return commits.select(F.col("checksum").alias("commit"), "root").join(held, "root").select("commit", "path", "object")
