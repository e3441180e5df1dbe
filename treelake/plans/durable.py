"""Cutting lineage between the rounds of an iterative plan, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
#: Shuffle files go when the write that needed them has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder of a local master (tests), and an error on a cluster."""
    if known := spark.conf.get("spark.checkpoint.dir", None):
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="treelake-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def cut(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it again: lost executors then cost a re-read, not a re-run."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def spent(*frames: DataFrame) -> None:
    """Deletes the files of cuts that nothing reads any more; frames that are no cuts are left alone."""
    for df in frames:
        if path := getattr(df, "cut_path", None):
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
            df.cut_path = None
