"""Corpus pipeline: language ID, toxicity, near duplicates, packing. Each stage works on all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelake.llm import langid, packing, toxicity
from treelake.llm.common import shared_dir, table
from treelake.llm.jaccard import jaccard_join
from treelake.llm.queries import tokenizer_path

#: Near duplicates share this part (num / den) of their shingles of so many words.
SHINGLE, NUM, DEN = 5, 80, 100


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is clear; without letters or with a narrow margin they go, null and empty texts too. Repeated rows stay or go together; without a labelled text all go."""
    model = langid.fit(docs, "doc_id", "text", "lang")
    if not model:
        return docs.where(F.lit(False))
    return langid.identify(docs, model).where("not rejected").select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose toxicity score is below the threshold, null and empty texts and rows without an id too; equal texts share their fate. Without toxic labels all stay."""
    p = toxicity.Params()
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), p=p)
    return toxicity.score(docs, model, p=p, name="__score").where(F.col("__score") < p.threshold).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group; documents without an id stay. Rows that repeat an id stay with it."""
    joined = jaccard_join(docs, k=SHINGLE, num=NUM, den=DEN)
    gone = joined.where("doc is not null and component <> doc").select(F.col("doc").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens: every row's, also those of null or repeated ids; a null or empty text is one piece of one token."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), size=2048)


STAGES = [("language_id", language_id), ("toxicity", toxic), ("jaccard_join", near_duplicates), ("bestfit_pack", pack)]

#: Compression, learning and packing have no SQL form; tests compare each stage with a direct one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
