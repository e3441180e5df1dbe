"""The registered queries of this package: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, licenses, maxent, mpeg, packing, pieces, toxicity
from .common import table
from .jaccard import jaccard_join
from .neardup import near_duplicates
from .shards import kd_shards


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard_join(table(spark, sf_dir, "documents"), k=3, num=90, den=100)
    return joined.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op2_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.98)
    return found.select(F.col("vec").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")
    thin = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), crc.alias("text_crc32"), F.crc32(F.col("source").cast("binary")).alias("source"), F.crc32(F.col("lang").cast("binary")).alias("lang"))
    dims = {"source": F.col("source"), "lang": F.col("lang"), "size": F.log2("size"), "doc_id": F.col("doc_id")}
    placed = kd_shards(thin, dims, F.col("size"), 24)
    none = F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), none)


def op4_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = mpeg.inspect_column(mpeg.encode_column(docs))
    seek = F.crc32(F.concat_ws(",", "offsets").cast("binary"))
    feature = F.concat_ws(":", "frames", "samples", "hertz", "crc_ok", "crc_bad", "skipped", seek)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_bestfit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), size=2048)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out("doc_id", 4, 2))
    model = langid.fit(docs.where("not held_out"), "doc_id", "text", "lang")
    return langid.identify(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op7_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(table(spark, sf_dir, "documents"), held_out=langid.held_out("doc_id", 7, 2))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, decoded again: how many, their digest, and length and digest of the text that came back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = tokenizer_path("piece_bpe_32k.model")
    encoded = pieces.encode(docs, model)
    measured = encoded.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), "ids")
    decoded = pieces.decode(measured, model, name="decoded")
    return decoded.select("doc_id", "n_ids", "ids_crc32", F.length("decoded").cast("long").alias("n_chars"), F.crc32(F.col("decoded").cast("binary")).alias("text_crc32"))


def op9_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", langid.held_out("doc_id", 3, 1))
    labels = table(spark, sf_dir, "labels").where(~langid.held_out("doc_id", 3, 1))
    model = toxicity.fit(docs.where("not held_out"), labels)
    scored = toxicity.score(docs, model, name="score")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs, licenses.known_licenses(spark)).select("doc_id", "canonical_chars", "digest", "license")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {"op10_license_scan": licenses.oracle_sql()}
