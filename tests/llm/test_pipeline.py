import importlib

import duckdb
import pytest

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.01"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lit = pipeline.F.lit
    copy = docs.where("doc_id = 1").withColumn("doc_id", lit(9001).cast("long"))
    digits = docs.where("doc_id = 2").withColumn("doc_id", lit(9002).cast("long")).withColumn("text", lit("12 34"))
    extra = docs.unionByName(copy).unionByName(digits)
    now, seen = extra, {}
    for name, stage in pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, now, SF).write.parquet(out)
        now = spark.read.parquet(out)
        if name != pipeline.STAGES[-1][0]:
            assert now.columns == docs.columns
            seen[name] = {r.doc_id for r in now.select("doc_id").collect()}
    assert 9002 not in seen["language_id"] and len(seen["language_id"]) > 950
    insults = {r.doc_id for r in docs.where(pipeline.F.lower("text").rlike(r"\b(idiot|moron|scum|trash)\b")).collect()}
    assert len(seen["toxicity"] & insults) < len(insults) / 2
    assert 9001 not in seen["jaccard_join"]
    packed = {r.doc_id for r in now.select("doc_id").collect()}
    assert packed == seen["jaccard_join"]


def test_near_duplicate_stage_equals_brute_force(spark):
    from test_jaccard import brute

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 3000")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = {i for i, _, c in brute(rows, 5, 80, 100) if c == i}
    assert {r.doc_id for r in pipeline.near_duplicates(spark, docs, SF).collect()} == kept


def test_empty_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []


def test_entry_imports():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 11)} <= {x.split("_")[0] + "_" for x in names} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names) and duckdb
