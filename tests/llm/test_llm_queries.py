"""The registered queries over a whole small table, against direct forms of their contracts."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from treelake.llm import mpeg, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    df = queries.queries()[name](spark, SF)
    return df.columns, df.collect()


def test_op1(spark, docs):
    from test_jaccard import brute

    cols, rows = run(spark, "op1_jaccard_join")
    assert cols == ["doc_id", "n_shingles", "component_id"]
    assert {tuple(r) for r in rows} == brute([(i, d.text) for i, d in docs.items()])


def test_op2(spark):
    from test_neardup import brute

    cols, rows = run(spark, "op2_embedding_neardup")
    assert cols == ["vec_id", "n_links", "component_id", "kept"]
    vectors = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, rows), key=str) == brute(vectors, 0.98)


def test_op3(spark, docs):
    cols, rows = run(spark, "op3_kd_shards")
    assert cols == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len(d.text.encode()) + 8, zlib.crc32(d.text.encode())) for i, d in docs.items()}
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert sorted(by) == list(range(24)) and all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by.values())


def test_op4(spark, docs):
    _, rows = run(spark, "op4_mpeg_audio")
    assert len(rows) == len(docs)
    for r in rows:
        payload, n = mpeg.padded(docs[r.doc_id].text)
        data = mpeg.write(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(data), hashlib.sha256(data).hexdigest()) and r.feature


def test_op5(spark, docs):
    cols, rows = run(spark, "op5_bestfit_pack")
    assert cols == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "proved"]
    assert {r.doc_id for r in rows} == set(docs)
    assert max(Counter({s: sum(r.length for r in rows if r.sequence_id == s) for s in {r.sequence_id for r in rows}}).values()) <= 2048


@pytest.mark.parametrize(("name", "mod", "out"), [("op6_language_id", 4, 2), ("op7_maxent_lm", 7, 2), ("op9_toxicity_nnpu", 3, 1)])
def test_held_out_rows(spark, docs, name, mod, out):
    _, rows = run(spark, name)
    assert {r.doc_id: r.held_out for r in rows} == {i: zlib.crc32(str(i).encode()) % mod == out for i in docs}
    if name == "op6_language_id":
        right = [r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out]
        assert np.mean(right) > 0.9 and all(0 <= r.score <= 1 for r in rows)
    if name == "op7_maxent_lm":
        assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)
    if name == "op9_toxicity_nnpu":
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_op8(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    _, rows = run(spark, "op8_sentencepiece")
    assert len(rows) == len(docs)
    for r in rows:
        ids = sp.encode(docs[r.doc_id].text)
        assert (r.n_ids, r.ids_crc32, r.text_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), zlib.crc32(docs[r.doc_id].text.encode()))
