import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from treelake.llm.shards import kd_shards


def run(spark, rows, shards):
    df = spark.createDataFrame(rows, "doc_id long, size long, source string, shard int")
    dims = {"source": F.crc32(F.col("source").cast("binary")), "size": F.log2(F.col("size")), "doc_id": F.col("doc_id")}
    return kd_shards(df, dims, F.col("size"), shards).collect()


@pytest.mark.parametrize("seed", range(3))
def test_bytes_are_near_equal_and_slots_gapless(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([8, 50, 900, 4000]), rng.choice(["hot"] * 3 + ["a", "b", None]), 9) for i in range(3000)]
    rows += [(None, 70, None, 1)] * 40 + [(7, 900, "hot", 1)] * 200
    got = run(spark, rows, 24)
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert sorted(by) == list(range(24))
    share = sum(r[1] for r in rows) / 24
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
        assert abs(sum(r.size for r in rs) - share) <= 5 * 4000


def test_edges(spark):
    assert run(spark, [], 24) == []
    assert [(r.shard, r.slot) for r in run(spark, [(1, 9, None, 0)], 1)] == [(0, 0)]
    assert len(run(spark, [(1, 9, None, 0), (1, 9, None, 0)], 24)) == 2
