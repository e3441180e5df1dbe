"""fsck finds damage by hashing stored bytes, wherever it lies: one commit and one object are damaged that the id rules leave whole."""

from pyspark.sql import functions as F

from treelake import catalog
from treelake.sources import derived as S

SF = "/root/testdata/sf0.001"


def damage(frame, checksum):
    return frame.withColumn("payload", F.when(F.col("checksum") == checksum, F.lit(b"damaged")).otherwise(F.col("payload")))


def test_a_damaged_commit_is_counted(spark, monkeypatch):
    before = {(r.otype, r.kind): r.n for r in catalog.QUERIES["a03_fsck_report"](spark, SF).collect()}
    hit = S.commits(spark, SF).where("k % 97 <> 0 and k % 11 <> 0").orderBy("k").first().checksum
    stored = S.stored_commits
    monkeypatch.setattr(S, "stored_commits", lambda spark, d: damage(stored(spark, d), hit))
    after = {(r.otype, r.kind): r.n for r in catalog.QUERIES["a03_fsck_report"](spark, SF).collect()}
    assert after == {**before, (4, "corrupt"): before[4, "corrupt"] + 1, (4, "ok"): before[4, "ok"] - 1}


def test_a_damaged_file_is_attributed(spark, monkeypatch):
    rows = lambda: {(r.commit_, r.path, r.object) for r in catalog.QUERIES["j10_fsck_attribution"](spark, SF).collect()}
    before = rows()
    hit = S.files(spark, SF).where("size % 97 <> 0").orderBy("path").first().checksum
    holders = {(f"commit{v}", r.path, hit) for v in range(3) for r in S.files(spark, SF, v).where(F.col("checksum") == hit).collect()}
    stored = S.stored_files
    monkeypatch.setattr(S, "stored_files", lambda spark, d: damage(stored(spark, d), hit))
    assert rows() - before == holders and holders and before <= rows()
