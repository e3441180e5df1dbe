"""What the operators of this package share: reading, durable cuts of lineage, size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import cut, shared_dir, spent

__all__ = ["BROADCAST_ROWS", "cut", "few_join", "maybe_broadcast", "semi_join", "shared_dir", "spent", "smallish_join", "spread_join", "table"]

#: Rows of two to four long columns that may be broadcast; beyond it a shuffled join is used. As a hash table of the driver they take up to 90 bytes
#: each, several times over while it is built and sent, and a query may hold several tables.
BROADCAST_ROWS = 100_000
#: Bytes of wider rows, summed up, that may be broadcast.
BROADCAST_BYTES = 8_000_000
#: Bits in one row of a bitmap, as bitmap_construct_agg makes them, and for each id of a set.
BITMAP, BITS_EACH = 32_768, 16
#: Rows of one key that a join leaves together; those of a hotter key are dealt over several copies of its other side.
TOGETHER = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def maybe_broadcast(small: DataFrame, rows: int) -> DataFrame:
    """Broadcast a frame of two to four long columns whose counted size is within the bound."""
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small


def semi_join(rows: DataFrame, ids: DataFrame, key: str, n: int) -> DataFrame:
    """rows of keys that are among the n ids. Where these are too many to broadcast, a bitmap of their hashes is (of 16 bits an id, less beyond BROADCAST_BYTES), and only rows that it lets in are shuffled to an exact join."""
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(ids), key, "left_semi")
    maps = max(1, min(-(-n * BITS_EACH // BITMAP), BROADCAST_BYTES * 8 // BITMAP))
    at = F.pmod(F.xxhash64(key), F.lit(maps * BITMAP).cast("long"))
    split = ids.select(at.alias("__at")).select(F.expr(f"__at div {BITMAP}").alias("__map"), (F.col("__at") % BITMAP).alias("__at"))
    made = cut(split.repartition("__map").groupBy("__map").agg(F.bitmap_construct_agg("__at").alias("__bits")))
    asked = rows.withColumn("__at", at).withColumn("__map", F.expr(f"__at div {BITMAP}")).join(F.broadcast(made), "__map")
    byte = f"cast(conv(hex(substring(__bits, cast(__at % {BITMAP} div 8 as int) + 1, 1)), 16, 10) as int)"
    return asked.where(f"getbit({byte}, cast(__at % 8 as int)) = 1").select(*rows.columns).join(ids, key, "left_semi")


def few_join(rows: DataFrame, one: DataFrame, key: str, salt_by: str, n: int) -> DataFrame:
    """rows JOIN one on the key, which is unique in `one`: its n rows are broadcast if they are few, else rows of hot keys are dealt."""
    return rows.join(F.broadcast(one), key) if n <= BROADCAST_ROWS else spread_join(rows, one, key, salt_by)


def spread_join(rows: DataFrame, one: DataFrame, key: str, salt_by: str, counts: DataFrame | None = None) -> DataFrame:
    """rows JOIN one on the key, which is unique in `one`. Rows of a hot key are dealt by a hash of `salt_by`, and its row of `one` is repeated for each share. counts (key, rows), if known already, spares counting."""
    counts = rows.groupBy(key).agg(F.count("*").alias("rows")) if counts is None else counts
    hot = cut(counts.where(F.col("rows") > TOGETHER).select(key, (F.col("rows") / TOGETHER).cast("int").alias("shares")))
    n = hot.count()
    if not n:
        spent(hot)
        return rows.join(one, key)
    few = maybe_broadcast(hot, n)
    dealt = rows.join(few, key, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(salt_by), F.col("shares") + 1), F.lit(0).cast("long")))
    copies = one.join(few, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("shares", F.lit(0)).cast("long"))))
    return dealt.drop("shares").join(copies.drop("shares"), [key, "salt"]).drop("salt")


def smallish_join(rows: DataFrame, one: DataFrame, key: str, salt_by: str, wide: str, width: int = 1) -> DataFrame:
    """rows JOIN one on the key: `one` is broadcast if the bytes of its column `wide` (elements of `width` bytes) sum up to little, else rows of hot keys are dealt."""
    size = F.size(wide) if dict(one.dtypes)[wide].startswith("array") else F.octet_length(wide)
    held = one.agg(F.sum(size.cast("long") * width + 64)).first()[0] or 0
    return rows.join(F.broadcast(one), key) if held <= BROADCAST_BYTES else spread_join(rows, one, key, salt_by)
