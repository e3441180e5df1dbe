"""Byte codecs that SQL lacks, as vectorised functions over Arrow batches."""

from __future__ import annotations

import hashlib
import zlib

import pandas as pd
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType

BLOCK, SIDE = 4096, 32


def fsverity(data: bytes) -> str:
    """Digest of a file's Merkle tree (SHA-256, blocks of 4096 bytes, no salt) and its descriptor."""
    level = [hashlib.sha256(data[i : i + BLOCK].ljust(BLOCK, b"\0")).digest() for i in range(0, len(data), BLOCK)]
    while len(level) > 1:
        step = BLOCK // SIDE
        level = [hashlib.sha256(b"".join(level[i : i + step]).ljust(BLOCK, b"\0")).digest() for i in range(0, len(level), step)]
    root = level[0] if level else bytes(32)
    descriptor = bytes([1, 1, 12, 0]) + bytes(4) + len(data).to_bytes(8, "little") + root.ljust(64, b"\0") + bytes(32) + bytes(144)
    return hashlib.sha256(descriptor).hexdigest()


@F.pandas_udf(BinaryType())
def deflate(data: pd.Series) -> pd.Series:
    """Raw DEFLATE, without a header."""

    def one(b: bytes | None) -> bytes | None:
        if b is None:
            return None
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        return c.compress(b) + c.flush()

    return data.map(one)


@F.pandas_udf(BinaryType())
def inflate(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else zlib.decompress(b, -15))


@F.pandas_udf(StringType())
def fsverity_digest(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else fsverity(bytes(b)))


@F.pandas_udf(LongType())
def xxh32(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else xxhash.xxh32_intdigest(bytes(b)))
