"""Byte-exact object bytes and checksums as column expressions (hex strings until the last step)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Modes of a regular file and of a directory with the usual permissions.
FILE_MODE, DIR_MODE = 0o100644, 0o40755


def be32(n: Column) -> Column:
    """Unsigned 32-bit big-endian hex."""
    return F.lpad(F.hex(n.cast("long")), 8, "0")


def le(n: Column, width: Column) -> Column:
    """Little-endian hex of 1, 2, 4 or 8 bytes."""
    full = F.lpad(F.hex(n.cast("long")), 16, "0")
    byte = [F.substring(full, 15 - 2 * i, 2) for i in range(8)]
    return F.when(width == 1, byte[0]).when(width == 2, F.concat(*byte[:2])).when(width == 4, F.concat(*byte[:4])).otherwise(F.concat(*byte))


def offset_width(data: Column, count: Column) -> Column:
    """Smallest offset size for a container: data bytes and its offsets must be addressable."""
    return F.when(data + count <= 0xFF, 1).when(data + 2 * count <= 0xFFFF, 2).when(data + 4 * count <= 0xFFFFFFFF, 4).otherwise(8)


def sha(hexed: Column) -> Column:
    return F.sha2(F.unhex(hexed), 256)


def file_header(uid: Column, gid: Column, mode: Column, target: Column) -> Column:
    """Header of a file without extended attributes: four big-endian numbers, the link target, its end offset."""
    length = F.octet_length(target)
    end = 16 + length + 1
    return F.concat(be32(uid), be32(gid), be32(mode), F.lit("00000000"), F.hex(target.cast("binary")), F.lit("00"), le(end, offset_width(end, F.lit(1))))


def content_checksum(payload: Column, uid: Column | int = 0, gid: Column | int = 0, mode: Column | int = FILE_MODE, target: Column | str = "") -> Column:
    """sha256(be32(header length), four zero bytes, header, payload)."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    header = file_header(lit(uid), lit(gid), lit(mode), lit(target))
    prefix = F.concat(be32((F.length(header) / 2).cast("long")), F.lit("00000000"), header)
    return F.sha2(F.concat(F.unhex(prefix), payload.cast("binary")), 256)


def dirmeta_checksum(uid: Column | int = 0, gid: Column | int = 0, mode: Column | int = DIR_MODE) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return sha(F.concat(be32(lit(uid)), be32(lit(gid)), be32(lit(mode))))


def file_element(name: Column, checksum: Column) -> Column:
    end = F.octet_length(name) + 1
    return F.concat(F.hex(name.cast("binary")), F.lit("00"), F.upper(checksum), le(end, offset_width(end + 32, F.lit(1))))


def dir_element(name: Column, tree: Column, meta: Column) -> Column:
    end = F.octet_length(name) + 1
    width = offset_width(end + 64, F.lit(2))
    return F.concat(F.hex(name.cast("binary")), F.lit("00"), F.upper(tree), F.upper(meta), le(end + 32, width), le(end, width))


def size_of(hexed: Column) -> Column:
    return (F.length(hexed) / 2).cast("long")


def modified_base64(checksum: Column) -> Column:
    """Base64 of the 32 bytes with `_` for `/` and without padding."""
    return F.rtrim(F.translate(F.base64(F.unhex(checksum)), "/", "_"), F.lit("="))


def varint(n: Column) -> Column:
    """LEB128 hex: seven bits a byte, low bits first, the high bit set on all but the last."""
    groups = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.expr("0").cast("long") + (F.call_function("shiftright", n.cast("long"), (i * 7).cast("int")).bitwiseAND(127)))
    used = F.greatest(F.lit(1), F.ceil((F.length(F.trim(F.regexp_replace(F.conv(n.cast("string"), 10, 2), "^0+", ""))) / 7)).cast("int"))
    return F.concat_ws("", F.transform(F.slice(groups, F.lit(1), used), lambda x, i: F.lpad(F.hex(x + F.when(i < used - 1, 128).otherwise(0)), 2, "0")))


def _padded(hexed: str, to: int) -> Column:
    """Zero bytes up to the next multiple, behind a column."""
    return F.concat(hexed, F.repeat(F.lit("00"), F.pmod(-size_of(F.col(hexed)), F.lit(to)).cast("int")))


def _framed(data: str, *ends: str) -> Column:
    """A column and its offsets (columns of numbers), in the smallest width that addresses both."""
    width = offset_width(size_of(F.col(data)), F.lit(len(ends)))
    return F.concat(data, *[le(F.col(e), width) for e in ends])


def text(value: Column) -> Column:
    return F.concat(F.hex(value.cast("binary")), F.lit("00"))


#: Fixed value: the key under which a commit names the refs that it is for.
BINDING = "ostree.ref-binding"


def _entry(df: DataFrame, key: str, value: Column, out: str) -> DataFrame:
    """Adds the hex of a dictionary of one key. Each step's values are columns, so nothing is computed twice."""
    name = key.encode().hex().upper() + "00"
    start = name + "00" * (-len(name) // 2 % 8)
    df = df.withColumn("__e", F.concat(F.lit(start), value)).withColumn("__k", F.lit(len(name) // 2).cast("long"))
    df = df.withColumn("__e", _framed("__e", "__k"))
    return df.withColumn("__n", size_of(F.col("__e"))).withColumn(out, _framed("__e", "__n")).drop("__e", "__k", "__n")


def with_binding(df: DataFrame, ref: str, out: str) -> DataFrame:
    """Adds the hex of a metadata dictionary that binds a commit to the ref in a column; nothing where that is null."""
    df = df.withColumn("__t", text(F.col(ref))).withColumn("__m", size_of(F.col("__t")))
    df = df.withColumn("__t", _framed("__t", "__m"))
    df = _entry(df, BINDING, F.concat("__t", F.lit("00" + b"as".hex())), out)
    return df.withColumn(out, F.coalesce(out, F.lit(""))).drop("__t", "__m")


def with_commit(df: DataFrame, out: str, metadata: Column, parent: Column, subject: Column, body: Column, ts: Column, root: Column, meta: Column) -> DataFrame:
    """Adds the hex of a commit object without related commits; parent may be null. The time is big-endian, as stored."""
    df = df.withColumn("__m", metadata).withColumn("__p", F.concat("__m", F.coalesce(F.upper(parent), F.lit(""))))
    df = df.withColumn("__s", F.concat("__p", text(subject))).withColumn("__b", F.concat("__s", text(body)))
    df = df.withColumn("__r", F.concat(_padded("__b", 8), F.lpad(F.hex(ts.cast("long")), 16, "0"), F.upper(root)))
    df = df.withColumns({f"__n{c}": size_of(F.col(f"__{c}")) for c in "mpsbr"}).withColumn("__d", F.concat("__r", F.upper(meta)))
    return df.withColumn(out, _framed("__d", "__nr", "__nb", "__ns", "__np", "__np", "__nm")).drop(*[f"__{c}" for c in "mpsbrd"], *[f"__n{c}" for c in "mpsbr"])


def with_tombstone(df: DataFrame, checksum: str, out: str) -> DataFrame:
    """Adds the hex of the marker of a deleted commit: a dictionary of one key, whose value is the checksum in hex with a zero byte."""
    return _entry(df, "commit", F.concat(text(F.col(checksum)), F.lit("00" + b"ay".hex())), out)


def le_number(hexed: Column, at: Column, width: Column) -> Column:
    """The little-endian number of a width of 1, 2 or 4 bytes at a byte."""
    byte = lambda i: F.substr(hexed, (2 * (at + i) + 1).cast("int"), F.lit(2))
    raw = F.when(width == 1, byte(0)).when(width == 2, F.concat(byte(1), byte(0))).otherwise(F.concat(byte(3), byte(2), byte(1), byte(0)))
    return F.conv(raw, 16, 10).cast("long")


def read_commit(df: DataFrame, hexed: str) -> DataFrame:
    """Replaces a commit's hex by parent, subject, body, ts, root and meta, read by its offsets; fields that aren't selected cost nothing."""
    n = size_of(F.col(hexed))
    df = df.withColumn("__w", F.when(n < 1 << 8, 1).when(n < 1 << 16, 2).otherwise(4)).withColumn("__n", n)
    df = df.withColumns({f"__{i}": le_number(F.col(hexed), F.col("__n") - F.col("__w") * i, F.col("__w")) for i in (1, 2, 3, 4, 5, 6)})  # ends of metadata, parent, related, subject, body, root
    df = df.withColumn("__t", F.col("__5") + F.pmod(-F.col("__5"), F.lit(8)))
    piece = lambda a, b: F.substr(hexed, (2 * a + 1).cast("int"), (2 * (b - a)).cast("int"))
    string = lambda a, b: F.decode(F.unhex(piece(a, b - 1)), "UTF-8")
    c = F.col
    fields = {
        "parent": F.nullif(F.lower(piece(c("__1"), c("__2"))), F.lit("")), "subject": string(c("__3"), c("__4")), "body": string(c("__4"), c("__5")),
        "ts": F.conv(piece(c("__t"), c("__t") + 8), 16, 10).cast("long"), "root": F.lower(piece(c("__t") + 8, c("__6"))), "meta": F.lower(piece(c("__6"), c("__n") - c("__w") * 6)),
    }
    return df.withColumns(fields).drop("__w", "__n", "__t", *[f"__{i}" for i in range(1, 7)])


def strict_base64(text: Column) -> Column:
    """The bytes of standard base64; null where another text has the same bytes, or it is none."""
    raw = F.try_to_binary(text, F.lit("base64"))
    return F.when(F.base64(raw) == text, raw)


def size_entry(checksum: Column, stored: Column, size: Column, otype: Column) -> Column:
    """Hex of a size entry: checksum, stored and unpacked size, type."""
    return F.concat(F.upper(checksum), varint(stored), varint(size), F.lpad(F.hex(otype.cast("long")), 2, "0"))
