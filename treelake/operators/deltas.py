"""Static deltas: object selection, source pairing, part packing, content-defined chunks, copy plans, opcode streams."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the chunker: window, mean, least and greatest chunk.
WINDOW, MEAN, LEAST, MOST = 64, 8192, 2048, 65536


#: Fixed value: what the stream size of a content object counts beside its header and payload.
FRAMING = 7


def select_objects(new: DataFrame, old: DataFrame, fallback: int) -> DataFrame:
    """Objects (otype, checksum, header, size) of the new closure that the old one lacks, and how each travels: metadata in parts, content in parts, or beside the delta where header, framing and payload reach the limit."""
    lacking = new.select("otype", "checksum", "header", "size").distinct().join(old.select("otype", "checksum").distinct(), ["otype", "checksum"], "left_anti")
    travels = F.when(F.col("otype") != 1, "metadata").when(F.col("header") + FRAMING + F.col("size") >= fallback, "fallback").otherwise("content")
    return lacking.select("otype", "checksum", "size", travels.alias("travels"))


def pull_plan(wanted: DataFrame, commits: DataFrame, complete: DataFrame, there: DataFrame) -> DataFrame:
    """(otype, checksum, pos) still to fetch of the wanted commits' objects (k, otype, checksum): commits that are complete contribute nothing; content before what names it, in checksum order."""
    open_ = commits.join(complete.select("checksum"), "checksum", "left_anti")
    objects = wanted.join(open_.select("k"), "k", "left_semi").select("otype", "checksum").unionByName(open_.select(F.lit(4).alias("otype"), "checksum")).distinct()
    left = objects.join(there.select("otype", "checksum"), ["otype", "checksum"], "left_anti")
    before = left.groupBy("otype", F.substring("checksum", 1, 2).alias("head")).agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.orderBy("otype", "head").rowsBetween(Window.unboundedPreceding, -1)))  # at most 256 rows for each type
    at = F.row_number().over(Window.partitionBy("otype", "head").orderBy("checksum")) + F.coalesce("before", F.lit(0))
    return left.withColumn("head", F.substring("checksum", 1, 2)).join(before, ["otype", "head"]).select("otype", "checksum", at.cast("long").alias("pos"))


def intern(rows: DataFrame, part: str, order: str, value: str) -> DataFrame:
    """(part, value, idx): a table of distinct values for each part, numbered by first appearance."""
    first = rows.groupBy(part, value).agg(F.min(order).alias("first"))
    return first.select(part, value, (F.row_number().over(Window.partitionBy(part).orderBy("first")) - 1).cast("long").alias("idx"))


def pair_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """(checksum, source): for changed content the old content of its first path."""
    both = new.select("path", "checksum").join(old.select("path", F.col("checksum").alias("source")), "path").where("checksum <> source")
    w = Window.partitionBy("checksum").orderBy("path")
    return both.withColumn("n", F.row_number().over(w)).where("n = 1").select("checksum", "source", "path")


def pack_parts(objects: DataFrame, most: int, by: str = "delta") -> DataFrame:
    """(by, otype, checksum, part): greedy packing of (by, otype, checksum, size); a part that isn't empty closes when the next object would exceed the limit.

    Metadata (otype 2 and more) goes first, by type and checksum, then content (otype 1) by checksum. The rule is a running sum with resets, which no
    window frame expresses: a task streams over its sorted rows and holds one number for the delta it is in.
    """
    rows = objects.select(by, "otype", "checksum", F.col("size").cast("long").alias("size"), (F.col("otype") == 1).alias("late"))
    rows = rows.repartition(by).sortWithinPartitions(by, "late", "otype", "checksum").drop("late")
    kind = objects.schema[by].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, held = None, 0, 0
        for b in batches:
            parts = np.zeros(b.num_rows, np.int64)
            for i, (delta, size) in enumerate(zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True)):
                if i == 0 and now is None or delta != now:
                    now, part, held = delta, 0, 0
                if held > 0 and held + size > most:
                    part, held = part + 1, 0
                held += size
                parts[i] = part
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(parts)], [by, "otype", "checksum", "part"])

    return rows.mapInArrow(pack, f"{by} {kind}, otype int, checksum string, part long")


def boundaries(data: bytes) -> np.ndarray:
    """Ends of windows whose rolling sum b has its low 13 bits all set.

    a is the sum of the bytes in the window, b the sum of the values of a: a byte counts in b as often as it has been in the window. Both come from prefix sums.
    """
    x = np.frombuffer(data, np.uint8).astype(np.int64)
    at = np.arange(1, len(x) + 1)
    plain, weighted = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(x * at)])
    start = np.maximum(at - WINDOW, 0)
    b = (at + 1) * (plain[at] - plain[start]) - (weighted[at] - weighted[start])
    return np.flatnonzero(b & (MEAN - 1) == MEAN - 1) + 1


def cut_points(data: bytes) -> list[int]:
    """Ends of content-defined chunks: the first boundary from the least size on, else the greatest size, else the end.

    The window starts anew with each chunk, but it is full long before the least size, so boundaries don't depend on where a chunk begins.
    """
    n, hits = len(data), boundaries(data)
    ends, at = [], 0
    while at < n:
        i = np.searchsorted(hits, at + LEAST)
        end = int(min(hits[i] if i < len(hits) else n, at + MOST, n))
        ends.append(end)
        at = end
    return ends


def chunks(objects: DataFrame) -> DataFrame:
    """(checksum, pos, start, length, digest) of each object's (checksum, payload) chunks, in Arrow batches. A null payload has none."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for checksum, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = 0
                for pos, end in enumerate(cut_points(payload or b"")):
                    for column, value in zip(out, (checksum, pos, at, end - at, hashlib.sha256(payload[at:end]).hexdigest()), strict=True):
                        column.append(value)
                    at = end
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["checksum", "pos", "start", "length", "digest"])

    return objects.select("checksum", "payload").mapInArrow(rows, "checksum string, pos int, start long, length long, digest string")


def plan_runs(source: bytes, target: bytes) -> list[tuple[int, int, int | None]]:
    """(start, length, from) runs that rebuild the target in order; from is null for bytes that the source lacks.

    A chunk is copied from right behind the last copy if its bytes are there, else from the first chunk of the source that equals it.
    Runs of one kind that go on are one run.
    """
    known: dict[bytes, int] = {}
    at = 0
    for end in cut_points(source):
        known.setdefault(source[at:end], at)
        at = end
    runs: list[tuple[int, int, int | None]] = []
    at = 0
    for end in cut_points(target):
        chunk = target[at:end]
        start, length, origin = runs[-1] if runs else (0, 0, None)
        behind = origin + length if origin is not None else None
        found = behind if behind is not None and source.startswith(chunk, behind) else known.get(chunk)
        if runs and (found is None and origin is None or found is not None and found == behind):
            runs[-1] = (start, length + len(chunk), origin)
        else:
            runs.append((at, len(chunk), found))
        at = end
    return runs


def copy_plan(pairs: DataFrame) -> DataFrame:
    """(checksum, run, start, length, from) of the runs that rebuild payload from source, for each row (checksum, payload, source). What counts is sequential within an object, so each is planned in one step of a task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(c, i, *run) for c, new, old in zip(*(x.to_pylist() for x in b.columns), strict=True) for i, run in enumerate(plan_runs(old or b"", new or b""))]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["checksum", "run", "start", "length", "from"])

    return pairs.select("checksum", "payload", "source").mapInArrow(rows, "checksum string, run int, start long, length long, from long")


def varint(n: int) -> bytes:
    out = bytearray()
    while True:
        n, low = n >> 7, n & 127
        out.append(low | 128 * (n > 0))
        if not n:
            return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        n |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if not byte & 128:
            if shift > 7 and not byte:
                raise ValueError("not the shortest form")
            return n, at


def read_varint_hex(hexed: Column) -> Column:
    """The LEB128 number that hex begins with; null where it isn't the shortest form."""
    byte = lambda i: F.conv(F.substr(hexed, 2 * i + 1, F.lit(2)), 16, 10).cast("long")
    places = F.sequence(F.lit(0), F.lit(8))
    last = F.array_min(F.filter(places, lambda i: byte(i) < 128))
    value = F.aggregate(F.filter(places, lambda i: i <= last), F.lit(0).cast("long"), lambda a, i: a + F.call_function("shiftleft", byte(i).bitwiseAND(127), i * 7))
    return F.when((last == 0) | (byte(last) > 0), value)


def inventory(stored: DataFrame) -> DataFrame:
    """(src, dst, path, digest) of deltas (path, superblock): names from paths of two folders, the digest of the superblock."""
    name = F.regexp_replace(F.regexp_replace("path", "^deltas/", ""), "^(..)/", "$1")
    plain = lambda part: F.lower(F.hex(F.unbase64(F.concat(F.translate(part, "_", "/"), F.lit("=")))))
    parts = F.split(name, "-")
    return stored.select(plain(parts[0]).alias("src"), plain(parts[1]).alias("dst"), "path", F.sha2("superblock", 256).alias("digest"))


def write_size(value: Column, order: Column) -> Column:
    """Hex of an unsigned 64-bit size in byte order `l` or `B`."""
    big = F.lpad(F.hex(value.cast("long")), 16, "0")
    return F.when(order == "B", big).otherwise(swapped(big))


def swapped(hexed: Column) -> Column:
    return F.array_join(F.reverse(F.regexp_extract_all(hexed, F.lit("(..)"), 1)), "")


def read_sizes(rows: DataFrame) -> DataFrame:
    """Reads `size` of rows with `order` into `value`."""
    return rows.withColumn("value", F.conv(F.when(F.col("order") == "B", F.col("size")).otherwise(swapped(F.col("size"))), 16, 10).cast("long"))


def verify(named: DataFrame, stored: DataFrame) -> DataFrame:
    """(delta, outcome) of the parts (delta, part, sum) that superblocks name, against stored (delta, part, payload): corrupt before missing part before ok."""
    both = named.join(stored, ["delta", "part"], "left")
    wrong = F.col("payload").isNotNull() & (F.sha2("payload", 256) != F.col("sum"))
    found = both.groupBy("delta").agg(F.bool_or(wrong).alias("wrong"), F.bool_or(F.col("payload").isNull()).alias("gone"))
    return found.select("delta", F.when(F.col("wrong"), "corrupt").when(F.col("gone"), "missing part").otherwise("ok").alias("outcome"))


def opcodes(ops: bytes, kinds: list[int]) -> list[str]:
    """The opcodes of a stream, in order; kinds are the types of the objects that it makes."""
    out, at, made = [], 0, 0
    while at < len(ops):
        op, at = chr(ops[at]), at + 1
        operands = {"S": 4 if kinds[made] == 1 else 2, "o": 3, "w": 2, "r": 1, "R": 0, "B": 2, "c": 0}[op] if op in "SowrRBc" and made < len(kinds) else None
        if operands is None:
            raise ValueError(f"opcode {op!r} has no place here")
        for _ in range(operands):
            _, at = read_varint(ops, at)
        made += op in "Sc"
        out.append(op)
    return out


def offtin(n: int) -> bytes:
    """Sign and magnitude, little-endian, in eight bytes."""
    return (abs(n) | (1 << 63 if n < 0 else 0)).to_bytes(8, "little")


def read_offtin(data: bytes) -> int:
    n = int.from_bytes(data, "little")
    return -(n & ~(1 << 63)) if n >> 63 else n


def bsdiff(source: bytes, target: bytes, step: int = 16) -> bytes:
    """A patch of interleaved blocks: lengths and seek, differences to the source, new bytes.

    Places that agree are found through an index of the source's words of `step` bytes; a match goes on over single
    differences while more bytes agree than differ.
    """
    index: dict[bytes, int] = {}
    for i in range(0, len(source) - step + 1, step // 2):
        index.setdefault(source[i : i + step], i)
    blocks: list[tuple[int, int, int, int]] = []  # place in the target, place in the source, length of differences, end of new bytes
    new, at, n = 0, 0, len(target)
    while at + step <= n:
        origin = index.get(target[at : at + step])
        if origin is None:
            at += 1
            continue
        while at > new and origin > 0 and target[at - 1] == source[origin - 1]:
            at, origin = at - 1, origin - 1
        room = min(n - at, len(source) - origin)
        same = np.frombuffer(target, np.uint8, room, at) == np.frombuffer(source, np.uint8, room, origin)
        gain = np.cumsum(np.where(same, 1, -3))
        stop = np.flatnonzero(gain < np.maximum.accumulate(gain) - 64)
        length = int(gain[: stop[0] if len(stop) else room].argmax()) + 1
        blocks.append((at, origin, length, new))
        at += length
        new = at
    out, place = bytearray(), 0
    first = blocks[0][0] if blocks else n
    out += offtin(0) + offtin(first) + offtin((blocks[0][1] if blocks else 0) - place) + target[:first] if first else b""
    if blocks and not first and blocks[0][1]:
        out += offtin(0) + offtin(0) + offtin(blocks[0][1])
    for i, (start, origin, length, _) in enumerate(blocks):
        end = blocks[i + 1][0] if i + 1 < len(blocks) else n
        seek = blocks[i + 1][1] - (origin + length) if i + 1 < len(blocks) else 0
        delta = (np.frombuffer(target, np.uint8, length, start) - np.frombuffer(source, np.uint8, length, origin)).tobytes()
        out += offtin(length) + offtin(end - start - length) + offtin(seek) + delta + target[start + length : end]
    return bytes(out)


def bspatch(source: bytes, patch: bytes, size: int) -> bytes:
    """Rebuilds `size` bytes; a patch that leaves its bounds is an error."""
    out, at, place = bytearray(), 0, 0
    while len(out) < size:
        if at + 24 > len(patch):
            raise ValueError("a patch that ends too early")
        diff, extra, seek = (read_offtin(patch[at + 8 * i : at + 8 * i + 8]) for i in range(3))
        at += 24
        if diff < 0 or extra < 0 or at + diff + extra > len(patch) or len(out) + diff + extra > size or place < 0 or place + diff > len(source):
            raise ValueError("a patch that leaves its bounds")
        out += (np.frombuffer(patch, np.uint8, diff, at) + np.frombuffer(source, np.uint8, diff, place)).tobytes() + patch[at + diff : at + diff + extra]
        at += diff + extra
        place += diff + seek
    if at != len(patch):
        raise ValueError("bytes behind a patch")
    return bytes(out)


def worth_it(patch: bytes, size: int) -> bool:
    """A patch is kept if twice its bytes other than zero are less than the object."""
    return 2 * (len(patch) - patch.count(0)) < size


def write_part(objects: list[tuple[bytes, bytes, bytes | None, bytes | None]], mode: int = 0o100644) -> tuple[bytes, bytes, list[int]]:
    """(opcodes, blob, modes) that make regular files (checksum, payload, source's checksum, source): copies where chunks agree, a patch where it pays, else the whole."""
    ops, blob = bytearray(), bytearray()

    def put(data: bytes) -> bytes:
        blob.extend(data)
        return varint(len(data)) + varint(len(blob) - len(data))

    for _, payload, name, source in objects:
        runs = plan_runs(source, payload) if source is not None else []
        if any(origin is not None for _, _, origin in runs):
            ops += b"o" + varint(0) + varint(0) + varint(len(payload))
            for start, length, origin in runs:
                if origin is None:
                    ops += b"w" + put(payload[start : start + length])
                else:
                    blob.extend(name)
                    ops += b"r" + varint(len(blob) - 32) + b"w" + varint(length) + varint(origin) + b"R"
            ops += b"c"
            continue
        patch = bsdiff(source, payload) if source is not None and payload else b""
        if patch and worth_it(patch, len(payload)):
            blob.extend(name)
            ops += b"o" + varint(0) + varint(0) + varint(len(payload)) + b"r" + varint(len(blob) - 32)
            blob.extend(patch)
            ops += b"B" + varint(len(blob) - len(patch)) + varint(len(patch)) + b"Rc"
        else:
            ops += b"S" + varint(0) + varint(0) + put(payload)
    return bytes(ops), bytes(blob), [mode]


def run_opcodes(ops: bytes, blob: bytes, sources: dict[bytes, bytes], expected: list[tuple[int, bytes]], check) -> list[bytes]:
    """The objects that a part's opcode stream makes; expected names them as (type, checksum), type 1 is content.

    S makes one whole (a content object's mode and attribute places, length, offset), o opens one (places, size), w writes from the source that r set
    or from the blob, R leaves the source, B patches it, c closes. check(type, payload) is the checksum that each object must have.
    """
    out, at, now, size, source = [], 0, None, 0, None

    def operands(n: int) -> list[int]:
        nonlocal at
        found = []
        for _ in range(n):
            value, at = read_varint(ops, at)
            found.append(value)
        return found

    def piece(of: bytes, offset: int, length: int) -> bytes:
        if offset + length > len(of):
            raise ValueError("an operand that leaves its bytes")
        return of[offset : offset + length]

    def close(payload: bytes) -> None:
        if len(out) >= len(expected) or check(expected[len(out)][0], payload) != expected[len(out)][1]:
            raise ValueError("an object of another checksum")
        out.append(payload)

    while at < len(ops):
        op, at = ops[at : at + 1], at + 1
        if op == b"S":
            content = len(out) < len(expected) and expected[len(out)][0] == 1
            *_, length, offset = operands(4 if content else 2)
            close(piece(blob, offset, length))
        elif op == b"o" and now is None:
            _, _, size = operands(3)
            now = bytearray()
        elif op == b"w" and now is not None:
            length, offset = operands(2)
            now += piece(blob if source is None else source, offset, length)
        elif op == b"r":
            (offset,) = operands(1)
            source = sources[piece(blob, offset, 32)]
        elif op == b"R":
            source = None
        elif op == b"B" and now is not None and source is not None:
            offset, length = operands(2)
            now += bspatch(source, piece(blob, offset, length), size)
        elif op == b"c" and now is not None:
            if len(now) != size:
                raise ValueError("an object of another size")
            close(bytes(now))
            now = None
        else:
            raise ValueError(f"opcode {op!r} has no place here")
    if now is not None or len(out) != len(expected):
        raise ValueError("a part that ends too early")
    return out


def reindex(deltas: DataFrame) -> DataFrame:
    """(dst, entries) of deltas (src, dst, digest): for each target the deltas that lead to it, sorted by name (a delta from nothing is named by its target alone), with their digests."""
    name = F.concat_ws("-", "src", "dst")
    return deltas.groupBy("dst").agg(F.array_sort(F.collect_list(F.struct(name.alias("name"), "digest"))).alias("entries"))


def build_parts(objects: DataFrame, most: int, by: str = "delta") -> DataFrame:
    """(by, part, objects, ops, blob, names) of objects (by, checksum, payload, source): packed greedily and written as parts. A part is at most one object beyond the limit, so it fits in a task."""
    sized = objects.select(by, F.lit(1).alias("otype"), "checksum", F.coalesce(F.length("payload"), F.lit(0)).alias("size"))
    placed = pack_parts(sized, most, by).select(by, "checksum", "part")
    kind = objects.schema[by].dataType.simpleString()

    def build(pdf):
        pdf = pdf.sort_values("checksum")
        rows = [(b"", bytes(new), hashlib.sha256(old).digest() if old else None, bytes(old) if old else None) for new, old in zip(pdf["payload"], pdf["source"], strict=True)]
        ops, blob, _ = write_part(rows)
        return pdf.iloc[:1][[by, "part"]].assign(objects=len(pdf), ops=[ops], blob=[blob], names=[pdf["checksum"].tolist()])

    whole = objects.where("payload is not null").join(placed, [by, "checksum"])
    return whole.groupBy(by, "part").applyInPandas(build, f"{by} {kind}, part long, objects long, ops binary, blob binary, names array<string>")
