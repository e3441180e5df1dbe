"""SentencePiece (BPE) encoding and decoding, with a parallel scan over chunks of giant documents.

Most documents are encoded in segments: no piece has a space mark behind another character, so nothing merges across the start of a
run of spaces, and each distinct segment is encoded once. A giant document is cut into chunks that any executor takes.

The scan rests on a fact about merging by priority: a sequence of pieces is the encoding of its text exactly if each two
neighbours are the encoding of theirs. So the encoding is the one path through the lattice of pieces whose neighbours all
agree, a max-plus problem with weights 0 and minus infinity. The state at a chunk border is the piece that holds the last
character before it. A chunk's transfer matrix says which state at its start can lead to which at its
end; matrices are combined associatively from both ends, which leaves one state at each border, and each chunk then
finds its own path. Borders are moved to the start of a word where one is near; the matrix is 1 x 1 there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, maybe_broadcast

MARK = "▁"
#: A segment: spaces and what follows them, or a line end and what follows it.
SEGMENT = re.compile(r" +[^ \n]*|\n[^ \n]*")


@dataclass(frozen=True)
class Params:
    giant: int = 65_536  # characters from which a document is cut into chunks
    chunk: int = 16_384
    near: int = 512  # characters that a border may move to meet the start of a word


class Pieces:
    """The model file's pieces: exact encoding, the lattice of a text, decoding."""

    def __init__(self, path: str, kept: int = 150_000):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        names = [self.sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i))]
        self.rank = {names[i]: self.sp.get_score(i) for i in plain}
        self.id = {names[i]: i for i in plain}
        self.byte = [self.sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.id))
        self.raw = [b""] * n
        for i in plain:
            self.raw[i] = names[i].replace(MARK, " ").encode()
        for b, i in enumerate(self.byte):
            self.raw[i] = bytes([b])
        self.kept, self.new, self.old, self.agreed = kept, {}, {}, {}

    # encoding by segments

    def _segment(self, segment: str) -> bytes:
        found = self.old.get(segment)
        if found is None:
            # the library puts a space mark in front; a line end keeps that mark to itself
            ids = self.sp.encode(segment[1:]) if segment[0] == " " and len(segment) > 1 else self.sp.encode(segment)[1:] if segment[0] == "\n" else [self.id[MARK]]
            found = np.array(ids, "<u4").tobytes()
        if len(self.new) >= self.kept:
            self.old, self.new = self.new, {}
        self.new[segment] = found
        return found

    def spaced(self, text: str) -> bytes:
        """Ids of a text that starts with a space or a line end, which stands for itself."""
        get, make = self.new.get, self._segment
        return b"".join([get(s) or make(s) for s in SEGMENT.findall(text)])

    def encode(self, text: str | None) -> bytes:
        """Little-endian uint32 ids of the whole text, as the library gives them."""
        return self.spaced(" " + text.replace(MARK, " ")) if text else b""

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return raw[1:] if raw[:1] == " " else raw

    # the lattice

    def merge(self, text: str) -> list[str]:
        """Merging by priority, leftmost first, of a short text."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r > best):
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def agree(self, left: str, right: str) -> bool:
        key = (left, right)
        found = self.agreed.get(key)
        if found is None:
            if len(self.agreed) > 200_000:
                self.agreed.clear()
            found = self.agreed[key] = self.merge(left + right) == [left, right]
        return found

    def ends(self, text: str, start: int, stop: int) -> list[int]:
        """Where pieces that start here can end; an unknown character is a piece of its own."""
        out = [start + 1]
        out += [e for e in range(start + 2, min(stop, start + self.longest) + 1) if text[start:e] in self.id]
        return out

    def states(self, text: str, border: int) -> list[tuple[int, int]]:
        """Pieces that hold the character before the border, as (start, end)."""
        if border <= 0 or border >= len(text) or self.hard(text, border):
            return [(border, border)]
        return [(s, e) for s in range(max(0, border - self.longest), border) for e in self.ends(text, s, len(text)) if e >= border]

    def hard(self, text: str, at: int) -> bool:
        """Whether nothing merges across this place."""
        a, b = text[at - 1], text[at]
        return b == MARK and a != MARK or a not in self.id or b not in self.id

    def paths(self, text: str, begin: int, end: int, into: list[tuple[int, int]], out: list[tuple[int, int]]) -> dict:
        """piece -> (bits of the states of `into` that reach it, pieces before it), for pieces from one border on to the next."""
        reach: dict[tuple[int, int], list] = {}
        by_end: dict[int, list[tuple[int, int]]] = {}
        for i, s in enumerate(into):
            reach[s] = [1 << i, []]
            by_end.setdefault(s[1], []).append(s)
        last = max(e for _, e in out)
        for at in range(begin, end):
            before = by_end.pop(at, None)
            if not before:
                continue
            for e in self.ends(text, at, min(len(text), max(end, last))):
                if e < end or (at, e) in out or (e == end and (end, end) in out):
                    word, bits, prior = text[at:e], 0, []
                    for p in before:
                        if p[0] == p[1] or self.agree(text[p[0] : p[1]], word):
                            bits |= reach[p][0]
                            prior.append(p)
                    if bits:
                        known = reach.get((at, e))
                        if known is None:
                            reach[at, e] = [bits, prior]
                            by_end.setdefault(e, []).append((at, e))
        if (end, end) in out:
            prior = [p for p in by_end.get(end, []) if p != (end, end)]
            bits = 0
            for p in prior:
                bits |= reach[p][0]
            reach[end, end] = [bits, prior] if begin != end else reach.get((end, end), [0, []])
        return reach

    def first_hard(self, text: str, begin: int, end: int) -> int:
        return next((i for i in range(max(begin, 1), min(end, len(text) - 1) + 1) if self.hard(text, i)), -1)

    def last_hard(self, text: str, begin: int, end: int) -> int:
        return next((i for i in range(min(end, len(text) - 1), max(begin, 1) - 1, -1) if self.hard(text, i)), -1)

    def matrix(self, text: str, begin: int, end: int) -> np.ndarray:
        """Which state at the chunk's start can lead to which at its end. Behind a place that nothing crosses, only its two edges matter."""
        into, out = self.states(text, begin), self.states(text, end)
        a, b = self.first_hard(text, begin, end), self.last_hard(text, begin, end)
        if a < 0:
            reach = self.paths(text, begin, end, into, out)
            return np.array([[reach.get(o, [0])[0] >> i & 1 for o in out] for i in range(len(into))], bool)
        left = self.paths(text, begin, a, into, [(a, a)])[a, a][0] if into != [(a, a)] else 1
        right = self.paths(text, b, end, [(b, b)], out) if out != [(b, b)] else {(b, b): [1]}
        return np.array([[bool(left >> i & 1 and right.get(o, [0])[0]) for o in out] for i in range(len(into))], bool)

    def _walk(self, text: str, begin: int, end: int, start: tuple[int, int], stop: tuple[int, int]) -> list[str]:
        """The pieces after `start` up to and with `stop`."""
        reach, out, now = self.paths(text, begin, end, [start], [stop]), [], stop
        while now != start:
            if now[0] != now[1]:
                out.append(text[now[0] : now[1]])
            now = next(p for p in reach[now][1] if reach[p][0])
        return out[::-1]

    def _ids(self, parts: list[str]) -> bytes:
        out: list[int] = []
        for x in parts:
            i = self.id.get(x)
            out += [i] if i is not None else [self.byte[b] for b in x.encode("utf-8", "surrogatepass")]
        return np.array(out, "<u4").tobytes()

    def backtrace(self, text: str, begin: int, end: int, start: tuple[int, int], stop: tuple[int, int]) -> bytes:
        """Ids of the pieces behind the chunk's start state, its end state included. Texts between hard places go the usual way."""
        a, b = self.first_hard(text, begin, end), self.last_hard(text, begin, end)
        if a < 0:
            return self._ids(self._walk(text, begin, end, start, stop))
        out = self._ids(self._walk(text, begin, a, start, (a, a))) if start != (a, a) else b""
        i = a
        while i < b and text[i] not in (MARK, "\n"):  # up to a place from which the segments' way works
            j = self.first_hard(text, i + 1, b)
            out += self._ids(self.merge(text[i:j]))
            i = j
        out += self.spaced(text[i:b].replace(MARK, " ")) if i < b else b""
        return out + (self._ids(self._walk(text, b, end, (b, b), stop)) if stop != (b, b) else b"")


@lru_cache(maxsize=2)
def loaded(path: str) -> Pieces:
    """One table for each worker process: later tasks find it and its segments."""
    return Pieces(path)


def borders(pieces: Pieces, text: str, p: Params) -> list[int]:
    """Chunk borders of a marked text: near each multiple of the chunk the next start of a word, else the multiple itself."""
    out, at = [0], p.chunk
    while at < len(text):
        hard = next((i for i in range(at, min(at + p.near, len(text))) if text[i] == MARK and text[i - 1] != MARK), at)
        out.append(hard)
        at = hard + p.chunk
    return [*out, len(text)]


def _split(path: str, p: Params):
    """(row, doc, chunk, chunks, text, begin, end): whole documents as one chunk, giant ones cut, with the context that border pieces need."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, row = loaded(path), TaskContext.get().partitionId() << 33
        names = ["row", "doc", "chunk", "chunks", "text", "begin", "end"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
        for b in batches:
            out = []
            for doc, value in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = MARK + value.as_py().replace(" ", MARK)
                at, margin = borders(pieces, text, p), 2 * pieces.longest
                for i, (begin, end) in enumerate(zip(at, at[1:], strict=False)):
                    low = max(0, begin - margin)
                    out.append((row, doc, i, len(at) - 1, text[low : end + margin], begin - low, end - low))
                row += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return rows


def _matrices(path: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(path)
        for b in batches:
            made = [pieces.matrix(t.as_py(), x.as_py(), y.as_py()) for t, x, y in zip(b.column(4), b.column(5), b.column(6), strict=True)]
            cols = [pa.array([m.shape[0] for m in made], pa.int32()), pa.array([np.packbits(m).tobytes() for m in made], pa.binary()), pa.array([m.shape[1] for m in made], pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *cols], ["row", "chunk", "into", "bits", "out"])

    return rows


def _scan(pdf: pd.DataFrame) -> pd.DataFrame:
    """One document's matrices, tens of bytes a chunk: the state at each border that both its ends can reach."""
    pdf = pdf.sort_values("chunk")
    made = [np.unpackbits(np.frombuffer(r.bits, np.uint8), count=r.into * r.out).reshape(r.into, r.out).astype(bool) for r in pdf.itertuples()]
    ahead, back = [np.ones(1, bool)], [np.ones(1, bool)]
    for m in made:
        ahead.append(ahead[-1] @ m)
    for m in reversed(made):
        back.append(m @ back[-1])
    states = [int(np.argmax(a & b)) for a, b in zip(ahead, reversed(back), strict=True)]
    return pd.DataFrame({"row": pdf["row"].to_numpy(), "chunk": pdf["chunk"].to_numpy(), "start": states[:-1], "stop": states[1:]})


def _backtraces(path: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(path)
        for b in batches:
            ids = []
            for text, begin, end, start, stop in zip(*[b.column(i).to_pylist() for i in range(3, 8)], strict=True):
                ids.append(pieces.backtrace(text, begin, end, pieces.states(text, begin)[start], pieces.states(text, end)[stop]))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(ids, pa.binary())], ["row", "doc", "chunk", "ids"])

    return rows


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:
    """(doc_id, ids): little-endian uint32 piece ids of every whole text, equal to the library's. Null and empty texts have none.

    Rows with null or repeated ids are encoded one by one; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pieces.encode(t.as_py()) for t in b.column(1)], pa.binary())], ["doc_id", "ids"])

    short = F.coalesce(F.length("text"), F.lit(0)) < p.giant
    whole = docs.where(short).mapInArrow(small, "doc_id long, ids binary")
    chunks = cut(docs.where(~short).mapInArrow(_split(model, p), "row long, doc long, chunk int, chunks int, text string, begin int, end int"))
    # the chunks of one document go to many tasks, which small partitions by size would undo
    chunks = chunks.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row", "chunk")
    matrices = chunks.mapInArrow(_matrices(model), "row long, chunk int, into int, bits binary, out int")
    states = cut(matrices.groupBy("row").applyInPandas(_scan, "row long, chunk int, start int, stop int"))
    placed = chunks.join(maybe_broadcast(states, states.count()), ["row", "chunk"]).select("row", "doc", "chunk", "text", "begin", "end", "start", "stop")
    traced = placed.mapInArrow(_backtraces(model), "row long, doc long, chunk int, ids binary")
    joined = F.transform(F.sort_array(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"])
    giant = traced.groupBy("row").agg(F.first("doc").alias("doc_id"), joined.alias("parts"))
    # joined in one step: appending part by part would copy what there is each time
    return whole.union(giant.select("doc_id", F.unhex(F.array_join(F.transform("parts", lambda x: F.hex(x)), ""))))


def decode(encoded: DataFrame, model: str, ids_col: str = "ids", name: str = "text") -> DataFrame:
    """The input's columns, with the text that the ids stand for in place of the ids. Null ids give a null text."""
    keep = [c for c in encoded.columns if c not in (ids_col, name)]
    kept = encoded.select(*[F.col(f"`{c}`") for c in keep])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        for b in batches:
            texts = [None if x.as_py() is None else pieces.decode(x.as_py()) for x in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*keep, name])

    schema = StructType([*kept.schema.fields, *StructType.fromDDL(f"`{name}` string").fields])
    return encoded.select(*[F.col(f"`{c}`") for c in [*keep, ids_col]]).mapInArrow(rows, schema)

