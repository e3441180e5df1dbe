"""Fast exact ids of a word-level byte BPE whose tokens mark word ends (a tokenizers JSON file).

A document's ids are the ids of its white-space separated words, so each word is encoded once and kept
as little-endian bytes. Words of plain letters go through a rank table; any other word through the tokenizer itself.
"""

from __future__ import annotations

import json
import re

import tiktoken
from tokenizers import Tokenizer

END = "</w>"
#: The tokenizer's own splitting rule, for words of PLAIN characters.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\s\w]|_)+")
#: Composed letters whose lower case doesn't depend on their neighbours.
PLAIN = re.compile("[!-~À-įı-ƿ]+")


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, by the usual rule: printable bytes stand for themselves, the rest from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordIds(dict):
    """word (bytes) -> ids (little-endian uint32 bytes). Two generations of at most `kept` words each."""

    def __init__(self, path: str, kept: int = 400_000):
        self.kept, self.old, self.pieces = kept, {}, {}
        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of, vocab = _byte_of(), spec["model"]["vocab"]
        as_bytes = lambda t: bytes(byte_of[c] for c in t.removesuffix(END)) + b"\xff" * t.endswith(END)
        ranks = {bytes([b]): b for b in range(256)}
        ranks |= {bytes([b, 255]): 256 + b for b in range(256)}  # a word's last byte joins its end mark before any merge
        for merge in spec["model"]["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            ranks.setdefault(as_bytes(left) + as_bytes(right), len(ranks))
        self.ids = [b""] * len(ranks)
        for token, i in vocab.items():
            if not token.startswith("<|"):
                self.ids[ranks[as_bytes(token)]] = i.to_bytes(4, "little")
        self.fast = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, word: bytes) -> bytes:
        found = self.old.get(word)
        if found is None:
            text = word.decode("utf-8", "replace")
            if PLAIN.fullmatch(text) and "<|" not in text:
                found = b"".join([self.pieces.get(x) or self._piece(x) for x in PIECES.findall(text.lower())])
            else:
                found = b"".join([i.to_bytes(4, "little") for i in self.slow.encode(text, add_special_tokens=False).ids])
        if len(self) >= self.kept:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found

    def _piece(self, piece: str) -> bytes:
        if len(self.pieces) >= self.kept:
            self.pieces.clear()
        self.pieces[piece] = found = b"".join([self.ids[i] for i in self.fast(piece.encode() + b"\xff")])
        return found

    def document(self, text: str | None) -> bytes:
        if not text:
            return b""
        return b"".join(map(self.__getitem__, text.encode("utf-8", "replace").split()))
