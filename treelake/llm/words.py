"""64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of a text with A-Z in lower case, without a Python step for each word."""

from __future__ import annotations

import numpy as np

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A random number for each byte, the same for both cases of A-Z, and 0 for white space.
VALUE = mix(np.arange(1, 257, dtype=np.uint64) * M1)
VALUE[65:91] = VALUE[97:123]
VALUE[SPACE] = 0
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    step = np.uint64(base)
    while len(out) < n:
        out = np.concatenate([out, out * step])
        step = step * step
    return out


class Words:
    """Polynomial hashes by prefix sums: (sum of VALUE[byte] * BASE**i) / BASE**start, then mixed. Tables grow with the longest text."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        return self.spans(text)[0]

    def spans(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, UTF-8 bytes, first byte and byte after the last of each word)."""
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) if text else np.empty(0, np.uint8)
        n = len(data)
        if not n:
            return np.empty(0, np.uint64), data, np.empty(0, np.int64), np.empty(0, np.int64)
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                self.up, self.down = _powers(BASE, n), _powers(INVERSE, n)
        inside = np.zeros(n + 2, np.int8)
        inside[1:-1] = ~SPACE[data]
        change = np.diff(inside)
        start, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(VALUE[data] * self.up[:n], out=total[1:])
        return mix((total[end] - total[start]) * self.down[start] + (end - start).astype(np.uint64)), data, start, end
