"""Words of many texts at once, as numpy arrays of code points, spans and hashes."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
TABLE = 0x30000
_made: dict = {}


class Words(NamedTuple):
    """``doc[i]``, ``start[i]``, ``end[i]`` place word i in ``codes``; ``sums`` are running hash sums."""

    codes: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    sums: np.ndarray
    n_docs: int

    def hash(self, end: np.ndarray | None = None) -> np.ndarray:
        """64-bit hash of every word, or of its part before ``end``."""
        end = self.end if end is None else end
        return mix((self.sums[end] - self.sums[self.start]) * powers(len(self.codes))[1][self.start])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_made.get("powers", ((), ()))[0]) <= n:
        size = max(n + 1, 1 << 20)
        out = []
        for base in (BASE, INVERSE):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            out.append(np.cumprod(x, dtype=np.uint64))
        _made["powers"] = tuple(out)
    return _made["powers"]


def letter_table(digits: bool, size: int = TABLE) -> np.ndarray:
    """Which code points below ``size`` belong to words: letters, or letters and digits."""
    key = ("letters", digits, size)
    if key not in _made:
        test = str.isalnum if digits else str.isalpha
        _made[key] = np.fromiter((test(chr(i)) for i in range(size)), bool, size)
    return _made[key]


def lower(text: str) -> str:
    """Lower case with every character in its place."""
    out = text.lower()
    return out if len(out) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def split(texts: list[str], digits: bool = False, size: int = TABLE) -> Words:
    """Lower-cased runs of letters (and digits) of all texts; code points from ``size`` on separate."""
    lowered = [lower(t) for t in texts]
    codes = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered)))
    inside = letter_table(digits, size)[np.minimum(codes, size - 1)]
    step = np.diff(inside.view(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    sums = np.empty(len(codes) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(codes * powers(len(codes))[0][: len(codes)], dtype=np.uint64, out=sums[1:])
    return Words(codes, np.searchsorted(ends, start, "right"), start, end, sums, len(texts))


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of every run of ``n`` words."""
    count = len(words.start) - n + 1
    if count <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    hashes = words.hash()
    total = np.zeros(count, np.uint64)
    for k in range(n):
        total = mix(total + hashes[k : k + count])
    same = words.doc[:count] == words.doc[n - 1 :]
    return words.doc[:count][same], total[same]
