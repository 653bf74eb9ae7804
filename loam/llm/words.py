"""Hashes of words and of spans of words, for whole chunks of texts at a time.

Words are maximal runs of bytes other than ASCII white space. The hash of a word is a
polynomial of its bytes modulo 2**64, that of a span a polynomial of its words' hashes;
running sums give those of all words, or spans, of a chunk in a few numpy operations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes and words of a chunk whose powers are kept.
SEGMENT, CHUNK_WORDS = 1 << 18, 200_000
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_BYTE_BASE = 0x9FB21C651E98DF25
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOWER_CODE = _CODE.copy()
_LOWER_CODE[65:91] = _CODE[97:123]


def _power(base: int, n: int, least: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, kept for each Python worker."""
    held = _powers.get(base)
    if held is None or len(held) <= n:
        held = np.full(max(n + 1, least), base, np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if len(held) <= 2 * least:  # those of an unusually long text are not kept
            _powers[base] = held
    return held


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 texts of a string column; null: empty."""
    return [t or b"" for t in column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


def _bounds(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, where words begin and end, and each text's number of words."""
    raw = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    space = _SPACE[raw]
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    after = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    return raw, start, end, np.diff(np.searchsorted(start, after, side="right"), prepend=0)


def _hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    code = _LOWER_CODE if lower else _CODE
    out = np.empty(len(start), np.uint64)
    inverse = pow(_BYTE_BASE, -1, 1 << 64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + SEGMENT, side="right")))
        s, e = int(start[i]), int(end[j - 1])
        sums = np.zeros(e - s + 1, np.uint64)
        np.cumsum(code[raw[s:e]] * _power(_BYTE_BASE, e - s, SEGMENT + 1)[: e - s], out=sums[1:])
        out[i:j] = mix((sums[end[i:j] - s] - sums[start[i:j] - s]) * _power(inverse, e - s, SEGMENT + 1)[start[i:j] - s])
        i = j
    return out


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of some texts, one text after the other, and each text's
    number of words; ``lower``: A-Z count as a-z."""
    raw, start, end, counts = _bounds(texts)
    return _hashes(raw, start, end, lower), counts


def words_and_endings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``word_hashes`` in lower case, and a hash of each word's last three bytes."""
    raw, start, end, counts = _bounds(texts)
    low = raw | ((raw >= 65) & (raw < 91)) * np.uint8(32)
    last = low[end - 1].astype(np.uint64)
    for back in (2, 3):
        inside = end - back >= start
        last = last * np.uint64(256) + np.where(inside, low[np.maximum(end - back, 0)], 0).astype(np.uint64)
    return _hashes(raw, start, end, True), mix(last), counts


class Hasher:
    """Hashes of any span of some words, in up to two independent lanes."""

    def __init__(self, words: np.ndarray, lanes: int = 2):
        self.sums, self.inverse = [], []
        for lane, base in enumerate(_BASES[:lanes]):
            w = words if lane == 0 else mix(words ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            s = np.zeros(len(w) + 1, np.uint64)
            np.cumsum(w * _power(int(base), len(w), CHUNK_WORDS)[: len(w)], out=s[1:])
            self.sums.append(s)
            self.inverse.append(_power(pow(int(base), -1, 1 << 64), len(w), CHUNK_WORDS))

    def spans(self, start: np.ndarray, end: np.ndarray, lane: int) -> np.ndarray:
        s = self.sums[lane]
        return mix((s[end] - s[start]) * self.inverse[lane][start])
