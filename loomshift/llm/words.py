"""Words of many texts at once, as 64-bit hashes in numpy.

A word is a run of letters, digits and characters beyond ASCII, in lower case. All bytes of a block of texts are handled
together: the hash of a word is a difference of running sums of (byte value x power of a base), shifted to the word's start
by the inverse power, all modulo 2**64.
"""

from __future__ import annotations

import numpy as np

from loomshift.llm.shared import mix64

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_VALUE = mix64(np.arange(1, 257))
_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the base, or of its inverse, modulo 2**64."""
    base = _INVERSE if inverse else _BASE
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 21), base, np.uint64)
        held[0] = 1
        held = _POWERS[base] = np.multiply.accumulate(held)
    return held[:n]


def hashed(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each run of bytes."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * powers(len(data)), out=total[1:])
    return mix64((total[end] - total[begin]) * powers(len(data), inverse=True)[begin])


def words(texts: list[str], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and the places where each text's words begin (one more than texts)."""
    raw = [(t.lower() if lower else t).encode("utf-8", "surrogatepass") for t in texts]
    starts_at = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=starts_at[1:])
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    edge = np.diff(np.concatenate([[0], _WORD_BYTE[data].view(np.int8), [0]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return hashed(data, begin, end), np.searchsorted(begin, starts_at)


_STEP = np.uint64(0xD6E8FEB86659FD93)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n words; run i starts at word i."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:size].copy()
    for j in range(1, n):
        out = out * _STEP + hashes[j : j + size]
    return mix64(out)
