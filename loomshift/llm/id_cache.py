"""Ids of the words of a block of texts: each distinct word is worked out once, and kept by its 64-bit hash.

The store is a few sorted numpy arrays of bounded size, so that a million words cost no Python objects. Words are told
apart by their hash and length; callers keep words beyond a few dozen bytes out, where sums modulo 2**64 could be made to meet.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct keys, the first place found of each, and each key's place among them."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return ranked[new], order[new], place


def runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of all runs, one run after another."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class IdCache:
    """Sorted hashes with the run of ids of each, in one flat array: a large part and a small one, to which new words go.

    Beyond `most` words it starts anew, which changes speed only.
    """

    SMALL = 1 << 16

    def __init__(self, most: int) -> None:
        self.most = most
        self.clear()

    def clear(self) -> None:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.parts = [none, none]  # hashes, begins and sizes
        self.flat = np.zeros(0, np.uint32)
        self.used = 0

    def _add(self, keys: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], flat, np.zeros(len(flat) + self.used // 2, np.uint32)])
        else:
            self.flat[self.used : self.used + len(flat)] = flat
        new = keys, self.used + np.cumsum(size) - size, size.astype(np.int32)
        self.used += len(flat)
        into = 1 if len(self.parts[1][0]) + len(keys) <= self.SMALL else 0
        held = [np.concatenate(x) for x in zip(*self.parts[into:], new, strict=True)]
        order = np.argsort(held[0])
        self.parts[into] = tuple(x[order] for x in held)
        if not into:
            self.parts[1] = tuple(x[:0] for x in new)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begins and sizes; a size of -1: not known."""
        begin, size = np.zeros(len(keys), np.int64), np.full(len(keys), -1, np.int64)
        for own, begins, sizes in self.parts:
            if len(own):
                at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
                hit = own[at] == keys
                begin[hit], size[hit] = begins[at[hit]], sizes[at[hit]]
        return begin, size

    def ids(self, keys: np.ndarray, learn: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in order, and how many each has. learn(places) gives (places in its own order, sizes, flat ids) of words not known."""
        if not len(keys):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        known, first, place = distinct(keys)
        begin, size = self._find(known)
        if (size < 0).any():
            if sum(len(p[0]) for p in self.parts) + int((size < 0).sum()) > self.most:
                self.clear()
                size[:] = -1
            where, n, flat = learn(first[size < 0])
            self._add(keys[where], n, flat)
            begin, size = self._find(known)
        begin, size = begin[place], size[place]
        return self.flat[runs(begin, size)], size
