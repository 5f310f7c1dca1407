"""Ids of a lower-casing byte-pair tokenizer whose words carry an end mark, for many texts at once.

A block of texts is one array of bytes. Its words (runs of letters, single digits, runs of marks, contractions) are found and
hashed there; the ids of words met before come from a bounded cache, and new ones are merged together: at each step every
word merges the pair that the tokenizer ranks first. Texts with characters whose normalisation differs between Unicode
libraries, or with the names of special tokens, go to `tokenizers` whole, so that all ids are those of that library.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from loomshift.llm.id_cache import IdCache
from loomshift.llm.shared import by_bytes
from loomshift.llm.words import hashed

#: Words kept; beyond them the cache starts anew, which changes speed only.
MOST_CACHED = 1_000_000
#: Bytes of a word up to which it is merged in numpy.
MOST_BYTES = 48
#: Latin letters, common punctuation and ASCII: no combining marks, no numerals but ASCII digits, one lower case each.
_ODD = re.compile("[^\t-\r\x20-\x7e\x85\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ȹȻ-Ƚȿ-ɏ‐-‧€]")
#: Bytes of a block of texts.
BLOCK = 1_500_000
SPACE, LETTER, DIGIT, MARK = range(4)
#: Widths to which words are filled up, so that few groups are merged.
_WIDTHS = (4, 8, 12, 16, 24, 32, MOST_BYTES)


def _kind(c: str) -> int:
    return SPACE if c.isspace() else LETTER if c.isalpha() else DIGIT if c.isdigit() else MARK


_KIND = np.array([_kind(chr(c)) for c in range(0x300)], np.uint8)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable, else the next of those from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    odd = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(odd)) for b in range(256)]


class WordBPE:
    """encode(texts) gives the ids of all texts in one array, and where each text's begin."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.special = tuple(x["content"] for x in model["added_tokens"])
        vocab, end = model["model"]["vocab"], model["model"]["end_of_word_suffix"]
        letters = _byte_letters()
        self.first = np.array([vocab[x] for x in letters], np.int32)
        self.last = np.array([vocab[x + end] for x in letters], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        keys = np.array([vocab[a] << 17 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.tables = self._tables(keys, np.arange(len(keys)))
        self.made = np.append(made, np.int32(0))
        self.cache = IdCache(MOST_CACHED)

    @staticmethod
    def _slot(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * level)) >> np.uint64(64 - bits)).astype(np.int64)

    def _tables(self, keys: np.ndarray, ranks: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Hash tables of (key, rank); keys that meet in one go on to the next, smaller one."""
        out = []
        while len(keys):
            bits = max(8, int(len(keys)).bit_length() + 4)
            slot = self._slot(keys, len(out), bits)
            _, first = np.unique(slot, return_index=True)
            held, rank = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
            held[slot[first]], rank[slot[first]] = keys[first], ranks[first]
            out.append((bits, held, rank))
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, ranks = keys[left], ranks[left]
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys, none = left.astype(np.int64) << 17 | right, len(self.made) - 1
        out = np.full(len(keys), none, np.int32)
        for level, (bits, held, rank) in enumerate(self.tables):
            slot = self._slot(keys, level, bits)
            hit = held[slot] == keys
            out[hit] = rank[slot[hit]]
        return out

    def _merge(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words (rows of bytes, each of its own size), one row each, and how many each has."""
        n, size = raw.shape
        ids, row = self.first[raw], np.arange(n)
        ids[row, sizes - 1] = self.last[raw[row, sizes - 1]]
        lengths, none = sizes.copy(), len(self.made) - 1
        column = np.arange(size)
        rank = self._ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, size - 1)
        rank[column[None, 1:] >= sizes[:, None]] = none
        live = np.flatnonzero(sizes > 1)
        while len(live):
            at = rank[live].argmin(1)
            best = rank[live, at]
            go = best < none
            live, at, best = live[go], at[go], best[go]
            if not len(live):
                break
            rows = ids[live]
            rows[np.arange(len(live)), at] = self.made[best]
            moved = np.minimum(column + (column[None, :] > at[:, None]), size - 1)
            ids[live] = np.take_along_axis(rows, moved, 1)
            lengths[live] -= 1
            ranks = np.take_along_axis(rank[live], np.minimum(moved[:, : size - 1], size - 2), 1)
            ranks[column[None, : size - 1] >= (lengths[live] - 1)[:, None]] = none
            for side in (at - 1, at):
                ok = (side >= 0) & (side < lengths[live] - 1)
                ranks[ok, side[ok]] = self._ranks(ids[live[ok], side[ok]], ids[live[ok], side[ok] + 1])
            rank[live] = ranks
        return ids, lengths

    @staticmethod
    def _cut(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends of the words of a block that ends with white space."""
        kind = _KIND[data]  # of bytes that are characters by themselves
        lead = np.flatnonzero(data >= 0xC2)
        if len(lead):
            short = lead[data[lead] < 0xE0]
            kind[short] = kind[short + 1] = _KIND[(data[short].astype(np.int64) & 31) << 6 | data[short + 1] & 63]
            long = lead[data[lead] >= 0xE0]  # of three bytes there are marks only
            kind[long] = kind[long + 1] = kind[long + 2] = MARK
        before = np.concatenate([[SPACE], kind[:-1]])
        start = (kind != SPACE) & ((kind != before) | (kind == DIGIT))
        quote = np.flatnonzero((data[:-3] == 39) & (before[:-3] != MARK))
        one, two = data[quote + 1], data[quote + 2]
        is_short = np.isin(one, list(b"stmd"))
        is_long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        quote, size = quote[is_short | is_long], np.where(is_short, 2, 3)[is_short | is_long]
        start[quote + 1] = False
        start[quote + size] = kind[quote + size] != SPACE
        stop = (before != SPACE) & (start | (kind == SPACE))
        return np.flatnonzero(start), np.flatnonzero(stop)

    def _block(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"\n".join([*texts, b"\n\n\n"]), np.uint8)
        begin, end = self._cut(data)
        sizes, keys = end - begin, hashed(data, begin, end)

        def learn(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            order, lengths, flat = [], [], []
            low = 0
            for width in _WIDTHS:
                own = places[(sizes[places] > low) & (sizes[places] <= width)]
                low = width
                for at in range(0, len(own), 20_000):
                    part = own[at : at + 20_000]
                    raw = data[np.minimum(begin[part][:, None] + np.arange(width), len(data) - 1)]
                    ids, n = self._merge(raw, sizes[part])
                    order.append(part)
                    lengths.append(n)
                    flat.append(ids[np.arange(width) < n[:, None]].astype(np.uint32))
            return np.concatenate(order), np.concatenate(lengths), np.concatenate(flat)

        short = np.flatnonzero(sizes <= MOST_BYTES)

        def learn_short(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            order, lengths, flat = learn(short[places])
            return np.searchsorted(short, order), lengths, flat

        ids, n = self.cache.ids(keys[short], learn_short)
        counts = np.zeros(len(begin), np.int64)
        counts[short] = n
        if len(short) < len(begin):
            long = np.flatnonzero(sizes > MOST_BYTES)
            own = [np.array(self.slow.encode(data[begin[i] : end[i]].tobytes().decode(), add_special_tokens=False).ids, np.uint32) for i in long.tolist()]
            counts[long] = [len(x) for x in own]
            is_long = np.repeat(sizes > MOST_BYTES, counts)
            both = np.empty(len(is_long), np.uint32)
            both[~is_long], both[is_long] = ids, np.concatenate(own)
            ids = both
        total = np.concatenate([[0], np.cumsum(counts)])
        starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        return ids, total[np.searchsorted(begin, starts)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        odd = [bool(_ODD.search(t)) or any(s in t for s in self.special) for t in texts]
        raw = [b"" if o else t.lower().encode() for t, o in zip(texts, odd, strict=True)]
        parts, counts = [], []
        for lo, hi in by_bytes([len(r) for r in raw], BLOCK):
            ids, bounds = self._block(raw[lo:hi])
            n = np.diff(bounds)
            if any(odd[lo:hi]):
                each = np.split(ids, bounds[1:-1])
                for i in range(lo, hi):
                    if odd[i]:
                        each[i - lo] = np.array(self.slow.encode(texts[i], add_special_tokens=False).ids, np.uint32)
                        n[i - lo] = len(each[i - lo])
                ids = np.concatenate(each)
            parts.append(ids)
            counts.append(n)
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(counts))])
