"""SentencePiece encoding and decoding by batched Viterbi in numpy.

The vocabulary's merges are ordered, so the best path is not the one of the largest score sum: a path's pieces must be the
ones that the merges end with. A pair of adjacent pieces is compatible if encoding their joined text gives the pair back;
the encoding of a word is the one path all of whose adjacent pairs are compatible. So the Viterbi table holds, for each
prefix of a word, the piece that the compatible path to it ends with; exactly one does.

A block of texts is one array of characters, cut into words: before runs of spaces, and wherever no piece holds the two
characters that meet. Words of one length advance together: the hashes of all their substrings probe the sorted hashes of the
pieces; at each end place a maximum over the matches that follow a path takes the longest, and stores it as the backpointer,
once it is compatible with the piece before it; else the next longest follows.

Compatibility is worked out by the times at which merging makes a piece: the last two parts of each piece are known, and the
parts that meet at the border of a pair are undone from the latest one, for all pairs at once. If two parts that meet could
be merged before either grows, the pair falls apart. Pairs whose times are equal are merged one by one instead.

Characters without a piece are spelt in byte pieces, as the vocabulary's fallback has it. Words and pairs met before are kept
in numpy arrays of bounded size. Memory follows one block (BLOCK characters, or one longer text).

Nulls and ties: a null text is empty and has no ids. Equal maxima can't occur, as the compatible piece is unique. Rows
that repeat a doc_id are encoded each. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomshift.llm.id_cache import IdCache, runs
from loomshift.llm.shared import arrow_rows, by_bytes, leaving_little, mix64, text_of
from loomshift.llm.words import powers

#: Words and pairs of pieces kept, which changes speed only.
MOST_WORDS, PAIRS = 1_000_000, 1 << 20
#: Characters of a block, and of a word that is kept.
BLOCK, MOST_KEPT = 2_000_000, 48
#: Places of the words that advance together.
MOST_PLACES = 400_000
SPACE = "▁"
_NONE, _START = -3, -1
_NEVER = np.int64(1) << 40


class PieceCodec:
    """encode(texts) and decode(ids) of one SentencePiece BPE model with byte fallback and a dummy prefix."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.zeros(256, np.int64)
        self.is_byte = np.zeros(n, bool)
        plain = []
        for i, p in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                self.is_byte[i] = True
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain.append(i)
        text = [b""] * n
        for i in plain:
            text[i] = self.pieces[i].replace(SPACE, " ").encode()
        for b in range(256):
            text[self.byte_ids[b]] = bytes([b])
        self.text_size = np.array([len(t) for t in text])
        self.text_begin = np.cumsum(self.text_size) - self.text_size
        self.text_flat = np.frombuffer(b"".join(text), np.uint8)
        self.ids = {self.pieces[i]: i for i in plain}
        self._index(plain)
        self._time(plain, {s: k for k, s in enumerate(sorted({model.get_score(i) for i in plain}, reverse=True))}, model)
        self.words = IdCache(MOST_WORDS)
        self.pair_keys, self.pair_fits = np.zeros(PAIRS, np.uint64), np.zeros(PAIRS, bool)
        self.odd_pairs: dict[tuple[int, int], bool] = {}

    def _index(self, plain: list[int]) -> None:
        """The pieces by hash, and the pairs of characters that meet in one."""
        n = len(self.pieces)
        self.raw, self.size = np.zeros(n, np.uint64), np.zeros(n, np.int64)
        held = [self.pieces[i] for i in plain]
        codes = np.frombuffer("".join(held).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(p) for p in held])
        ends = np.cumsum(sizes)
        total = np.concatenate([[np.uint64(0)], np.cumsum(_values(codes), dtype=np.uint64)])
        self.raw[plain] = (total[ends] - total[ends - sizes]) * powers(len(codes), inverse=True)[ends - sizes]
        self.size[plain] = sizes
        self.longest = int(sizes.max())
        keys = mix64(self.raw[plain])
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.array(plain)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.seen = np.zeros(1 << 20, bool)
        self.seen[keys >> np.uint64(44)] = True
        inner = np.ones(len(codes), bool)
        inner[ends - 1] = False
        at = np.flatnonzero(inner)
        letters = np.unique(np.concatenate([codes[at], codes[at + 1]]))
        if any(chr(c) not in self.ids for c in letters.tolist()):
            raise ValueError("a character of a piece has no piece")
        self.number = np.zeros(0x110000, np.uint16)  # 0: of no longer piece
        self.number[letters] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        self.meet = np.zeros(self.width * self.width, bool)
        self.meet[self.number[codes[at]].astype(np.int64) * self.width + self.number[codes[at + 1]]] = True

    def _time(self, plain: list[int], rank_of: dict[float, int], model) -> None:
        """The rank of each piece, its last two parts, and the time at which merging its text makes it (-1: a character; never: it doesn't)."""
        n = len(self.pieces)
        self.rank, self.time = np.full(n, _NEVER), np.full(n, _NEVER)
        self.left, self.right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i in plain:
            self.rank[i] = rank_of[model.get_score(i)]
        self.rank_of = {p: int(self.rank[i]) for p, i in self.ids.items()}
        for i in sorted(plain, key=lambda i: len(self.pieces[i])):
            p = self.pieces[i]
            if len(p) == 1:
                self.time[i] = -1
                continue
            parts = self.merged(p, 2)
            if len(parts) == 2 and all(x in self.ids for x in parts):
                self.left[i], self.right[i] = self.ids[parts[0]], self.ids[parts[1]]
                self.time[i] = max(self.rank[i], self.time[self.left[i]], self.time[self.right[i]])

    def merged(self, word: str, least: int = 1) -> list[str]:
        """A word's pieces by merging, best score first, leftmost among equals, until `least` parts are left."""
        parts = list(word)
        while len(parts) > least:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.rank_of.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s < best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _found(self, raw: np.ndarray) -> np.ndarray:
        """The piece of each hash, before mixing."""
        keys = mix64(raw)
        out = np.full(len(raw), _NONE, np.int32)
        near = np.flatnonzero(self.seen[keys >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.keys, keys[near]), len(self.keys) - 1)
        hit = self.keys[at] == keys[near]
        out[near[hit]] = self.values[at[hit]]
        return out

    def _fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the pieces stay a pair when their joined text is merged."""
        out = np.ones(len(left), bool)
        fixed = (left == _START) | (self.time[right] == _NEVER) | (self.time[left] == _NEVER)
        out[fixed] = (self.time[right[fixed]] < _NEVER) & ((left[fixed] == _START) | (self.time[left[fixed]] < _NEVER))
        live = np.flatnonzero(~fixed)
        x, y = left[live], right[live]
        until = np.full(len(live), _NEVER)  # the time at which one of the two parts that meet becomes part of a longer one
        odd: list[np.ndarray] = []
        power = powers(self.longest + 1)
        while len(live):
            both = self._found(self.raw[x] + self.raw[y] * power[self.size[x]])
            tx, ty = self.time[x], self.time[y]
            when = np.maximum(np.where(both > _NONE, self.rank[both], _NEVER), np.maximum(tx, ty))
            apart = (both > _NONE) & (when < until)
            out[live[apart]] = False
            unclear = ~apart & ((both > _NONE) & (when == until) | (tx == ty) & (tx >= 0))
            odd.append(live[unclear])
            go = ~apart & ~unclear & (np.maximum(tx, ty) >= 0)
            live, x, y, tx, ty = live[go], x[go], y[go], tx[go], ty[go]
            until = np.maximum(tx, ty)
            x, y = np.where(tx > ty, self.right[x], x), np.where(ty > tx, self.left[y], y)
        for i in np.concatenate(odd).tolist() if odd else ():
            pair = int(left[i]), int(right[i])
            if pair not in self.odd_pairs:
                if len(self.odd_pairs) >= PAIRS // 10:
                    self.odd_pairs.clear()
                a, b = self.pieces[pair[0]], self.pieces[pair[1]]
                self.odd_pairs[pair] = self.merged(a + b) == [a, b]
            out[i] = self.odd_pairs[pair]
        return out

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """_fits(), with what was worked out before; a new pair takes the place of an older one. left: -1 at a word's start."""
        keys = (left + 2).astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = (mix64(keys) & np.uint64(len(self.pair_keys) - 1)).astype(np.int64)
        new = np.flatnonzero(self.pair_keys[slot] != keys)
        out = self.pair_fits[slot]
        if len(new):
            out[new] = self._fits(left[new], right[new])
            self.pair_keys[slot[new]], self.pair_fits[slot[new]] = keys[new], out[new]
        return out

    def viterbi(self, total: np.ndarray, begin: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of words of one length (at least 2), one row each from the right end on, and how many each has. total: running sums of the block's characters."""
        n = len(begin)
        longest = min(size, self.longest)
        inverse, row = powers(len(total), inverse=True), np.arange(n)
        piece = np.full((size + 1, n, longest + 1), _NONE, np.int32)  # that ends at a place, by its length
        for k in range(1, longest + 1):
            start = begin[None, :] + np.arange(size - k + 1)[:, None]
            piece[k:, :, k] = self._found(((total[start + k] - total[start]) * inverse[start]).ravel()).reshape(start.shape)
        last = np.full((size + 1, n), _NONE, np.int64)  # the piece that the compatible path to a prefix ends with
        last[0] = _START
        step = np.zeros((size + 1, n), np.int64)  # its length, the backpointer
        for end in range(1, size + 1):
            reach = np.arange(min(end, longest) + 1)
            fits = (piece[end][:, reach] > _NONE) & (last[end - reach].T > _NONE)
            fits[:, 0] = False
            todo = row
            while len(todo):
                best = fits[todo][:, ::-1].argmax(1)
                best = len(reach) - 1 - best
                todo, best = todo[fits[todo, best]], best[fits[todo, best]]
                ok = self.compatible(last[end - best, todo], piece[end][todo, best])
                done = todo[ok]
                last[end, done], step[end, done] = piece[end][done, best[ok]], best[ok]
                fits[todo[~ok], best[~ok]] = False
                todo = todo[~ok]
        if (last[size] == _NONE).any():
            raise ValueError("a word has no compatible path")
        out, count = np.zeros((n, size), np.uint32), np.zeros(n, np.int64)
        place, live = np.full(n, size), row
        while len(live):
            out[live, count[live]] = last[place[live], live]
            count[live] += 1
            place[live] -= step[place[live], live]
            live = live[place[live] > 0]
        return out, count

    def _learn(self, codes: np.ndarray, total: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, how many ids each, the ids) of words, in an order of its own."""
        order, counts, flat = [], [], []
        for k in np.unique(size).tolist():
            own = np.flatnonzero(size == k)
            for at in range(0, len(own), max(1, MOST_PLACES // k)):
                part = own[at : at + max(1, MOST_PLACES // k)]
                order.append(part)
                if k == 1:
                    got = self._found(_values_at(codes[begin[part]]))
                    ids = [[p] if p > _NONE else self.byte_ids[list(chr(c).encode())].tolist() for p, c in zip(got.tolist(), codes[begin[part]].tolist(), strict=True)]
                    counts.append(np.array([len(x) for x in ids]))
                    flat.append(np.array([i for x in ids for i in x], np.uint32))
                else:
                    out, n = self.viterbi(total, begin[part], k)
                    counts.append(n)
                    flat.append(out[:, ::-1][np.arange(k) >= k - n[:, None]])
        return np.concatenate(order), np.concatenate(counts), np.concatenate(flat)

    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer("".join([SPACE + t if t else "" for t in texts]).encode("utf-32-le"), np.uint32).copy()
        space = ord(SPACE)
        codes[codes == 32] = space
        text_ends = np.cumsum([len(t) + 1 if t else 0 for t in texts])
        number = self.number[codes].astype(np.int64)
        start = np.ones(len(codes), bool)
        start[1:] = ~self.meet[number[:-1] * self.width + number[1:]] | (codes[1:] == space) & (codes[:-1] != space)
        start[text_ends[:-1][text_ends[:-1] < len(codes)]] = True
        begin = np.flatnonzero(start)
        size = np.diff(np.append(begin, len(codes)))
        total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_values(codes), out=total[1:])
        kept = np.flatnonzero(size <= MOST_KEPT)
        keys = mix64((total[begin + size] - total[begin])[kept] * powers(len(total), inverse=True)[begin[kept]] + size[kept].astype(np.uint64))

        def learn(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            order, n, flat = self._learn(codes, total, begin[kept[places]], size[kept[places]])
            return places[order], n, flat

        ids, n = self.words.ids(keys, learn)
        counts = np.zeros(len(begin), np.int64)
        counts[kept] = n
        if len(kept) < len(begin):
            rest = np.flatnonzero(size > MOST_KEPT)
            order, n, flat = self._learn(codes, total, begin[rest], size[rest])
            counts[rest[order]] = n
            starts = np.empty(len(rest), np.int64)
            starts[order] = np.cumsum(n) - n
            is_long = np.repeat(size > MOST_KEPT, counts)
            both = np.empty(len(is_long), np.uint32)
            both[~is_long], both[is_long] = ids, flat[runs(starts, counts[rest])]
            ids = both
        at = np.concatenate([[0], np.cumsum(counts)])
        return ids, at[np.searchsorted(begin, np.concatenate([[0], text_ends]))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's begin."""
        parts, ends = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
        for lo, hi in by_bytes([len(t) for t in texts], BLOCK):
            ids, bounds = self._block(texts[lo:hi])
            parts.append(ids)
            ends.append(ends[-1][-1] + bounds[1:])
        return np.concatenate(parts), np.concatenate(ends)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of encode()'s results."""
        size = self.text_size[ids]
        raw = self.text_flat[runs(self.text_begin[ids], size)].tobytes()
        at = np.concatenate([[0], np.cumsum(size)])[bounds].tolist()
        return [raw[a + 1 : b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]


def _values_at(codes: np.ndarray) -> np.ndarray:
    """The hash of single characters, before mixing."""
    return codes.astype(np.uint64) + np.uint64(1)


def _values(codes: np.ndarray) -> np.ndarray:
    return _values_at(codes) * powers(len(codes))


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One codec for each worker process and model file."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def encode(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """For each row of `docs` (doc_id, text): n_ids, ids_crc32, n_byte_ids, and whether decoding gives the text back. with_ids adds `ids`."""
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for batch in batches:
            texts = batch["text"].tolist()
            for lo, hi in by_bytes([len(t) for t in texts], BLOCK):
                ids, bounds = own.encode(texts[lo:hi])
                raw, cuts = memoryview(ids.astype("<u4")).cast("B"), (4 * bounds).tolist()
                spelt = np.concatenate([[0], np.cumsum(own.is_byte[ids])])[bounds]
                out = {"doc_id": batch["doc_id"].iloc[lo:hi], "n_ids": np.diff(bounds), "ids_crc32": [zlib.crc32(raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], "n_byte_ids": np.diff(spelt)}
                out["round_trip"] = [a == b for a, b in zip(own.decode(ids, bounds), texts[lo:hi], strict=True)]
                if with_ids:
                    out["ids"] = np.split(ids.astype(np.int32), bounds[1:-1])
                yield pd.DataFrame(out)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_ids long, ids_crc32 long, n_byte_ids long, round_trip boolean" + ", ids array<int>" * with_ids
    return docs.select("doc_id", text_of().alias("text")).mapInPandas(leaving_little(run), schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text for each row of `encoded` (doc_id, ids); null ids give an empty text."""
    arrow_rows(encoded.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for batch in batches:
            ids = [np.asarray([] if x is None else x, np.int64) for x in batch["ids"]]
            bounds = np.cumsum([0, *[len(x) for x in ids]])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": own.decode(np.concatenate([np.zeros(0, np.int64), *ids]), bounds)})

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", F.col("ids")).mapInPandas(leaving_little(run), f"doc_id {kind}, text string")
