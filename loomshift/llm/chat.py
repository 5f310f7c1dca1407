"""Chat formatting as prefix trees.

Conversations that begin with the same turns share those turns: each tree emits a shared turn's tokens once, depth first,
with the position each token has in its own conversation (its depth in tokens) and the interval of places in the sequence
that its node's subtree takes up. A token attends to an earlier one whose interval holds it: those are its ancestors and
the tokens before it in its own node. The loss mask marks the tokens of assistant texts.

Template: each turn is <s>[ROLE]role[/ROLE][INST]text[/INST]</s>. Inside roles and texts a backslash doubles, and a control
string gets one after its first character; dropping each backslash that protects a character gives the text back.
Header, text and footer of a turn are encoded apart, byte-level, so that tokens never mix control and content. Runs of over
LONGEST_RUN characters without a break are encoded in parts.

Trees are dealt out by order: conversations are sorted by the digests of their prefixes over range partitions (ties by
conv_id), so those that share turns are neighbours, and a first turn of a third of all conversations is spread over many
tasks; it is repeated once for each task and each sequence it reaches. A sequence is closed after `most_tokens` tokens or
`most_conversations` leaves, which bounds memory by one sequence and the longest conversation.

A prefix is told by its digest, in which the length of each role comes before it, and turns are shared only if their roles
and texts are equal as well.

Turns are ordered by turn, then role, then text; a null turn comes first, a null text or role is empty, repeated rows are
repeated turns, and each row of a null conv_id is a conversation by itself. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomshift.llm.id_cache import runs
from loomshift.llm.shared import arrow_rows, by_bytes, leaving_little

#: The template's control strings.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
#: Fixed value: how the vocabulary's texts are cut before merging.
_PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a run without white space, or of white space, that are merged together.
LONGEST_RUN = 1000
_RUN = re.compile(r"\S{1001,}|\s{1001,}")
#: Characters of conversations whose new turns are encoded together.
BLOCK = 1_000_000
_PROTECT = re.compile(r"\\|<(?=/?s>)|\[(?=/?(?:INST|ROLE)\])")
_FREE = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<s>\[ROLE\](.*?)\[/ROLE\]\[INST\](.*?)\[/INST\]</s>", re.DOTALL)


def escape(text: str) -> str:
    return _PROTECT.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _FREE.sub(r"\1", text)


def parts_of(role: str, text: str) -> tuple[str, str, str]:
    """Header, content and footer of a turn."""
    return f"<s>[ROLE]{escape(role)}[/ROLE][INST]", escape(text), "[/INST]</s>"


def turns_in(formatted: str) -> list[tuple[str, str]]:
    """The roles and texts of a formatted conversation."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


class ByteTokens:
    """A byte-level BPE vocabulary (lines of base64 bytes and rank): any text to ids and back."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.model = tiktoken.Encoding(os.path.basename(path), pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={})
        held = [b""] * (max(ranks.values()) + 1)
        for raw, i in ranks.items():
            held[i] = raw
        self.size = np.array([len(r) for r in held])
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(held), np.uint8)

    def _ids(self, text: str) -> np.ndarray:
        if len(text) <= LONGEST_RUN or not _RUN.search(text):
            return np.array(self.model.encode_ordinary(text), np.int32)
        parts, done = [], 0
        for m in _RUN.finditer(text):  # the cost of a run without a break grows faster than its length
            parts += [text[done : m.start()], *[m[0][i : i + LONGEST_RUN] for i in range(0, len(m[0]), LONGEST_RUN)]]
            done = m.end()
        return np.concatenate([np.array(self.model.encode_ordinary(p), np.int32) for p in [*parts, text[done:]]])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Texts met together that recur, such as headers, are encoded once."""
        known = {t: self._ids(t) for t in dict.fromkeys(texts)}
        return [known[t] for t in texts]

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all ids, and where each id's begin (one more than ids)."""
        size = self.size[ids]
        return self.flat[runs(self.begin[ids], size)].tobytes(), np.concatenate([[0], np.cumsum(size)])


_TOKENS: dict[str, ByteTokens] = {}


def tokens(path: str) -> ByteTokens:
    if path not in _TOKENS:
        _TOKENS[path] = ByteTokens(path)
    return _TOKENS[path]


def conversations_of(rows: DataFrame) -> DataFrame:
    """conv_id, roles, texts and path (a digest of each prefix), from rows of conv_id, turn, role, text."""
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())  # so that rows without an id are no hot group
    gathered = rows.select("conv_id", alone.alias("alone"), turn.alias("turn")).groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    told = lambda t: F.concat(F.length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"])
    step = lambda done, t: F.concat(done, F.array(F.sha1(F.concat(F.coalesce(F.element_at(done, -1), F.lit("")), told(t)))))
    none = F.array(F.lit("")).cast("array<string>")
    path = F.slice(F.aggregate("turns", none, step), 2, F.size("turns") + 1)
    return gathered.select("conv_id", F.transform("turns", lambda t: t["role"]).alias("roles"), F.transform("turns", lambda t: t["text"]).alias("texts"), path.alias("path"))


SCHEMA = (
    "sequence_id long, ids array<int>, positions array<int>, interval_end array<int>, loss array<boolean>,"
    " node_start array<int>, node_end array<int>, node_parent array<int>, leaf_conv array<long>, leaf_node array<int>"
)


class _Sequence:
    """One sequence while it is made: what each node adds, and the path that is open."""

    def __init__(self) -> None:
        self.bodies: list[np.ndarray] = []
        self.parent: list[int] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.close: list[int] = []
        self.depth: list[int] = []
        self.spans: list[tuple[int, int, int, bool]] = []  # tokens of header, text and footer, and whether the text is learnt
        self.leaf_conv: list[int | None] = []
        self.leaf_node: list[int] = []
        self.open: list[tuple[str, str, str, int]] = []
        self.size = 0

    def leave(self, depth: int) -> None:
        """Leave the nodes below `depth`: their subtrees end here."""
        while len(self.open) > depth:
            self.close[self.open.pop()[3]] = self.size

    def shared(self, path: list[str], roles: list[str], texts: list[str]) -> int:
        n = 0
        while n < min(len(path), len(self.open)) and self.open[n][:3] == (path[n], roles[n], texts[n]):
            n += 1
        return n

    def add(self, key: str, role: str, text: str, head: np.ndarray, body: np.ndarray, foot: np.ndarray) -> None:
        parent = self.open[-1][3] if self.open else -1
        n = len(head) + len(body) + len(foot)
        self.open.append((key, role, text, len(self.parent)))
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + self.end[parent] - self.start[parent] if parent >= 0 else 0)
        self.start.append(self.size)
        self.size += n
        self.end.append(self.size)
        self.close.append(0)
        self.bodies += [head, body, foot]
        self.spans.append((len(head), len(body), len(foot), role == "assistant"))

    def finished(self, sequence_id: int) -> pd.DataFrame:
        self.leave(0)
        start, size = np.array(self.start, np.int32), np.array(self.end, np.int32) - np.array(self.start, np.int32)
        spans = np.array(self.spans, np.int64)
        learnt = np.zeros((len(spans), 3), bool)
        learnt[:, 1] = spans[:, 3] == 1
        columns = {
            "ids": np.concatenate(self.bodies),
            "positions": (np.repeat(np.array(self.depth, np.int32) - start, size) + np.arange(self.size)).astype(np.int32),
            "interval_end": np.repeat(np.array(self.close, np.int32), size),
            "loss": np.repeat(learnt.ravel(), spans[:, :3].ravel()),
            "node_start": start,
            "node_end": np.array(self.end, np.int32),
            "node_parent": np.array(self.parent, np.int32),
            "leaf_conv": self.leaf_conv,
            "leaf_node": np.array(self.leaf_node, np.int32),
        }
        return pd.DataFrame({"sequence_id": [sequence_id]} | {k: [v] for k, v in columns.items()})


def trees(rows: DataFrame, vocabulary: str, most_tokens: int = 50_000, most_conversations: int = 1000) -> DataFrame:
    """One row for each sequence. node_*: the places of each turn's own tokens and its parent (-1: none); leaf_*: each conversation and its last node.

    The token at place i attends to the token at place j <= i if i < interval_end[j].
    """
    arrow_rows(rows.sparkSession)
    found = conversations_of(rows)
    dealt = found.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = tokens(vocabulary)
        base, made, now = TaskContext.get().partitionId() << 33, 0, _Sequence()
        for batch in batches:
            sizes = [sum(map(len, texts)) for texts in batch["texts"]]
            for lo, hi in by_bytes(sizes, BLOCK):
                part = list(zip(batch["conv_id"].iloc[lo:hi], batch["roles"].iloc[lo:hi], batch["texts"].iloc[lo:hi], batch["path"].iloc[lo:hi], strict=True))
                new, last = [], [k[:3] for k in now.open]
                for _, roles, texts, path in part:  # the turns that no conversation before has
                    turns = list(zip(path, roles, texts, strict=True))
                    n = 0
                    while n < min(len(turns), len(last)) and turns[n] == last[n]:
                        n += 1
                    new += turns[n:]
                    last = turns
                cut = [parts_of(role, text) for _, role, text in new]
                coded = dict(zip(((role, text) for _, role, text in new), zip(*[own.encode([c[i] for c in cut]) for i in range(3)], strict=True), strict=True))
                for conv, roles, texts, path in part:
                    if now.leaf_node and (now.size >= most_tokens or len(now.leaf_node) >= most_conversations):
                        yield now.finished(base + made)
                        made, now = made + 1, _Sequence()
                    shared = now.shared(path, roles, texts)
                    now.leave(shared)
                    for key, role, text in zip(path[shared:], roles[shared:], texts[shared:], strict=True):
                        if (role, text) not in coded:  # a new sequence begins with turns that the last one had
                            coded[role, text] = tuple(x[0] for x in zip(*[own.encode([p]) for p in parts_of(role, text)], strict=True))
                        now.add(key, role, text, *coded[role, text])
                    now.leaf_conv.append(None if pd.isna(conv) else int(conv))
                    now.leaf_node.append(now.open[-1][3])
        if now.leaf_node:
            yield now.finished(base + made)

    return dealt.mapInPandas(leaving_little(run), SCHEMA)


def read_back(sequences: DataFrame, vocabulary: str) -> DataFrame:
    """The digests of each conversation, from its sequence alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens."""
    arrow_rows(sequences.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = tokens(vocabulary)
        for batch in batches:
            for row in batch.itertuples():
                raw, at = own.decode(np.asarray(row.ids, np.int64))
                marked = np.flatnonzero(np.asarray(row.loss, bool))
                start, end = np.asarray(row.node_start), np.asarray(row.node_end)
                first, last = np.searchsorted(marked, start), np.searchsorted(marked, end)
                texts, saids, n_turns, n_said, n_formatted, n_tokens = [], [], [], [], [], []
                for node, parent in enumerate(row.node_parent.tolist()):  # each node goes on from its parent
                    known = parent >= 0
                    formatted = raw[at[start[node]] : at[end[node]]].decode()
                    turns = turns_in(formatted)
                    text = texts[parent].copy() if known else hashlib.sha256()
                    text.update("".join([f"{r}\n{t}\n" for r, t in turns]).encode())
                    places = marked[first[node] : last[node]]
                    breaks = np.flatnonzero(np.diff(places) > 1) + 1
                    said = "".join([unescape(raw[at[p[0]] : at[p[-1] + 1]].decode()) for p in np.split(places, breaks) if len(p)])
                    learnt = saids[parent].copy() if known else hashlib.sha256()
                    learnt.update(said.encode())
                    texts.append(text)
                    saids.append(learnt)
                    n_turns.append(len(turns) + (n_turns[parent] if known else 0))
                    n_said.append(len(said) + (n_said[parent] if known else 0))
                    n_formatted.append(len(formatted) + (n_formatted[parent] if known else 0))
                    n_tokens.append(int(end[node] - start[node]) + (n_tokens[parent] if known else 0))
                leaves = row.leaf_node.tolist()
                yield pd.DataFrame(
                    {
                        "conv_id": pd.array([None if pd.isna(c) else int(c) for c in row.leaf_conv], "Int64"),
                        "n_turns": [n_turns[n] for n in leaves],
                        "turns_sha256": [texts[n].hexdigest() for n in leaves],
                        "loss_chars": [n_said[n] for n in leaves],
                        "loss_sha256": [saids[n].hexdigest() for n in leaves],
                        "formatted_chars": [n_formatted[n] for n in leaves],
                        "n_tokens": [n_tokens[n] for n in leaves],
                    }
                )

    return sequences.mapInPandas(leaving_little(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")
