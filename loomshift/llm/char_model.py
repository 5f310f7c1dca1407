"""An interpolated modified Kneser-Ney model over whole characters: any alphabet, and tables that grow with the text.

P(c | ctx) = max(n - D(n), 0) / n(ctx) + gamma(ctx) * P(c | shorter ctx), with discounts D1, D2, D3+ of each order from its
counts of counts, and continuation counts below the highest order. A gram is a string of up to ORDER characters, the text
being preceded by ORDER - 1 line breaks. Below single characters, the characters seen in training and one that stands for
all others are equally likely.

Counts, sums by context and finished probabilities are tables dealt by gram or context; none is gathered in one place. Texts
are scored in blocks of about BLOCK bytes: the distinct grams of a block are joined with the tables, an unseen gram going on
to its context's gamma and its shorter gram, and the logarithms come back to the block's texts, which travel compressed.
A gram or context of k characters meets at most one row for each character of the alphabet, so no key is hot.

The blocks are made twice from the rows of `docs`, once for grams and once for texts, under an id that is the hash of their
content: should the second reading deal rows to other blocks, scored() fails instead of returning other numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomshift.llm.shared import by_bytes, drop_written, lean, leaving_little, text_of, written

ORDER = 4
#: Bytes of a block of texts, of the texts that are worked on at once, and grams of an Arrow batch.
BLOCK, CHUNK, PART = 24_000_000, 1_500_000, 200_000


@dataclass
class Model:
    """For each order from 1, (gram, p) and, from order 2, (ctx, gamma); and the probability of a character never seen."""

    seen: list[DataFrame]
    gamma: list[DataFrame | None]
    unseen: float


class Grams:
    """The grams of a block of texts: one for each character, which it ends with. Worked out a chunk of texts at a time.

    A block tells 65,536 characters apart; should it hold more, the last ones count as U+FFFD.
    """

    def __init__(self, texts: list[str] | pa.ChunkedArray) -> None:
        self.texts = texts
        self.chunks = by_bytes(pc.binary_length(texts).to_pylist() if isinstance(texts, pa.ChunkedArray) else [len(t) for t in texts], CHUNK)
        seen = np.zeros(0x110000, bool)
        seen[10] = True
        for lo, hi in self.chunks:
            seen[self._codes(lo, hi)[0]] = True
        letters = np.flatnonzero(seen)
        self.letters = np.append(letters[:65_535], 0xFFFD) if len(letters) > 65_536 else letters
        self.bits = max(1, int(len(self.letters) - 1).bit_length())
        self.number = np.full(0x110000, len(self.letters) - 1, np.int32)
        self.number[self.letters] = np.arange(len(self.letters))

    def _codes(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """The characters of some texts, each after ORDER - 1 line breaks, and how many each text has of its own."""
        texts = self.texts[lo:hi].to_pylist() if isinstance(self.texts, pa.ChunkedArray) else self.texts[lo:hi]
        raw = "".join(["\n" * (ORDER - 1) + t for t in texts]).encode("utf-32-le", "replace")
        return np.frombuffer(raw, np.uint32), np.array([len(t) for t in texts], np.int64)

    def keys(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """The key of each gram of some texts, and each one's text."""
        codes, sizes = self._codes(lo, hi)
        symbols = self.number[codes]
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        start = np.arange(len(doc)) + doc * np.int64(ORDER - 1)
        key = symbols[start].astype(np.uint64)
        for j in range(1, ORDER):
            key = key << np.uint64(self.bits) | symbols[start + j].astype(np.uint64)
        return key, doc

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The sorted keys of the block, and how often each occurs."""
        parts, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for lo, hi in self.chunks:
            at, known = pd.factorize(self.keys(lo, hi)[0])
            parts.append(known)
            counts.append(np.bincount(at, minlength=len(known)))
        found, place = np.unique(np.concatenate(parts), return_inverse=True)
        return found, np.bincount(place, np.concatenate(counts), minlength=len(found)).astype(np.int64)

    def spelt(self, keys: np.ndarray) -> list[str]:
        """The grams of keys as strings."""
        shifts = (np.arange(ORDER - 1, -1, -1) * self.bits).astype(np.uint64)
        joined = self.letters[keys[:, None] >> shifts & np.uint64((1 << self.bits) - 1)].astype(np.uint32).tobytes().decode("utf-32-le")
        return [joined[i : i + ORDER] for i in range(0, len(joined), ORDER)]

    def summed(self, keys: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the number of its grams, and the sum of their logarithms."""
        n, total = [np.zeros(0, np.int64)], [np.zeros(0)]
        for lo, hi in self.chunks:
            own, doc = self.keys(lo, hi)
            at, known = pd.factorize(own)
            n.append(np.bincount(doc, minlength=hi - lo))
            total.append(np.bincount(doc, logs[np.searchsorted(keys, known)][at], minlength=hi - lo))
        return np.concatenate(n), np.concatenate(total)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in order, in tables of about BLOCK bytes of text (a longer text is one by itself)."""
    held, total = [], 0
    for batch in batches:
        sizes = pc.binary_length(batch.column("text")).to_pylist()
        for lo, hi in by_bytes(sizes, BLOCK):
            n = sum(sizes[lo:hi])
            if held and total + n > BLOCK:
                yield pa.Table.from_batches(held)
                held, total = [], 0
            held.append(batch.slice(lo, hi - lo))
            total += n
    if held:
        yield pa.Table.from_batches(held)


def _id(rows: pa.Table) -> int:
    """The id of a block: a hash of its texts and ids, in order."""
    found = hashlib.blake2b(digest_size=8)
    for lo in range(0, len(rows), 4096):
        part = rows.slice(lo, 4096)
        texts = part["text"].to_pylist()
        found.update(f"{part['doc_id'].to_pylist()}{[len(t) for t in texts]}{part['lang'].to_pylist()}".encode())
        found.update("".join(texts).encode("utf-8", "replace"))
    return int.from_bytes(found.digest(), "big", signed=True)


def _packed(rows: pa.Table) -> bytes:
    """The compressed rows of a block."""
    sink = pa.BufferOutputStream()
    rows = rows.combine_chunks()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 12))) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def counts(trusted: DataFrame) -> DataFrame:
    """(gram, n) over all of `trusted` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            grams = Grams(rows["text"])
            keys, n = grams.distinct()
            for lo in range(0, len(keys), PART):
                yield pa.RecordBatch.from_pydict({"gram": pa.array(grams.spelt(keys[lo : lo + PART]), pa.string()), "n": n[lo : lo + PART]})

    return trusted.select(text_of().alias("text")).mapInArrow(leaving_little(run), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(table: DataFrame) -> list[float]:
    """D1, D2, D3+ of a count table, kept within what its counts of counts allow."""
    n = [float(x or 0) for x in table.agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()]
    if not n[0] or not n[1]:
        return [0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    return [float(np.clip(k - (k + 1) * y * n[k] / max(n[k - 1], 1), 0.1, k - 0.05)) for k in (1, 2, 3)]


def _shorter(gram: str = "gram") -> Column:
    return F.expr(f"substring({gram}, 2)")


def train(table: DataFrame) -> Model:
    """The model of a count table of the highest order, which has rows."""
    orders = [table]
    for _ in range(ORDER - 1):  # how many different characters come before each shorter gram
        orders.append(written(orders[-1].groupBy(_shorter().alias("gram")).agg(F.count(F.lit(1)).alias("n")), "continuations"))
    seen, gamma, unseen = [], [], 0.0
    for k, own in enumerate(reversed(orders), 1):
        d = _discounts(own)
        cut = F.least(F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2]), F.col("n"))
        own = own.withColumn("cut", cut)
        if k == 1:
            row = own.agg(F.sum("n").alias("total"), F.sum("cut").alias("left"), F.count(F.lit(1)).alias("letters")).first()
            unseen = row.left / row.total / (row.letters + 1)
            seen.append(written(own.select("gram", ((F.col("n") - F.col("cut")) / row.total + unseen).alias("p")), "order"))
            gamma.append(None)
            continue
        own = own.withColumn("ctx", F.expr(f"substring(gram, 1, {k - 1})")).withColumn("shorter", _shorter())
        sums = written(own.groupBy("ctx").agg(F.sum("n").alias("total"), F.sum("cut").alias("left")), "contexts")
        lower = seen[-1].select(F.col("gram").alias("shorter"), F.col("p").alias("less"))
        p = (F.col("n") - F.col("cut") + F.col("left") * F.col("less")) / F.col("total")
        seen.append(written(own.join(sums, "ctx").join(lower, "shorter").select("gram", p.alias("p")), "order"))
        gamma.append(sums.select("ctx", (F.col("left") / F.col("total")).alias("gamma")))
    return Model(seen, gamma, unseen)


def probabilities(grams: DataFrame, model: Model, k: int = ORDER) -> DataFrame:
    """(gram, p) of the distinct `grams` of k characters."""
    found = written(grams.join(model.seen[k - 1], "gram", "left"), f"found{k}")
    if k == 1:
        return found.select("gram", F.coalesce("p", F.lit(model.unseen)).alias("p"))
    rest = found.where("p is null").select("gram", F.expr(f"substring(gram, 1, {k - 1})").alias("ctx"), _shorter().alias("shorter"))
    lower = probabilities(rest.select(F.col("shorter").alias("gram")).distinct(), model, k - 1).withColumnsRenamed({"gram": "shorter", "p": "less"})
    backed = rest.join(model.gamma[k - 1], "ctx", "left").join(lower, "shorter")
    return found.where("p is not null").unionByName(backed.select("gram", (F.coalesce("gamma", F.lit(1.0)) * F.col("less")).alias("p")))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, n_symbols and nll (mean negative log-likelihood of a character, null for an empty text)."""
    rows = docs.select("doc_id", text_of().alias("text"), "lang")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches):
            block, grams = _id(part), Grams(part["text"])
            found, _ = grams.distinct()
            for lo in range(0, len(found), PART):
                own = grams.spelt(found[lo : lo + PART])
                yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(own), block)), "at": pa.array(np.arange(lo, lo + len(own), dtype=np.int32)), "gram": pa.array(own, pa.string())})

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches):
            yield pa.RecordBatch.from_pydict({"block": pa.array([_id(part)], pa.int64()), "packed": pa.array([_packed(part)], pa.binary())})

    kind = docs.schema["doc_id"].dataType.simpleString()

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        logs = np.full(int(pc.max(right["at"]).as_py() or 0) + 1 if len(right) else 0, np.nan)
        logs[right["at"].to_numpy()] = np.log(np.maximum(right["p"].to_numpy(), 1e-300))
        del right
        out = []
        for blob in left["packed"].to_pylist() or [None]:
            if blob is None:
                raise RuntimeError("the rows of the documents were dealt to other blocks when they were read again")
            part = pa.ipc.open_stream(blob).read_all()
            grams = Grams(part["text"])
            found, _ = grams.distinct()
            if len(found) != len(logs) or np.isnan(logs).any():
                raise RuntimeError("the rows of the documents were dealt to other blocks when they were read again")
            n, total = grams.summed(found, logs)
            out.append(pa.table({"doc_id": part["doc_id"], "lang": part["lang"], "n_symbols": n, "nll": pa.array(-total / np.maximum(n, 1), mask=n == 0)}))
        lean()
        return pa.concat_tables(out)

    held = written(rows.mapInArrow(leaving_little(keys), "block long, at int, gram string"), "grams")
    known = probabilities(held.select("gram").distinct(), model)
    back = held.join(known, "gram").select("block", "at", F.col("p").cast("float").alias("p"))
    packed = rows.mapInArrow(leaving_little(texts), "block long, packed binary")
    out = packed.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(summed, f"doc_id {kind}, lang string, n_symbols long, nll double")
    out = written(out, "scored")
    drop_written(held)
    return out
