"""Packing by power-of-two decomposition.

A document of n tokens (its ids and the end id) becomes n // length pieces of the full length, then one piece for each bit
of the rest, longest first. Each piece is a sequence of its own: its length is a power of two, so it needs no padding, and
no sequence crosses documents. Sequences of one length form a bucket; within a task each bucket is cut into batches of a
fixed number of tokens, so that every batch is a full rectangle but each task's last one in a bucket.

The work is a map over documents: no shuffle, and a lost task gives the same pieces and numbers again. sequence_id holds
the task's number (from bit 33) and a counter. Memory follows one Arrow batch; a long document is one row.

Nulls and repeats: a null text is empty and gives the end id alone. Rows that repeat a doc_id are packed each. A null
doc_id stays null. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomshift.llm.shared import arrow_rows, by_bytes, leaving_little, text_of

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("bucket", T.IntegerType()),
        T.StructField("batch_id", T.LongType()),
    ]
)
_ENCODERS: dict = {}


def pieces_of(n: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of each piece's document, and the piece's length: n // longest full ones, then one for each bit of the rest, longest first."""
    bits = longest.bit_length() - 1
    rest = n[:, None] % longest >> np.arange(bits - 1, -1, -1) & 1
    doc, bit = np.nonzero(rest)
    full = np.repeat(np.arange(len(n)), n // longest)
    docs = np.concatenate([full, doc])
    order = np.argsort(docs, kind="stable")  # full pieces come before those of the rest
    return docs[order], np.concatenate([np.full(len(full), longest), longest >> bit + 1])[order]


def _encoder(path: str):
    """One encoder for each worker process and vocabulary file."""
    if path not in _ENCODERS:
        from loomshift.llm.word_bpe import WordBPE

        _ENCODERS[path] = WordBPE(path)
    return _ENCODERS[path]


def pack(docs: DataFrame, vocabulary: str, length: int = 2048, end_id: int = 1, batch_tokens: int = 65536, with_ids: bool = False) -> DataFrame:
    """One row for each piece of `docs` (doc_id, text). length: a power of two. with_ids: adds `ids`, the piece's tokens."""
    if length & (length - 1) or length < 1:
        raise ValueError("length must be a power of two")
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(vocabulary)
        base, made, filled = TaskContext.get().partitionId() << 33, 0, np.zeros(length.bit_length(), np.int64)
        for batch in batches:
            texts, doc_ids = batch["text"].tolist(), batch["doc_id"].astype("Int64").to_numpy(object) if batch["doc_id"].isna().any() else batch["doc_id"].to_numpy(np.int64)
            for lo, hi in by_bytes([len(t) for t in texts]):
                ids, bounds = encoder.encode(texts[lo:hi])
                ids = np.insert(ids, bounds[1:], end_id).astype("<u4")
                n = np.diff(bounds) + 1
                doc, size = pieces_of(n, length)
                stop = np.cumsum(size)
                raw, cuts = memoryview(ids).cast("B"), (4 * stop).tolist()
                kind = np.log2(size).astype(np.int64)
                at = np.empty(len(size), np.int64)  # the place among the sequences of its length
                for k in range(len(filled)):
                    own = kind == k
                    at[own] = filled[k] + np.arange(own.sum())
                    filled[k] += own.sum()
                out = {
                    "doc_id": pd.array(doc_ids[lo:hi][doc], "Int64"),
                    "start": stop - size - (np.cumsum(n) - n)[doc],
                    "length": size,
                    "ids_crc32": [zlib.crc32(raw[a:b]) for a, b in zip([0, *cuts[:-1]], cuts, strict=True)],
                    "doc_tokens": n[doc],
                    "sequence_id": base + made + np.arange(len(size)),
                    "offset": np.zeros(len(size), np.int64),
                    "bucket": size.astype(np.int32),
                    "batch_id": base + at * size // batch_tokens * length.bit_length() * 2 + kind + 1,
                }
                made += len(size)
                yield pd.DataFrame(out | ({"ids": np.split(ids.astype(np.int32), stop[:-1])} if with_ids else {}))

    schema = T.StructType([*SCHEMA.fields, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInPandas(leaving_little(run), schema)
