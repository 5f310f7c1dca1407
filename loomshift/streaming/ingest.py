"""Structured Streaming into the key-value store: each micro-batch is one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from loomshift.sources.kv import KVStore


def ingest_stream(pairs: DataFrame, store: KVStore, checkpoint: str) -> StreamingQuery:
    """Write a stream of (key, value[, __op]) into `store`. The manifest holds the last epoch of each checkpoint, so a micro-batch that is run again is left out."""

    def commit(rows: DataFrame, epoch: int) -> None:
        store.ingest(rows, source=checkpoint, epoch=epoch)

    return pairs.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
