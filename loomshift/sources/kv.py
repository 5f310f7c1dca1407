"""An ordered key-value store over one change log: binary keys, half-open range scans, latest write wins."""

from __future__ import annotations

import base64
import contextlib
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomshift.sources.changelog import DELETE, PUT, Batch, ChangeLog, resolve
from loomshift.sources.storage import READERS_SECONDS, ConcurrentCommit, Manifest


class KVError(RuntimeError):
    """The base of the store's errors; `code` is the machine-readable kind."""

    code = "internal_error"


class NotFound(KVError):
    code = "not_found"


class BadRequest(KVError):
    code = "bad_request"


class BatchFailed(BadRequest):
    """An operation of a batch can't be carried out: nothing of the batch is written."""


@dataclass(frozen=True)
class Op:
    """One write: kind is put or delete."""

    kind: str
    key: bytes
    value: bytes | None = None


SCHEMA = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType())])


def as_bytes(x: bytes | str) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x)


#: Pairs of an answer that is one list, and bytes of a value.
MOST_PAIRS, LONGEST_VALUE = 100_000, 64 << 20


def bounded(rows: DataFrame) -> list:
    """The rows of an answer that is one list; too many raise instead of filling the driver."""
    found = rows.limit(MOST_PAIRS + 1).collect()
    if len(found) > MOST_PAIRS:
        raise BadRequest(f"more than {MOST_PAIRS} pairs; set a LIMIT, or stream them")
    return found


class KVStore:
    """The store in the folder `root`. Each call that writes commits one batch in one step."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.manifest = Manifest(spark, self.root, {"batches": [], "next": 1, "epochs": {}, "retired": []})

    def _log(self, state: dict | None = None) -> ChangeLog:
        state = state or self.manifest.latest()[1]
        return ChangeLog(self.spark, self.root, SCHEMA, ["key"], [Batch(*b) for b in state["batches"]])

    def _append(self, rows: DataFrame, count: int = -1, source: str | None = None, epoch: int = 0) -> None:
        """Commit a batch. With a source, only if it has not committed this epoch or a later one before."""
        for _ in range(20):
            version, state = self.manifest.latest()
            if source is not None:
                if state["epochs"].get(source, -1) >= epoch:
                    return
                state["epochs"][source] = epoch
            log = self._log(state)
            batch = log.stage(rows, state["next"])
            batch.rows = log.count(batch) if count < 0 else count
            state["batches"].append(batch.listed())
            state["next"] += 1
            try:
                self.manifest.commit(version, state)
            except ConcurrentCommit:
                self.manifest.files.remove(f"{self.root}/{batch.folder}")
                continue
            if self._log(state).worth_compacting():
                with contextlib.suppress(ConcurrentCommit):  # another writer may do it
                    self.compact()
            return
        raise ConcurrentCommit("too many other writers")

    def table(self) -> DataFrame:
        """The live pairs."""
        return self._log().resolved()

    def get(self, key: bytes | str) -> bytes:
        """The value of a key. The filter reaches the files, so only row groups that may hold the key are read."""
        found = self.table().where(F.col("key") == F.lit(as_bytes(key))).head()
        if found is None:
            raise NotFound(f"no such key: {as_bytes(key)!r}")
        return bytes(found["value"])

    def scan(self, start: bytes | str | None = None, end: bytes | str | None = None, limit: int = 0, offset: int = 0) -> DataFrame:
        """Pairs with start <= key < end in order of key; a missing bound is open, a limit of 0 or less is none."""
        rows = self.table()
        if start is not None:
            rows = rows.where(F.col("key") >= F.lit(as_bytes(start)))
        if end is not None:
            rows = rows.where(F.col("key") < F.lit(as_bytes(end)))
        rows = rows.orderBy("key")
        rows = rows.offset(offset) if offset > 0 else rows
        return rows.limit(limit) if limit > 0 else rows

    def stream(self, start: bytes | str | None = None, end: bytes | str | None = None) -> Iterator[tuple[bytes, bytes]]:
        """The pairs of a scan, fetched a partition at a time."""
        return ((bytes(r["key"]), bytes(r["value"])) for r in self.scan(start, end).toLocalIterator())

    def put(self, key: bytes | str, value: bytes | str) -> None:
        self.batch([Op("put", as_bytes(key), as_bytes(value))])

    def delete(self, key: bytes | str) -> None:
        """Deleting a missing key is no error."""
        self.batch([Op("delete", as_bytes(key))])

    def batch(self, ops: list[Op]) -> int:
        """All operations in order, as one commit."""
        for op in ops:
            if op.kind not in ("put", "delete") or not op.key or op.kind == "put" and not op.value or op.value is not None and len(op.value) > LONGEST_VALUE:
                raise BatchFailed(f"can't carry out {op.kind} of {op.key[:40]!r}")
        if ops:
            rows = [(op.key, op.value, PUT if op.kind == "put" else DELETE, i) for i, op in enumerate(ops)]
            self._append(self.spark.createDataFrame(rows, "key binary, value binary, __op string, __row long"), len(rows))
        return len(ops)

    def ingest(self, rows: DataFrame, source: str | None = None, epoch: int = 0) -> None:
        """Put all pairs of a DataFrame (key, value), as one commit. Rows with an `__op` of D are deletes. A source's epoch is committed once."""
        rows = rows if "__op" in rows.columns else rows.withColumn("__op", F.lit(PUT))
        self._append(rows, -1, source, epoch)

    def compact(self) -> None:
        """Rewrite the live pairs as one base. The batches before it go when no reader should still need them."""
        version, state = self.manifest.latest()
        log = self._log(state)
        batch = log.compacted(state["next"])
        retired = state["retired"] + [[time.time(), b.folder] for b in log.batches]
        self.manifest.commit(version, state | {"batches": [batch.listed()], "next": state["next"] + 1, "retired": [r for r in retired if time.time() - r[0] <= READERS_SECONDS]})
        self.manifest.sweep(self.root, retired)

    def merged(self, runs: list[DataFrame]) -> DataFrame:
        """Several runs (key, value, null value: deleted), newest first, as one: the newest wins."""
        parts = [r.select("key", "value", F.lit(-i).cast("long").alias("__batch"), F.lit(0).cast("long").alias("__row"), F.when(F.col("value").isNull(), DELETE).otherwise(PUT).alias("__op")) for i, r in enumerate(runs)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return resolve(out, ["key", "value"], ["key"]).orderBy("key")

    def stats(self) -> dict:
        state = self.manifest.latest()[1]
        return {"batches": len(state["batches"]), "bytes": sum(self.manifest.files.size(f"{self.root}/{b[1]}") for b in state["batches"]), "keys": self._log(state).resolved().count()}

    def health(self) -> dict:
        """Whether the store's manifest can be read."""
        try:
            return {"status": "ok", "version": self.manifest.latest()[0]}
        except Exception as e:
            return {"status": "error", "message": str(e)[:200]}

    def metrics(self) -> DataFrame:
        """The statistics as rows of name and value."""
        return self.spark.createDataFrame([(k, float(v)) for k, v in self.stats().items()], "name string, value double")


class KVClient:
    """The methods that a network client would have, on a store in process."""

    def __init__(self, store: KVStore) -> None:
        self.store = store

    def get(self, key: str) -> bytes | None:
        try:
            return self.store.get(key)
        except NotFound:
            return None

    def get_str(self, key: str, encoding: str = "utf-8") -> str | None:
        found = self.get(key)
        return None if found is None else found.decode(encoding)

    def put(self, key: str, value: bytes | str) -> None:
        self.store.put(key, value)

    def delete(self, key: str) -> None:
        self.store.delete(key)

    def scan(self, start: str | None = None, end: str | None = None, limit: int = 0) -> list[tuple[str, bytes]]:
        """At most MOST_PAIRS pairs, as the answer is one list; stream() has no such bound."""
        return [(bytes(r["key"]).decode(), bytes(r["value"])) for r in bounded(self.store.scan(start, end, limit))]

    def stream(self, start: str | None = None, end: str | None = None) -> Iterator[tuple[str, bytes]]:
        return ((k.decode(), v) for k, v in self.store.stream(start, end))

    def query_raw(self, text: str) -> dict:
        """The answer to a command in the JSON form: values in base64."""
        from loomshift.sources.kvql import run

        try:
            return {"status": "ok", **run(self.store, text)}
        except KVError as e:
            return {"status": "error", "code": e.code, "message": str(e)}

    def batch(self) -> BatchWriter:
        return BatchWriter(self.store)

    def stats(self) -> dict:
        return self.store.stats()

    def compact(self) -> None:
        self.store.compact()


class BatchWriter:
    """Buffers writes and sends them in chunks; a clean exit of the `with` block flushes, an exception drops the rest."""

    def __init__(self, store: KVStore, chunk: int = 1000) -> None:
        self.store, self.chunk, self.ops = store, chunk, []

    def put(self, key: str, value: bytes | str) -> BatchWriter:
        self.ops.append(Op("put", as_bytes(key), as_bytes(value)))
        return self._full()

    def delete(self, key: str) -> BatchWriter:
        self.ops.append(Op("delete", as_bytes(key)))
        return self._full()

    def _full(self) -> BatchWriter:
        if len(self.ops) >= self.chunk:
            self.flush()
        return self

    def flush(self) -> int:
        sent = self.store.batch(self.ops)
        self.ops = []  # a failed flush keeps them
        return sent

    def __enter__(self) -> BatchWriter:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.flush()


def encoded(value: bytes) -> str:
    return base64.b64encode(value).decode()
