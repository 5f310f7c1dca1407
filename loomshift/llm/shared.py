"""What several of the operators need: shared-folder tables, and text as numpy arrays."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it. A temporary one is set only in local mode, and only where none is."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="loomshift-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Tables in the shared folder that stand, as lazy results may still read them. They go with the driver's process at last.
_WRITTEN: dict[str, SparkSession] = {}
#: The paths that this thread has written since the innermost tidy().
_MADE = threading.local()


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _drop_all() -> None:
    for path, spark in _WRITTEN.items():
        with contextlib.suppress(Exception):  # the session may have ended
            _delete(spark, path)


def written(df: DataFrame, name: str = "part") -> DataFrame:
    """`df` as a table in the shared folder: later steps start from its files, whichever executors are lost."""
    path = f"{shared_dir(df.sparkSession)}/loomshift/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN[path] = df.sparkSession
    if hasattr(_MADE, "paths"):
        _MADE.paths.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.loomshift_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table that written() made and nothing reads any more."""
    _delete(df.sparkSession, df.loomshift_path)
    _WRITTEN.pop(df.loomshift_path, None)


@contextlib.contextmanager
def tidy() -> Iterator[list[DataFrame]]:
    """Tables that this thread writes inside go at its end, but for those put into the list."""
    outer, _MADE.paths = getattr(_MADE, "paths", []), []
    kept: list[DataFrame] = []
    try:
        yield kept
    finally:
        stay = [df.loomshift_path for df in kept]
        for path in _MADE.paths:
            if path not in stay and path in _WRITTEN:
                _delete(_WRITTEN.pop(path), path)
        _MADE.paths = outer
        _MADE.paths += stay


#: Bytes of an Arrow batch, beyond which it ends (a longer row is one by itself), and its rows.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4096
#: MB that a Python worker may keep for its next work.
KEPT_MB = 160


def lean() -> None:
    """Give the memory of finished work back to the system, as workers are kept for later stages."""
    with contextlib.suppress(OSError, AttributeError), open("/proc/self/statm") as f:
        if int(f.read().split()[1]) * 4096 > KEPT_MB << 20:
            pa.default_memory_pool().release_unused()
            ctypes.CDLL(None).malloc_trim(0)


def leaving_little(run: Callable) -> Callable:
    """A function over batches that gives its memory back when it ends."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            lean()

    return wrapped


_SHIPPED: set[str] = set()


def arrow_rows(spark: SparkSession) -> None:
    """Before Python code runs on executors: Arrow batches bounded by bytes and rows, the same for all operators, and the package sent along once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp(prefix="loomshift-")) / "loomshift_code.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(path))
        _SHIPPED.add(sc.applicationId)


def text_of(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def flat_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts as one uint8 array, and the offsets of their starts (one more than texts)."""
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=ends[1:])
    return np.frombuffer(b"".join(texts), np.uint8), ends


def by_bytes(sizes: list[int], most: int = 4_000_000) -> list[tuple[int, int]]:
    """Ranges of consecutive texts that hold about `most` bytes (a longer text has a range of its own), so that memory follows the longest text at most."""
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            out.append((start, i))
            start, total = i, 0
        total += n
    if start < len(sizes):
        out.append((start, len(sizes)))
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit changes each output bit half of the time."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x
