"""Mutable tables as append-only change logs: batches of put and delete rows, resolved by latest write wins.

Each row carries the number of its batch and its place in it; the pair orders all writes of a key. A compacted batch is a base:
each key once, no deletes. Reading takes the base's rows whose keys no later batch has, without a shuffle or sort of the base
where the later keys are few enough to be sent out (their number is in the manifest), else by a hash join; and resolves the
later batches by one aggregation of their keys. So a read costs a scan of the base and work in proportion to what came after.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PUT, DELETE = "P", "D"
#: Keys of later batches up to which they are sent to all tasks, and batches after which a base is made anew.
MOST_SENT, MOST_BATCHES = 500_000, 24
META = [T.StructField("__batch", T.LongType()), T.StructField("__row", T.LongType()), T.StructField("__op", T.StringType())]


@dataclass
class Batch:
    """A written batch: its number, its folder below the root, its rows (-1: not counted) and whether it is a base."""

    number: int
    folder: str
    rows: int = -1
    base: bool = False

    def listed(self) -> list:
        """As a manifest holds it."""
        return [self.number, self.folder, self.rows, self.base]


@dataclass
class ChangeLog:
    """One table's log. `batches` is what a manifest (and a transaction's own writes) say."""

    spark: SparkSession
    root: str
    schema: T.StructType
    keys: list[str]
    batches: list[Batch] = field(default_factory=list)

    def stored(self) -> T.StructType:
        return T.StructType([*self.schema.fields, *META])

    def stage(self, rows: DataFrame, number: int, op: str | None = None) -> Batch:
        """Write rows (with an `__op` column unless `op` is given) as a batch that no manifest names yet. Their order is the order of writes."""
        folder = f"batches/{number:012d}-{uuid.uuid4().hex}"
        rows = rows.withColumn("__op", F.lit(op)) if op else rows
        order = F.col("__row") if "__row" in rows.columns else F.monotonically_increasing_id()
        cols = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema.fields]
        rows.select(*cols, F.lit(number).cast("long").alias("__batch"), order.cast("long").alias("__row"), "__op").write.parquet(f"{self.root}/{folder}")
        return Batch(number, folder)

    def compacted(self, number: int) -> Batch:
        """The live rows as one base, in ranges of keys and sorted within files, so that their statistics prune."""
        keys = [F.col(f"`{k}`") for k in self.keys]
        batch = self.stage(self.resolved().repartitionByRange(*keys).sortWithinPartitions(*keys), number, PUT)
        batch.base, batch.rows = True, self.count(batch)
        return batch

    def count(self, batch: Batch, op: str | None = None) -> int:
        rows = self._read([batch])
        return (rows.where(F.col("__op") == op) if op else rows).count()

    def _read(self, batches: list[Batch]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], self.stored())
        return self.spark.read.schema(self.stored()).parquet(*[f"{self.root}/{b.folder}" for b in batches])

    def log(self) -> DataFrame:
        """All writes."""
        return self._read(self.batches)

    def resolved(self) -> DataFrame:
        """The live rows: of each key the latest write, unless that is a delete. A filter on keys reaches the files."""
        base, later = [b for b in self.batches if b.base], [b for b in self.batches if not b.base]
        if not base:
            return resolve(self.log(), self.schema.names, self.keys)
        standing = self._read(base).select(*[F.col(f"`{c}`") for c in self.schema.names])
        if not later:
            return standing
        changed = self._read(later).select(*[F.col(f"`{k}`") for k in self.keys])
        small = all(b.rows >= 0 for b in later) and sum(b.rows for b in later) <= MOST_SENT
        changed = F.broadcast(changed) if small else changed.hint("shuffle_hash")
        return standing.join(changed, self.keys, "left_anti").select(*standing.columns).unionByName(resolve(self._read(later), self.schema.names, self.keys))

    def worth_compacting(self) -> bool:
        """Whether many batches came after the base."""
        return sum(not b.base for b in self.batches) > MOST_BATCHES


def resolve(log: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Latest write wins over any log with the META columns."""
    last = F.max_by(F.struct("__op", *[F.col(f"`{c}`") for c in columns if c not in keys]), F.struct("__batch", "__row")).alias("__last")
    found = log.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(last).where(F.col("__last.__op") == PUT)
    return found.select(*[F.col(f"`{c}`") if c in keys else F.col(f"__last.`{c}`").alias(c) for c in columns])
