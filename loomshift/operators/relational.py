"""Relational operators with a choice that Catalyst can't make alone: semi-bounded broadcasts and skew-safe grouping.

Everything else of the relational surface is plain DataFrame or SQL text (see plans/relational.py): joins, grouping, sorting
and limits are left to the optimizer and to adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side of unknown size may be sent to all tasks.
MOST_SENT_ROWS = 1_000_000


def join_checked(left: DataFrame, right: DataFrame, on: Column | str | list[str], how: str = "inner", most_rows: int = MOST_SENT_ROWS) -> DataFrame:
    """A join that broadcasts `right` only if a count shows that it is small; a shuffle join, split where skewed, otherwise."""
    small = right.limit(most_rows + 1).count() <= most_rows
    return left.join(F.broadcast(right) if small else right, on, how)


def range_join(left: DataFrame, right: DataFrame, at: str, start: str, end: str, width: int) -> DataFrame:
    """Rows of `left` with start <= at < end of a row of `right`, by buckets of `width`: an equi-join instead of a nested loop."""
    points = left.withColumn("__bucket", F.floor(F.col(at) / width))
    spans = right.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    return points.join(spans, "__bucket").where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__bucket")


def grouped_salted(df: DataFrame, keys: list[str], salts: int, partial: dict[str, Column], final: dict[str, Column]) -> DataFrame:
    """Grouping in two shuffles: `partial` by key and salt, `final` by key. For aggregates that keep rows, where Spark's own partial step saves nothing."""
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*[c for c in df.columns if c not in keys] or keys), F.lit(salts)))
    first = salted.groupBy(*keys, "__salt").agg(*[c.alias(n) for n, c in partial.items()])
    return first.groupBy(*keys).agg(*[c.alias(n) for n, c in final.items()])


def distinct_on(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row for each key, the one with the largest `order`: an aggregation, without a sort of each group."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), order).alias("__best"))
    return best.select(*[F.col(f"`{c}`") if c in keys else F.col(f"__best.`{c}`").alias(c) for c in df.columns])
