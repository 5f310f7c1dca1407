"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Three stages, each comparing whole texts (the digest only deals rows out):
1. each task merges equal texts that it has read (the partial aggregation before the shuffle),
2. the partial groups of (digest, text, salt) are merged; the salt spreads a hot text over SALTS tasks,
3. the at most SALTS winners of a text are combined.
Documents then find their group by a join on (digest, salt), which adaptive execution splits further where one text is hot, as
nothing after it needs a key's rows together. If two texts ever share a digest, the documents are matched by text as well;
and if ids repeat, equal rows are numbered by (digest, doc_id) in a step of its own, so that one of them is kept.

Nulls and ties: a null text counts as empty. A null doc_id loses against any other. Of rows that repeat both doc_id and
text, one is kept. Extra columns are not read by `assign_groups`, whatever their names, and are kept by `keep_one`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomshift.llm.shared import text_of, written

SALTS = 16


def _digested(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id",
        text_of().alias("text"),
        F.unhex(F.sha2(text_of(), 256)).alias("digest"),
        F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"),
    )


def assign_groups(docs: DataFrame) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    rows = _digested(docs)
    salted = rows.groupBy("digest", "text", "salt").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    groups = salted.groupBy("digest", "text").agg(
        F.max("keep_id").alias("keep_id"),
        F.sum("n").alias("group_size"),
        F.bit_or(F.expr("shiftleft(1, salt)")).alias("salts"),
    )
    found = written(groups.select("digest", "keep_id", "group_size", "salts"), "exact-groups")
    many = found.where("group_size > 1")
    keys = ["digest", "salt"]
    if not found.groupBy("digest").count().where("count > 1").isEmpty():
        many, keys = groups.where("group_size > 1"), ["digest", "text", "salt"]
    else:
        rows = rows.drop("text")
    spread = F.expr(f"filter(sequence(0, {SALTS - 1}), s -> (shiftright(salts, s) & 1) = 1)")
    many = many.withColumn("salt", F.explode(spread)).drop("salts")
    found = rows.join(many, keys, "left")
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        found = found.withColumn("copy", F.lit(1))
    else:
        again = Window.partitionBy("doc_id", *[k for k in keys if k != "salt"]).orderBy("doc_id")
        found = found.withColumn("copy", F.row_number().over(again))
    return found.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("group_size").isNull() | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: of equal texts, the one with the largest doc_id."""
    row = F.struct(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("held"), F.col("text").isNull().alias("none"))
    rows = docs.select(
        text_of().alias("text"),
        F.unhex(F.sha2(text_of(), 256)).alias("digest"),
        F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"),
        F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("id")).alias("rank"),
        row.alias("row"),
    )
    best = [F.max_by("row", "rank").alias("row"), F.max("rank").alias("rank")]
    found = rows.groupBy("digest", "text", "salt").agg(*best).groupBy("digest", "text").agg(*best)
    return found.select(*[F.when(~F.col("row.none"), F.col("text")).alias(c) if c == "text" else F.col(f"row.held.`{c}`").alias(c) for c in docs.columns])
