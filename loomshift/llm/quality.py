"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

Symbols are whole characters as they are, in any script, and the model is that of char_model: counts of all trusted text,
dealt to shards and joined there, without a fixed alphabet or table size. classify() pre-aggregates the documents' grams by
blocks of documents and joins them with the shards.

A document's threshold is that of its language: the quantile QUANTILE of the trusted documents' mean log-likelihoods per
symbol, widened by SHORT / sqrt(n) for a text of n symbols, whose mean varies more. Documents beyond it are rejected.

Nulls and ties: a null or empty text has no perplexity (null) and is rejected. A null language is a group of its own; a
language without trusted documents has the threshold of all. A trusted id that repeats counts once; documents that repeat
an id are counted and scored each. Without trusted text nothing is rejected but empty texts. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomshift.llm import char_model
from loomshift.llm.shared import arrow_rows, text_of, tidy, written

QUANTILE = 0.999
SHORT = 2.0
#: Trusted ids up to which they are sent to all tasks (8 bytes each); more are joined by a shuffle.
MOST_SENT = 2_000_000


def classify(docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """doc_id, lang, perplexity, threshold (of a long text of the language) and kept for each row of `docs` (doc_id, text, lang).

    trusted_ids: doc_id of the documents whose text the model is trained on.
    """
    arrow_rows(docs.sparkSession)
    ids = written(trusted_ids.select("doc_id").where("doc_id is not null").distinct(), "trusted")
    near = F.broadcast(ids) if ids.count() <= MOST_SENT else ids
    with tidy() as kept_tables:
        table = written(char_model.counts(docs.select("doc_id", "text").join(near, "doc_id", "left_semi")), "counts")
        rows = None if table.isEmpty() else char_model.scored(docs, char_model.train(table))
        kept_tables += [] if rows is None else [rows]
    if rows is None:
        plain = docs.select("doc_id", "lang", F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), (F.length(text_of()) > 0).alias("kept"))
        return plain
    level = F.percentile_approx(F.col("nll") - SHORT / F.sqrt("n_symbols"), QUANTILE, 10_000)
    known = rows.where("nll is not null").join(near, "doc_id", "left_semi")
    overall = known.agg(level.alias("x")).first().x
    limits = known.groupBy("lang").agg(level.alias("limit"))  # one row for each language
    found = rows.join(limits.withColumnRenamed("lang", "of"), F.col("lang").eqNullSafe(F.col("of")), "left").withColumn("limit", F.coalesce("limit", F.lit(overall)))
    kept = F.coalesce(F.col("nll") - SHORT / F.sqrt("n_symbols") <= F.col("limit"), F.lit(False))
    return found.select("doc_id", "lang", F.exp("nll").alias("perplexity"), F.exp("limit").alias("threshold"), kept.alias("kept"))
