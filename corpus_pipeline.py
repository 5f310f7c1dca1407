"""From raw documents to packed sequences: five stages, each on all that the one before kept.

language: documents whose text is rejected go (op 3).
exact copies: of equal texts, the row with the largest doc_id stays (op 5).
near copies: one document of each group stays (op 4).
personal data: spans are replaced by their kind; all documents stay (op 10).
packing: documents become sequences whose lengths are powers of two (op 6).

All stages but the last return the columns of `documents`. Null texts and texts without letters go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomshift.llm import exact_dedup, language, near_dedup, packing, pii
from loomshift.llm.queries import language_model, vocabulary
from loomshift.llm.shared import drop_written, written
from loomshift.sources.tables import table


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null, empty and letterless texts go, as do texts far from every language learnt; repeated rows fare alike; all columns stay."""
    return language.keep_identified(docs, language_model(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts are equal; a null id loses; of rows that repeat id and text one stays; all columns stay."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of a group stays, with each row that has that id and text (null ids last); texts without a word are
    near copies of equal texts only; all columns stay."""
    return near_dedup.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay, repeated ones too; a null text stays null; n_chars follows the new text; other columns are as they were."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every row, repeated ones each; a null or empty text gives the end token; extra columns are not read."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language", keep_languages),
    ("exact copies", drop_copies),
    ("near copies", drop_near_copies),
    ("personal data", redact),
    ("packing", pack),
]

#: Trigram centroids, weighted sampling and tokenizers are beyond SQL; tests/llm compares the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each stage keeps is a table in the shared folder, from which the next one starts, and which then goes."""
    docs, held = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
        if held is not None:
            drop_written(held)
        held = docs
    return STAGES[-1][1](spark, docs, sf_dir)
