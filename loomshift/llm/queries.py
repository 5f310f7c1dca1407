"""The registered queries of the llm operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomshift.llm import chat, exact_dedup, language, near_dedup, neighbours, packing, pii, quality, sentencepiece_bpe, toxicity
from loomshift.plans.registry import Query
from loomshift.sources.tables import table

QUERIES: dict[str, Query] = {}


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(by: int) -> Column:
    """The fold of a document: the CRC-32 of its id as text, modulo `by`."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(by))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learnt from the labels outside fold 2 of 4."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")).where(remainder(4) != 2)
    out = toxicity.score(docs, toxicity.fit(docs, labels))
    return out.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES["op1_toxicity"] = Query(op1_toxicity)


def language_model(docs: DataFrame) -> language.Model:
    """Learnt from text and language of the documents outside fold 1 of 3."""
    return language.fit(docs.where(F.coalesce(remainder(3) != 1, F.lit(True))))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language.identify(docs, language_model(docs))
    return out.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES["op3_language"] = Query(op3_language)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of equal texts."""
    return exact_dedup.assign_groups(table(spark, sf_dir, "documents"))


QUERIES["op5_exact_dedup"] = Query(
    op5_exact_dedup,
    """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
              row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
              sha256(coalesce(text, '')) AS text_sha256
       FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


QUERIES["op6_packing"] = Query(op6_packing)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of every document."""
    return pii.find(table(spark, sf_dir, "documents"))


QUERIES["op10_pii"] = Query(op10_pii)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again."""
    return sentencepiece_bpe.encode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


QUERIES["op7_sentencepiece"] = Query(op7_sentencepiece)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that quotes control strings, formatted as prefix trees and read back from them."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    quoted = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(quoted).alias("text")
    )
    path = vocabulary("byte_bpe_50k.tiktoken")
    return chat.read_back(chat.trees(rows.unionByName(extra), path), path)


QUERIES["op8_chat"] = Query(op8_chat)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of near copies."""
    return near_dedup.group(table(spark, sf_dir, "documents"))


QUERIES["op4_near_dedup"] = Query(op4_near_dedup)


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of each whose id is divisible by 20."""
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(20)) == 0, 20)


QUERIES["op2_neighbours"] = Query(op2_neighbours)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The perplexity of every document under a model of the documents labelled good."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality.classify(table(spark, sf_dir, "documents"), trusted)


QUERIES["op9_quality"] = Query(op9_quality)
