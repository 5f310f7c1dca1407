import importlib.util
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import plain
from loomshift.llm import pii
from loomshift.llm.queries import language_model

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("corpus_pipeline.py is not here", allow_module_level=True)

DATA = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    import corpus_pipeline
    from loomshift.llm.queries import vocabulary

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language_model(docs)
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    kept = {i: t for i, t in rows.items() if plain.accepted(t, model)}
    last = {t: i for i, t in sorted(kept.items())}
    kept = {i: t for t, i in last.items()}
    ids = sorted(kept)
    least = {}
    for i, g in zip(ids, plain.near_groups([kept[i] for i in ids]), strict=True):
        least.setdefault(g, i)
    kept = {k: pii.redacted(kept[k]) for k in least.values()}
    encoder = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = {i: [*encoder.encode(t, add_special_tokens=False).ids, 1] for i, t in kept.items()}
    out = corpus_pipeline.run(spark, DATA).toPandas()
    assert set(out.doc_id) == set(want)
    assert out.groupby("doc_id").length.sum().to_dict() == {i: len(x) for i, x in want.items()}
    assert (out.doc_tokens == out.doc_id.map(lambda i: len(want[i]))).all()
    for r in out.itertuples():
        assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())


def test_stages_keep_the_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns


def test_nulls_repeats_clashing_names_and_empty_tables(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    names = ["row", "key", "near_dedup_key", "digest", "bucket", "known", "order"]
    odd = spark.createDataFrame([(7_000_001, None, "en", "s", 0), (7_000_002, "", "en", None, 0), (None, "½ 12", None, "s", 4)], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.limit(5)).select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
        rows = out.collect()
        assert rows and all(r[n] == f"own {n}" for r in rows for n in names)
        none = stage(spark, docs.limit(0), DATA)
        assert none.columns == docs.columns and none.count() == 0
    assert corpus_pipeline.pack(spark, docs, DATA).select("doc_id").distinct().count() == 63
    assert corpus_pipeline.pack(spark, docs.limit(0), DATA).count() == 0
    cleaned = {r.doc_id: r for r in corpus_pipeline.redact(spark, odd, DATA).collect()}
    assert cleaned[7_000_001].text is None and cleaned[7_000_001].n_chars == 0 and cleaned[7_000_002].n_chars == 0
