import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from loomshift.llm import packing
from loomshift.llm.word_bpe import WordBPE

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_pieces_are_powers_of_two():
    sizes = [1, 2, 3, 2047, 2048, 2049, 10_000, 4096]
    doc, cut = packing.pieces_of(np.array(sizes), 2048)
    for i, n in enumerate(sizes):
        own = cut[doc == i].tolist()
        assert sum(own) == n and all(x & (x - 1) == 0 and x <= 2048 for x in own) and own == sorted(own, reverse=True)
        assert len(own) == n // 2048 + bin(n % 2048).count("1")


def test_ids_equal_the_library(spark):
    texts = [None, "", "Don't stop, it's 12:30!", "naïve straße Œuvre ½ Σας İ", "x <|endoftext|> y", "wörd " * 3000, "a" * 500, "don't don't"]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate([*texts, texts[2]])], "doc_id long, text string, length string")
    slow = Tokenizer.from_file(PATH)
    rows = packing.pack(docs, PATH, with_ids=True).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    for i, t in enumerate([*texts, texts[2]]):
        ids = [*slow.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == ids
        assert all(r.doc_tokens == len(ids) and r.offset == 0 and r.length & (r.length - 1) == 0 for r in own)
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_ids_equal_the_library_on_odd_texts():
    rng = np.random.default_rng(7)
    parts = ["'s", "'ll", "'", "''", "don't", "x's9", "'re'", "_", "__a", "é", "ÉÀ", "Ⱥ", "Ɓ", "€5", "«x»", "…", "\u00a0", "\t", "12", "a1b2", "!?", "'tis", "'vE", "w" * 47, "w" * 48, "w" * 49, "é" * 30, "<|end", "-", "ǅ", " ", "  ", "\n"]
    texts = ["".join(parts[i] for i in rng.integers(0, len(parts), n)) for n in rng.integers(0, 40, 3000)]
    texts += [" ".join(parts[i] for i in rng.integers(0, len(parts), n)) for n in rng.integers(0, 40, 500)] + ["'", "'s", "a'", "'r", "x" * 5000]
    ids, bounds = WordBPE(PATH).encode(texts)
    slow = Tokenizer.from_file(PATH)
    for t, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        assert ids[a:b].tolist() == slow.encode(t, add_special_tokens=False).ids, t


def test_cache_that_starts_anew_gives_the_same_ids():
    texts = [f"word{i} stem{i % 7} {'ab' * (i % 9)}" for i in range(500)]
    whole, small = WordBPE(PATH), WordBPE(PATH)
    small.cache.most = 40
    want = whole.encode(texts)
    got = [small.encode([t]) for t in texts]
    assert np.concatenate([g[0] for g in got]).tolist() == want[0].tolist()


def test_batches_hold_equal_lengths(spark):
    docs = spark.createDataFrame([(i, "word " * i) for i in range(300)], "doc_id long, text string")
    found = {}
    for r in packing.pack(docs, PATH, batch_tokens=256).collect():
        found.setdefault(r.batch_id, []).append(r.length)
    assert all(len(set(x)) == 1 and sum(x) <= max(256, x[0]) for x in found.values())
