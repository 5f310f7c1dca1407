import random

import numpy as np
import public_tokenizers
import sentencepiece

from loomshift.llm import sentencepiece_bpe

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_ids_equal_the_library():
    own, library = sentencepiece_bpe.codec(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(3)
    texts = ["", " ", "  a  b ", "\n\n x\t", "日本語 テスト", "😀😀 é", "a" * 500, "x" + " " * 90, "\x00\x01", "def f(x):\n    return x ** 2  # sq"]
    texts += ["".join(rng.choice("abcdeé 中\n .,'ingthe") for _ in range(rng.randint(1, 80))) for _ in range(800)]
    texts += ["".join(rng.choice(["ha", "ll", "ss", "oo", "the", "ing", "aa", "tion", "00", "==", "\n\n", "--", " ", "▁"]) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    texts += ["ab" * 3000, "".join(rng.choice("etaoinshrdlu") for _ in range(3000))]
    ids, bounds = own.encode(texts)
    for t, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        assert ids[a:b].tolist() == library.encode(t), t
    assert own.decode(ids, bounds) == [t.replace("▁", " ") for t in texts]


def test_compatible_equals_merging_of_the_pair():
    own = sentencepiece_bpe.PieceCodec(PATH)
    rng = np.random.default_rng(5)
    plain = np.array([i for i in own.ids.values() if len(own.pieces[i]) < 9])
    left, right = rng.choice(plain, 20_000), rng.choice(plain, 20_000)
    for a, b, ok in zip(left.tolist(), right.tolist(), own.compatible(left, right).tolist(), strict=True):
        assert ok == (own.merged(own.pieces[a] + own.pieces[b]) == [own.pieces[a], own.pieces[b]]), (own.pieces[a], own.pieces[b])


def test_stores_are_bounded():
    own, whole = sentencepiece_bpe.PieceCodec(PATH), sentencepiece_bpe.codec(PATH)
    own.words.most, own.pair_keys, own.pair_fits = 50, np.zeros(64, np.uint64), np.zeros(64, bool)
    texts = [f"number {i} of {'xyz' * (i % 11)} things" for i in range(300)]
    got = np.concatenate([own.encode([t])[0] for t in texts])
    assert got.tolist() == whole.encode(texts)[0].tolist()
    assert sum(len(p[0]) for p in own.words.parts) <= 50


def test_encode_and_decode_tables(spark):
    texts = [None, "", "Hello  wörld\n", "word " * 20_000, "Hello  wörld\n"]
    docs = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    out = sentencepiece_bpe.encode(docs, PATH, with_ids=True)
    assert out.where("round_trip").count() == 5
    back = {r.doc_id: r.text for r in sentencepiece_bpe.decode(out, PATH).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert sentencepiece_bpe.encode(docs.limit(0), PATH).count() == 0
