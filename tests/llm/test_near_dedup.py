import random
from collections import Counter

import numpy as np

import plain
from loomshift.llm import near_dedup


def corpus(seed=4):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(600)]
    rows = []
    for g in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(40, 200))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 3 + g % 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    return [*rows, (1000, None), (1001, ""), (1002, "two words"), (1003, "Two, words!"), (1004, "!!"), (0, rows[0][1])]


def test_groups_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, key string")
    got = near_dedup.group(docs).collect()
    want = plain.near_groups([t or "" for _, t in rows])
    assert len(got) == len(rows)
    least = {}
    for (i, _), g in zip(rows, want, strict=True):
        least[g] = min(i, least.get(g, i))
    sizes = Counter(want)
    expected = Counter((i, least[g], sizes[g]) for (i, _), g in zip(rows, want, strict=True))
    found = Counter((r.doc_id, r.class_id, r.class_size) for r in got)
    # banding may miss a pair just above the limit: at 0.8 with a chance of 1 in 2000
    assert sum((expected - found).values()) == 0
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(least.values())


def test_small_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LEFT_CHARS", 3000)
    monkeypatch.setattr(near_dedup, "RIGHT_CHARS", 5000)
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    rows = []
    for k in range(60):  # a chain: each is near the next, the first is far from the last
        base = list(base)
        for _ in range(4):
            base[rng.randrange(len(base))] = rng.choice(vocabulary)
        rows.append((k, " ".join(base)))
    want = plain.near_groups([t for _, t in rows])
    got = {r.doc_id: r.class_id for r in near_dedup.group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(set(want)) == len(set(got.values())) and all(got[i] == got[j] for i in got for j in got if want[i] == want[j])


def test_samples_agree_as_often_as_texts_are_similar():
    rng = random.Random(2)
    base = [str(rng.randrange(10_000)) for _ in range(400)]
    other = base[:300] + [str(rng.randrange(10_000)) for _ in range(100)]
    idf = np.linspace(0, 1, near_dedup.FREQUENCY_SLOTS).astype(np.float32)
    keys, weights, bounds = near_dedup.shingles([" ".join(base), " ".join(other)], idf)
    drawn = near_dedup.samples(keys, weights, bounds, 2000)
    true = near_dedup.weighted_jaccard((keys[: bounds[1]], weights[: bounds[1]]), (keys[bounds[1] :], weights[bounds[1] :]))
    assert abs((drawn[0] == drawn[1]).mean() - true) < 0.04


def test_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g"), (None, "a b c d e f g"), (3, "a b c d e f g"), (4, "x " * 30_000)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.class_id, r.class_size) for r in near_dedup.group(docs).collect()) == [("3", 3, 3), ("4", 4, 1), ("None", 3, 3), ("None", 3, 3)]
    assert near_dedup.group(docs.limit(0)).count() == 0 and near_dedup.keep_one(docs.limit(0)).count() == 0


def test_block_similarities_equal_single_ones():
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randint(5, 60))) for _ in range(25)]
    texts += [" ".join(t.split()[:-2] + ["x", "y"]) for t in texts]
    idf = np.linspace(0, 1, near_dedup.FREQUENCY_SLOTS).astype(np.float32)
    keys, weights, bounds = near_dedup.shingles(texts, idf)
    features = [(keys[a:b], weights[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    left, right = np.arange(0, 20), np.arange(10, 50)
    got = near_dedup.overlaps(features, left, right)
    want = [[near_dedup.weighted_jaccard(features[a], features[b]) for b in right] for a in left]
    assert np.allclose(got, want, atol=1e-6)
