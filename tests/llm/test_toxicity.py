import math
import random
import re

import numpy as np

from loomshift.llm import queries, toxicity

DATA = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    out = queries.op1_toxicity(spark, DATA).toPandas()
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas()
    held = out[out.held_out].merge(labels, on="doc_id")
    assert len(out) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    hit = ((held.predicted == 1) & (held.toxic == 1)).sum()
    print("held out", len(held), "toxic", held.toxic.sum(), "found", hit, "false", ((held.predicted == 1) & (held.toxic == 0)).sum())
    assert held.score.between(0, 1).all() and hit >= 0.9 * held.toxic.sum()
    assert ((held.predicted == 1) & (held.toxic == 0)).sum() <= 0.02 * len(held)


def test_stems_equal_a_plain_loop():
    texts = ["Ab, c!", "", "é 12 éclairs", "hello  WORLDwide", "12", "x"]
    words, doc = toxicity.stems(texts)
    want = [(i, int.from_bytes(w.encode()[: toxicity.STEM], "big")) for i, t in enumerate(texts) for w in re.findall(r"[^\W\d_]+", t.lower())]
    assert list(zip(doc.tolist(), words.tolist(), strict=True)) == want


def _varied(n: int, seed: int) -> list[str]:
    """Texts of a small vocabulary; every second one has a word of its class among the others."""
    rng = random.Random(seed)
    plain = [f"word{chr(97 + i // 10)}{chr(97 + i % 10)}" for i in range(60)]
    return [" ".join(w for _ in range(rng.randint(3, 30)) for w in (rng.choice(plain), *([rng.choice(["moron", "scum"] if k % 2 else ["meadow", "gentle"])] if rng.random() < 0.3 else []))) for k in range(n)]


def _plain_evidence(texts: list[str], labels: list[int]):
    """The same by dictionaries: weights of words and pairs."""
    before, pairs = {0: {}, 1: {}}, {0: {}, 1: {}}
    for t, y in zip(texts, labels, strict=True):
        words = ["", "", *[w[:6] for w in t.split()]]
        for u, v, w in zip(words, words[1:], words[2:], strict=False):
            before[y].setdefault(w, set()).add(v)
            pairs[y].setdefault((v, w), set()).add(u)
    n = [{w: len(x) for w, x in before[c].items()} for c in (0, 1)]
    m = [{w: len(x) for w, x in pairs[c].items()} for c in (0, 1)]
    D, beyond = toxicity.D, lambda x: math.copysign(max(abs(x) - 1, 0), x)
    total, cut = [sum(x.values()) for x in n], [sum(min(D, k) for k in x.values()) for x in n]
    g = max(cut[c] / total[c] for c in (0, 1))
    over = [{}, {}]
    for w in {*n[0], *n[1]}:
        shared = sum(x.get(w, 0) for x in n) / sum(total)
        for c in (0, 1):
            over[c][w] = (1 - g) * max(n[c].get(w, 0) - D, 0) / (total[c] - cut[c]) / shared + g
    words = {w: beyond(math.log(over[1][w] / over[0][w])) for w in over[0]}
    out = {}
    for v in {v for c in (0, 1) for v, _ in m[c]}:
        follow = {w for c in (0, 1) for x, w in m[c] if x == v}
        both = {w: m[0].get((v, w), 0) + m[1].get((v, w), 0) for w in follow}
        p = []
        for c in (0, 1):
            t, r = sum(m[c].get((v, w), 0) for w in follow), sum(min(D, m[c].get((v, w), 0)) for w in follow)
            back = {w: both[w] * over[c][w] for w in follow}
            p.append({w: max(m[c].get((v, w), 0) - D, 0) / max(t, 1) + (r / t if t else 1) * back[w] / sum(back.values()) for w in follow})
        out |= {(v, w): beyond(math.log(p[1][w] / p[0][w])) for w in follow}
    return words, {k: x for k, x in out.items() if abs(x - words[k[1]]) > toxicity.DIFFERS}


def test_scores_equal_a_plain_model(spark):
    texts = _varied(160, 1)
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(160)], "doc_id long, label int")
    model = toxicity.fit(docs, labels)
    words, pairs = _plain_evidence(texts, [i % 2 for i in range(160)])
    assert any(x > 0 for x in words.values()) and any(x < 0 for x in words.values())
    new = _varied(40, 2) + ["unheard of words", "", "moron moron", "scum " * 5000]
    want = []
    for t in new:
        own = ["", *[w[:6] for w in t.split()]]
        want.append(sum(pairs.get((v, w), words.get(w, 0.0)) for v, w in zip(own, own[1:], strict=False)) / max(1, len(own) - 1))
    assert np.allclose(model.evidence.difference(new)[0], want)
    out = toxicity.score(spark.createDataFrame([*enumerate(new)], "doc_id long, text string"), model).toPandas().set_index("doc_id")["score"]
    for i, x in enumerate(want):
        assert np.isclose(out[i], 1 / (1 + math.exp(-(model.slope * math.asinh(200 * x) + model.shift))) if new[i] else 0.0)


def test_copies_count_once_and_both_labels_are_toxic(spark):
    texts = _varied(120, 3)
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, label int")
    again = docs.union(docs.where("doc_id < 40")).union(docs)
    twice = labels.union(spark.createDataFrame([(i, 0) for i in range(1, 120, 2)], "doc_id long, label int"))
    a, b = toxicity.fit(docs, labels), toxicity.fit(again, twice)
    assert a.evidence.words.tolist() == b.evidence.words.tolist() and np.allclose(a.evidence.word_weight, b.evidence.word_weight)
    assert toxicity.score(again, a).count() == 280


def test_nulls_empty_tables_and_clashing_names(spark):
    texts = _varied(200, 4) + [None, "", "12 !"]
    docs = spark.createDataFrame([(None if i == 7 else i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, None if i == 5 else i % 2) for i in range(203)] + [(None, 1)], "doc_id long, label int")
    out = toxicity.score(docs, toxicity.fit(docs, labels)).toPandas()
    found = out.set_index("doc_id")["score"]
    assert len(out) == 203 and np.isfinite(found).all() and found[200] == found[201] == found[202] == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs, none).where("score < 0.01").count() == 203
    assert toxicity.score(docs.limit(0), none).count() == 0


def test_ordinary_evidence_counts_against_toxic_evidence(spark):
    texts = _varied(300, 5)
    docs = spark.createDataFrame([*enumerate(texts), (1000, "moron scum"), (1001, "moron gentle meadow gentle meadow"), (1002, "gentle meadow"), (1003, "unknown terms only " * 200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, label int")
    out = toxicity.score(docs, toxicity.fit(docs, labels)).toPandas().set_index("doc_id")["score"]
    assert out[1000] > out[1003] > out[1002] and out[1001] < out[1000]


def test_balanced_sample_and_long_clean_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{DATA}/labels.parquet").selectExpr("doc_id", "toxic as label")
    train = labels.where("pmod(crc32(cast(cast(doc_id as string) as binary)), 4) != 2")
    model = toxicity.fit(docs, train, per_class=300)
    assert (model.evidence.word_weight < 0).any() and (model.evidence.word_weight > 0).any()
    held = docs.join(labels.join(train, "doc_id", "left_anti"), "doc_id")
    out = toxicity.score(held, model).join(held, "doc_id").selectExpr("score", "label", "length(text) n").toPandas()
    clean = out[out.label == 0]
    ranks, toxic = out.score.rank(), out.label == 1
    auc = (ranks[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    print("AUC", auc, "clean long", clean[clean.n > 3000].score.mean(), "short", clean[clean.n <= 1000].score.mean(), "slope", model.slope)
    assert auc > 0.93 and clean[clean.n > 3000].score.mean() < clean[clean.n <= 1000].score.mean()
