import math
import random
from collections import Counter

import numpy as np

from loomshift.llm import quality, queries

DATA = "/root/testdata/sf0.01"


def test_junk_is_rejected_and_trusted_text_stays(spark):
    out = queries.op9_quality(spark, DATA).toPandas()
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas()
    both = out.merge(labels, on="doc_id")
    print(both.groupby("quality").kept.mean())
    assert len(out) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert both[both.quality == 1].kept.mean() > 0.98 and both[both.quality == 0].kept.mean() < 0.2


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(i % 30, "a plain text of words " * 3, "en", "p") for i in range(40)] + [(50, None, None, "p"), (51, "", "de", "p"), (52, "#$%^" * 60_000, None, "p")], "doc_id long, text string, lang string, perplexity string")
    ids = spark.createDataFrame([(i,) for i in [*range(20), 3, None]], "doc_id long")
    got = quality.classify(docs, ids)
    assert got.count() == 43 and got.where("kept").count() == 40 and got.where("perplexity is null").count() == 2
    assert quality.classify(docs, ids.limit(0)).where("kept").count() == 41
    assert quality.classify(docs.limit(0), ids).count() == 0


def test_whole_characters_of_any_script_are_told_apart(spark):
    text = "мама мыла раму и папа читал книгу вечером дома "
    mixed = "амма лыма марув и аппа ичталк ингук вечремо адмо "
    rows = [(i, text * 4, "ru") for i in range(20)] + [(50, mixed * 4, "ru"), (51, "12 34 " * 30, "ru"), (52, "98 76 " * 30, "ru")]
    docs = spark.createDataFrame([*rows, (53, "12 34 " * 30, None)], "doc_id long, text string, lang string")
    ids = spark.createDataFrame([(i,) for i in [*range(20), 51]], "doc_id long")
    got = {r.doc_id: r.perplexity for r in quality.classify(docs, ids).collect()}
    assert got[50] > 2 * got[0] and got[52] > 2 * got[51]


def plain_model(trusted):
    """The probability of a gram under the model of some texts, by dictionaries."""
    order = quality.char_model.ORDER
    orders = [{}]
    for t in trusted:
        for g in grams_of(t):
            orders[0][g] = orders[0].get(g, 0) + 1
    for _ in range(order - 1):
        shorter = {}
        for g in orders[-1]:
            shorter[g[1:]] = shorter.get(g[1:], 0) + 1
        orders.append(shorter)

    def discounts(table):
        n = [sum(v == k for v in table.values()) for k in (1, 2, 3, 4)]
        if not n[0] or not n[1]:
            return [0.5, 0.75, 0.9]
        y = n[0] / (n[0] + 2 * n[1])
        return [min(max(k - (k + 1) * y * n[k] / max(n[k - 1], 1), 0.1), k - 0.05) for k in (1, 2, 3)]

    cut = [discounts(t) for t in orders]
    sums = []
    for table, d in zip(orders, cut, strict=True):
        own = {}
        for g, n in table.items():
            total, left = own.get(g[:-1], (0, 0))
            own[g[:-1]] = total + n, left + min(d[min(n, 3) - 1], n)
        sums.append(own)

    def p(g):
        if not g:
            return 1 / (len(orders[-1]) + 1)
        k = order - len(g)
        total, left = sums[k].get(g[:-1], (0, 0))
        if not total:
            return p(g[1:])
        n = orders[k].get(g, 0)
        return (n - min(cut[k][min(n, 3) - 1], n) if n else 0) / total + left / total * p(g[1:])

    return p


def grams_of(text):
    order = quality.char_model.ORDER
    return [("\n" * (order - 1) + text)[i : i + order] for i in range(len(text))]


def nll(text, p):
    return -sum(math.log(p(g)) for g in grams_of(text)) / len(text)


def test_characters_equal_a_plain_model(spark):
    trusted, other = ["the cat sat on the mat", "кот и кит, 猫と犬", "A cat! 12\n"], ["the cat", "кит 猫 zz", "", "\0a"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(trusted + other)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.char_model.scored(docs, quality.char_model.train(quality.char_model.counts(docs.where(f"doc_id < {len(trusted)}").select("text")))).collect()}
    p = plain_model(trusted)
    for i, t in enumerate(trusted + other):
        assert got[i].n_symbols == len(t)
        assert (got[i].nll is None) == (not t) and (not t or math.isclose(got[i].nll, nll(t, p), rel_tol=1e-5))


def test_grams_of_a_block_equal_a_plain_loop():
    texts = ["abc", "", "日本語テスト", "a\nb", "".join(map(chr, range(0x4E00, 0x4E00 + 9000))), "".join(map(chr, range(0x10000, 0x10000 + 70_000)))]
    for some in (texts[:5], texts):
        grams = quality.char_model.Grams(some)
        keys, n = grams.distinct()
        got = dict(zip(grams.spelt(keys), n.tolist(), strict=True))
        want = Counter(g for t in some for g in grams_of("".join(c if grams.number[ord(c)] < 65_535 else "\ufffd" for c in t)))
        assert got == want
        sizes, total = grams.summed(keys, np.ones(len(keys)))
        assert sizes.tolist() == total.tolist() == [len(t) for t in some]


def test_thresholds_and_verdicts_equal_a_plain_version(spark):
    rng = random.Random(6)
    words = {"en": ["the", "cat", "sat", "on", "mat", "dog"], "ru": ["кот", "и", "кит", "дом"]}
    rows = [(i, " ".join(rng.choice(words[g]) for _ in range(rng.randint(3, 30))), g) for i, g in enumerate(["en", "en", "ru"] * 30)]
    rows += [(200, "zq#x " * 20, "en"), (201, "the cat", "de"), (202, "qqqq", None), (203, "", "en"), (204, None, "ru"), (0, rows[0][1], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = set(range(0, 90, 2))
    got = quality.classify(docs, spark.createDataFrame([(i,) for i in [*trusted, 4, 999]], "doc_id long")).collect()
    p = plain_model([t for i, t, _ in rows if i in trusted])
    level = {k: nll(t, p) - quality.SHORT / math.sqrt(len(t)) for k, (_, t, _) in enumerate(rows) if t}

    def limit(held):
        return sorted(held)[math.ceil(quality.QUANTILE * len(held)) - 1]

    known = [k for k, (i, t, _) in enumerate(rows) if i in trusted and t]
    overall = limit([level[k] for k in known])
    limits = {g: limit([level[k] for k in known if rows[k][2] == g]) for g in words}
    want = sorted((str(i), round(math.exp(nll(t, p)), 3) if t else None, round(math.exp(limits.get(g, overall)), 3), bool(t) and level[k] <= limits.get(g, overall) + 1e-9) for k, (i, t, g) in enumerate(rows))
    assert sorted((str(r.doc_id), None if r.perplexity is None else round(r.perplexity, 3), round(r.threshold, 3), r.kept) for r in got) == want
