"""Toxicity by two class-conditional Kneser-Ney models.

A symbol is the beginning of a word: its first STEM bytes in lower case, a word being a run of letters; so inflected forms of
an expression count together, in any language. Toxic and ordinary training documents each have a model, over words v w:
    P(w | class)    = (1 - g) * f(w) + g * s(w)
    P(w | v, class) = max(n(v w) - D, 0) / n(v) + left(v) * s(w | v) * P(w | class) / s(w)
Counts are Kneser-Ney's: n(w) is the number of different words before w in the documents of the class, n(v w) that before
the pair; so copies of a passage count once. f(w) is what the discount D leaves of n(w), as a share; left(v) is what
discounting sets free in the context v. s() are the backoff counts that both classes share; the share g that goes to them
is the same in both models (the larger one of what D sets free), so a word that neither class knows well tells nothing.
A pair that neither class has seen falls back to its word.

Each word of a text is scored under both models. Where they differ by less than a factor e (RATIO), both are left to the
shared counts; else what lies beyond it counts, for or against. Both log-likelihoods are divided by the number of words, and
their difference goes through a logistic curve, which is fitted on training documents scored by models of the other half.

fit() uses at most `per_class` documents of each class, those with the smallest hash of their id, one row each; all counts
of the sample are made by Spark, and the driver gets the words and pairs beyond RATIO only. score() is a map over whole
texts, in blocks of about BLOCK bytes or one longer text.

Nulls and ties: a null or empty text, or one without a letter, has no words, and the score 0. A document labelled both ways
counts as toxic; null labels and ids are left out. Rows that repeat a doc_id are scored each, and count once in training
(the largest text). Without labels of both kinds every score is 0. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomshift.llm.shared import arrow_rows, by_bytes, drop_written, leaving_little, mix64, text_of, written

STEM = 6
D = 4
RATIO = math.e
BLOCK = 1_500_000
#: A pair is kept where its evidence differs from its word's by this much.
DIFFERS = 0.1
#: Models of both folds, and of all.
MODELS = ("a", "b", "all")
_LETTER = np.full(256, 32, np.uint8)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def stems(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The stem of each word as a number, in order, and the place of each one's text."""
    raw = [b" " + t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = _LETTER[np.frombuffer(b"".join(raw) + b" " * STEM, np.uint8)]
    begin = np.flatnonzero((data[:-1] == 32) & (data[1:] != 32)) + 1
    out, live = np.zeros(len(begin), np.int64), np.ones(len(begin), bool)
    for j in range(STEM):
        c = data[begin + j]
        live &= c != 32
        out = np.where(live, out << 8 | c, out)
    return out, np.searchsorted(np.cumsum([len(r) for r in raw]), begin, side="right")


def _before(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The word before each; 0 at a text's start."""
    out = np.zeros(len(words), np.int64)
    out[1:] = np.where(doc[1:] == doc[:-1], words[:-1], 0)
    return out


def _pairs(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix64(mix64(before.view(np.uint64)) + words.view(np.uint64))


@dataclass
class Evidence:
    """Sorted words and pairs (as hashes), with what their log-likelihoods differ by beyond RATIO: above 0 for toxic ones."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    word_weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    pair_weight: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def difference(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The toxic log-likelihood of each text less the ordinary one, both by the number of words; and that number."""
        out, size = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for lo, hi in by_bytes([len(t) for t in texts], BLOCK):
            words, doc = stems(texts[lo:hi])
            weight = np.zeros(len(words))
            for keys, known, held in ((words, self.words, self.word_weight), (_pairs(_before(words, doc), words), self.pairs, self.pair_weight)):
                if len(known):
                    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                    hit = known[at] == keys
                    weight[hit] = held[at[hit]]
            size[lo:hi] = np.bincount(doc, minlength=hi - lo)
            out[lo:hi] = np.bincount(doc, weight, minlength=hi - lo) / np.maximum(size[lo:hi], 1)
        return out, size


@dataclass
class Model:
    """What score() needs: the evidence and the logistic curve."""

    evidence: Evidence
    slope: float
    shift: float


def _felt(difference: np.ndarray) -> np.ndarray:
    """The difference on the curve's scale: one strong word among a hundred is about 2, a hundred of them about 6."""
    return np.arcsinh(200 * difference)


def _beyond(log: Column) -> Column:
    return F.signum(log) * F.greatest(F.abs(log) - math.log(RATIO), F.lit(0.0))


def _counted(sample: DataFrame) -> DataFrame:
    """(v, w, in, n0_*, n1_*): each pair, the cells (label and fold) that hold it as bits, and the different words before it by model and label."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, cell = batch["text"].tolist(), np.left_shift(1, (batch["label"] * 2 + batch["fold"]).to_numpy(np.int64))
            for lo, hi in by_bytes([len(t) for t in texts], BLOCK):
                words, doc = stems(texts[lo:hi])
                v = _before(words, doc)
                yield pd.DataFrame({"u": _before(v, doc), "v": v, "w": words, "in": cell[lo:hi][doc]}).drop_duplicates()

    runs = sample.mapInPandas(leaving_little(run), "u long, v long, w long, in long").groupBy("u", "v", "w").agg(F.bit_or("in").alias("in"))
    return runs.groupBy("v", "w").agg(F.bit_or("in").alias("held"), *_sums(F.col("in"))).withColumnRenamed("held", "in")


def _sums(held: Column) -> list[Column]:
    """How many rows each label of each model holds. held: bits of 2 * label + fold."""
    masks = {"a": 1, "b": 2, "all": 3}
    return [F.count_if(held.bitwiseAND(F.lit(masks[m] << 2 * c)) != 0).alias(f"n{c}_{m}") for m in MODELS for c in (0, 1)]


def _cut(n: str) -> Column:
    return F.least(F.col(n), F.lit(D))


def evidence(pairs: DataFrame) -> dict[str, Evidence]:
    """The evidence of each model, from the counts of _counted()."""
    words = pairs.groupBy("w").agg(*_sums(F.col("in")))
    cells = [f"{c}_{m}" for m in MODELS for c in (0, 1)]
    total = words.agg(*[F.coalesce(F.sum(f"n{x}"), F.lit(0)).alias(f"t{x}") for x in cells], *[F.coalesce(F.sum(_cut(f"n{x}")), F.lit(0)).alias(f"r{x}") for x in cells]).first()
    models = [m for m in MODELS if all(total[f"t{c}_{m}"] > total[f"r{c}_{m}"] for c in (0, 1))]
    out = {m: Evidence() for m in MODELS}
    if not models:
        return out
    for m in models:
        g = max(total[f"r{c}_{m}"] / total[f"t{c}_{m}"] for c in (0, 1))
        shared = (F.col(f"n0_{m}") + F.col(f"n1_{m}")) / (total[f"t0_{m}"] + total[f"t1_{m}"])
        for c in (0, 1):
            own = (F.col(f"n{c}_{m}") - _cut(f"n{c}_{m}")) / (total[f"t{c}_{m}"] - total[f"r{c}_{m}"])
            words = words.withColumn(f"over{c}_{m}", F.try_divide((1 - g) * own, shared) + g)  # P(w | class) / s(w); null where the model has no w
    words = words.select("w", *[f"over{c}_{m}" for m in models for c in (0, 1)], *[_beyond(F.log(F.col(f"over1_{m}") / F.col(f"over0_{m}"))).alias(f"x_{m}") for m in models])
    words = written(words, "toxicity-words")
    found = pairs.join(words, "w")
    back = {f"{c}_{m}": (F.col(f"n0_{m}") + F.col(f"n1_{m}")) * F.col(f"over{c}_{m}") for m in models for c in (0, 1)}
    sums = [x for k, b in back.items() for x in (F.sum(f"n{k}").alias(f"t{k}"), F.sum(_cut(f"n{k}")).alias(f"r{k}"), F.sum(b).alias(f"b{k}"))]
    found = found.join(found.groupBy("v").agg(*sums), "v")
    for k, b in back.items():
        left = F.coalesce(F.try_divide(F.col(f"r{k}"), F.col(f"t{k}")), F.lit(1.0))
        found = found.withColumn(f"p{k}", (F.col(f"n{k}") - _cut(f"n{k}")) / F.greatest(F.col(f"t{k}"), F.lit(1)) + left * F.try_divide(b, F.col(f"b{k}")))
    found = found.select("v", "w", *[F.when(F.col(f"n0_{m}") + F.col(f"n1_{m}") > 0, _beyond(F.log(F.col(f"p1_{m}") / F.col(f"p0_{m}")))).alias(f"y_{m}") for m in models], *[f"x_{m}" for m in models])
    for m in models:
        found = found.withColumn(f"y_{m}", F.when(F.abs(F.col(f"y_{m}") - F.col(f"x_{m}")) > DIFFERS, F.col(f"y_{m}")))
    kept_pairs = found.where(" or ".join(f"y_{m} is not null" for m in models)).select("v", "w", *[f"y_{m}" for m in models]).toPandas()
    kept_words = words.where(" or ".join(f"x_{m} <> 0" for m in models)).select("w", *[f"x_{m}" for m in models]).toPandas()
    drop_written(words)
    for m in models:
        w = kept_words[kept_words[f"x_{m}"].fillna(0) != 0].sort_values("w")
        p = kept_pairs[kept_pairs[f"y_{m}"].notna()]
        keys = _pairs(p["v"].to_numpy(np.int64), p["w"].to_numpy(np.int64))
        order = np.argsort(keys)
        out[m] = Evidence(w["w"].to_numpy(np.int64), w[f"x_{m}"].to_numpy(float), keys[order], p[f"y_{m}"].to_numpy(float)[order])
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method, with a small ridge."""
    design, beta = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2), design.T @ (y - p) - 1e-2 * beta)
        beta = beta + np.clip(step, -4, 4)
        if abs(step).max() < 1e-6:
            break
    return float(beta[0]), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4000) -> Model:
    """docs: doc_id, text. labels: doc_id, label (1 toxic, 0 not). At most `per_class` documents of each label are used."""
    spark = docs.sparkSession
    arrow_rows(spark)
    known = labels.select("doc_id", F.col("label").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("order", F.xxhash64("doc_id", F.lit("toxicity")))
    picked = known.where("label = 0").orderBy("order", "doc_id").limit(per_class).union(known.where("label = 1").orderBy("order", "doc_id").limit(per_class))
    # at most 2 * per_class rows of three numbers
    held = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(picked), "doc_id")
    sample = held.groupBy("doc_id", "label", "order").agg(F.max("text").alias("text"))
    sample = written(sample.select("text", "label", F.pmod("order", F.lit(2)).cast("int").alias("fold")), "toxicity-sample")
    pairs = written(_counted(sample), "toxicity-pairs")
    models = evidence(pairs)

    def crossed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for fold, other in ((0, "b"), (1, "a")):
                part = batch[batch["fold"] == fold]
                if len(part):
                    yield pd.DataFrame({"x": models[other].difference(part["text"].tolist())[0], "y": part["label"].astype(float)})

    got = sample.mapInPandas(leaving_little(crossed), "x double, y double").toPandas()
    drop_written(sample)
    drop_written(pairs)
    if not len(models["all"].words) or got["y"].nunique() < 2:
        return Model(models["all"], 0.0, -30.0)
    rate = got["y"].mean()
    shares = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    slope, shift = _logistic(_felt(got["x"].to_numpy()), got["y"].to_numpy())
    prior = shares[1] / (shares[0] + shares[1])
    return Model(models["all"], slope, shift + math.log(prior / (1 - prior)) - math.log(rate / (1 - rate)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, from 0 to 1, for each row of `docs`."""
    arrow_rows(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample of fit()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = sent.value
        for batch in batches:
            x, size = known.evidence.difference(batch["text"].tolist())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": np.where(size > 0, 1 / (1 + np.exp(-np.clip(known.slope * _felt(x) + known.shift, -30, 30))), 0.0)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInPandas(leaving_little(run), f"doc_id {kind}, score double")
