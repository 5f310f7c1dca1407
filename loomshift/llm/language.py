"""Language identification by nearest centroids.

A text's features are its letter trigrams: bytes of the lower-cased text, runs of anything but letters being one space,
hashed to DIMS places. A vector holds log(1 + count) x inverse document frequency, divided by its length. Each language has
up to CLUSTERS centroids, found by spherical k-means over its own training vectors (seeds by k-means++ with a fixed seed),
since one language comes in several kinds of text; a cluster of less than LEAST of them is dissolved. A text gets the
language of the centroid with the largest cosine, and is rejected where that cosine is under the language's limit. As a short
text lies farther from any centroid than a long one, limits are by length: for each of LENGTHS trigrams, SLACK times the
quantile FAR_OUT of the cosines of so long pieces of the training texts; in between by the logarithm of the length.

fit() uses at most `per_language` texts of each of the `most_languages` most frequent languages (256 by default; ties by
name), the different texts with the smallest hashes; document frequencies and clusters are made on executors, one language a
group, so a group is bounded by that parameter, and the driver gets centroids only. identify() is a map over all documents
with whole texts.

Nulls and ties: a text that is null or has no letter (numerals are none) is `und`, with score 0, and is rejected. Equal
cosines go to the language first in order. Rows that repeat a doc_id are scored each; repeated texts count once in training.
Without training texts every text is `und`. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomshift.llm.shared import arrow_rows, by_bytes, drop_written, lean, leaving_little, text_of, written

DIMS = 8192
CLUSTERS = 4
LEAST = 0.02
FAR_OUT = 0.005
SLACK = 0.8
LENGTHS = np.array([1, 4, 16, 64, 256, 1024])
_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_WORD_SIGN = re.compile(r"[^\W\d_]")


@dataclass
class Model:
    """Names and limits (by length) of each centroid; the centroids already hold the inverse document frequencies."""

    names: list[str]
    limits: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray


def counts_of(texts: list[str]) -> np.ndarray:
    """The trigram counts of each text, DIMS wide."""
    raw = [b" " + t.lower().encode("utf-8", "surrogatepass") + b" " for t in texts]
    data = _LETTER[np.frombuffer(b"".join(raw), np.uint8)]
    doc = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    single = np.ones(len(data), bool)
    single[1:] = (data[1:] != 32) | (data[:-1] != 32) | (doc[1:] != doc[:-1])
    data, doc = data[single].astype(np.uint32), doc[single]
    gram = (data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * np.uint32(2654435761)
    whole = doc[:-2] == doc[2:]
    place = (gram >> np.uint32(19)).astype(np.int64) + doc[:-2] * DIMS
    return np.bincount(place[whole], minlength=DIMS * len(raw)).reshape(len(raw), DIMS)


def vectors_of(texts: list[str], idf: np.ndarray) -> np.ndarray:
    return _weighted(counts_of(texts), idf)


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    found = np.log1p(counts.astype(np.float32)) * idf
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)


def nearest(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid of each text, its cosine, and whether the text is accepted."""
    best, near, fine = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts), bool)
    for lo, hi in _blocks(texts) if model.names else ():
        counts = counts_of(texts[lo:hi])
        cosines = _weighted(counts, model.idf) @ model.centroids.T
        best[lo:hi], near[lo:hi] = cosines.argmax(1), cosines.max(1)
        fine[lo:hi] = near[lo:hi] >= limits_at(model.limits[best[lo:hi]], counts.sum(1))
    return best, near, fine & np.array([has_letter(t) for t in texts], bool)


def limits_at(limits: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each row's limit at its number of trigrams, between those of LENGTHS."""
    at = np.interp(np.log(np.maximum(sizes, 1)), np.log(LENGTHS), np.arange(len(LENGTHS)))
    low = np.minimum(at.astype(np.int64), len(LENGTHS) - 2)
    row = np.arange(len(limits))
    return limits[row, low] + (at - low) * (limits[row, low + 1] - limits[row, low])


def has_letter(text: str) -> bool:
    """Whether a text has a letter; numerals such as a half or a Roman two are none."""
    found = _WORD_SIGN.search(text)
    return bool(found) and (found[0].isalpha() or any(c.isalpha() for c in text))


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """At most 128 texts and about 1 MB at once."""
    for lo, hi in by_bytes([len(t) for t in texts], 1_000_000):
        for at in range(lo, hi, 128):
            yield at, min(hi, at + 128)


def _clustered(vectors: np.ndarray, k: int) -> np.ndarray:
    """Unit centroids of the rows, the largest cluster's first; each has LEAST of the rows at least."""
    rng = np.random.default_rng(20240517)
    found = vectors[[(vectors @ vectors.mean(0)).argmax()]]
    while len(found) < min(k, len(vectors)):
        far = np.maximum(1 - (vectors @ found.T).max(1), 0).astype(np.float64) ** 2
        if far.sum() < 1e-9:
            break
        found = np.concatenate([found, vectors[[rng.choice(len(vectors), p=far / far.sum())]]])
    for _ in range(20):
        own = (vectors @ found.T).argmax(1)
        held = np.bincount(own, minlength=len(found))
        keep = held >= max(1, LEAST * len(vectors))
        if not keep.all():
            found = found[keep]
            continue
        means = np.stack([vectors[own == c].mean(0) for c in range(len(found))])
        found = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    return found[np.argsort(-np.bincount((vectors @ found.T).argmax(1), minlength=len(found)), kind="stable")]


def _limits(texts: list[str], centroids: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The limit at each of LENGTHS: pieces of so many letters from evenly spread places of the texts."""
    out = []
    for size in LENGTHS.tolist():
        pieces = []
        for i, t in enumerate(texts):
            if len(t) >= size:
                at = (i * 2654435761 % 1000) * (len(t) - size) // 1000
                pieces.append(t[at : at + size])
        near = [(vectors_of(pieces[lo:hi], idf) @ centroids.T).max(1) for lo, hi in _blocks(pieces)]
        near = np.concatenate([np.zeros(0), *near])
        near = near[near > 0]  # pieces without a letter tell nothing
        out.append(SLACK * float(np.quantile(near, FAR_OUT)) if len(near) else (out[-1] if out else 0.0))
    return np.array(out)


def fit(labelled: DataFrame, per_language: int = 1500, most_languages: int = 256) -> Model:
    """labelled: doc_id, text, lang."""
    spark = labelled.sparkSession
    arrow_rows(spark)
    rows = labelled.select("text", "lang").where("lang is not null and text is not null").withColumn("order", F.xxhash64("text"))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    if not sizes:
        return Model([], np.zeros((0, len(LENGTHS))), np.zeros((0, DIMS), np.float32), np.ones(DIMS, np.float32))
    # twice the share that is wanted, by hash, so that the exact pick has few rows to order
    shares = spark.createDataFrame([(r.lang, min(1.0, 2 * per_language / r.n)) for r in sizes], "lang string, share double")
    near = rows.join(F.broadcast(shares), "lang").where(F.pmod("order", F.lit(1 << 20)) < F.col("share") * (1 << 20)).drop("share")
    place = Window.partitionBy("lang").orderBy(F.pmod("order", F.lit(1 << 20)), "order", "text")
    picked = near.groupBy("lang", "order", "text").agg(F.lit(1)).select("lang", "order", "text").withColumn("place", F.row_number().over(place)).where(F.col("place") <= per_language)
    sample = written(picked.select("lang", "text"), "language-sample")

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            texts = batch["text"].tolist()
            for lo, hi in _blocks(texts):
                total += (counts_of(texts[lo:hi]) > 0).sum(0)
            n += len(texts)
        yield pd.DataFrame({"place": np.arange(DIMS + 1), "n": np.append(total, n)})

    df = sample.mapInPandas(leaving_little(held), "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas().set_index("place")["n"]
    df = df.reindex(range(DIMS + 1), fill_value=0).to_numpy()
    idf = np.log((1 + df[-1]) / (1 + df[:-1])).astype(np.float32) + np.float32(1)

    def clusters(group: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(group["text"])
        vectors = np.concatenate([vectors_of(texts[lo:hi], idf) for lo, hi in _blocks(texts)])
        vectors = vectors[np.linalg.norm(vectors, axis=1) > 0.5]
        if not len(vectors):
            return pd.DataFrame({"lang": [], "limits": [], "centroid": []})
        found = _clustered(vectors, CLUSTERS)
        del vectors
        limits = _limits(texts, found, idf)
        lean()
        return pd.DataFrame({"lang": group["lang"].iloc[0], "limits": [limits] * len(found), "centroid": [c.astype(np.float32) for c in found]})

    got = sample.groupBy("lang").applyInPandas(clusters, "lang string, limits array<double>, centroid array<float>").toPandas()
    drop_written(sample)
    got = got.assign(order=got.groupby("lang").cumcount()).sort_values(["lang", "order"])
    return Model(got["lang"].tolist(), np.array(got["limits"].tolist()).reshape(-1, len(LENGTHS)), np.array(got["centroid"].tolist(), np.float32).reshape(-1, DIMS), idf)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and rejected for each row of `docs` (doc_id, text)."""
    arrow_rows(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # languages x CLUSTERS x DIMS numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = sent.value
        for batch in batches:
            texts = batch["text"].tolist()
            best, near, fine = nearest(texts, known)
            named = np.array([bool(known.names) and has_letter(t) for t in texts], bool)
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "lang_pred": [known.names[b] if ok else "und" for b, ok in zip(best, named, strict=True)],
                    "score": np.where(named, np.clip(near, 0, 1), 0.0),
                    "rejected": ~fine,
                }
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInPandas(leaving_little(run), f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` whose text is not rejected, with all columns."""
    arrow_rows(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def accepted(texts: pd.Series) -> pd.Series:
        return pd.Series(nearest([t or "" for t in texts], sent.value)[2])

    return docs.where(accepted(F.col("text")))
