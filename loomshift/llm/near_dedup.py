"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text's shingles are its runs of five words (one shingle of all words, where there are fewer). A shingle weighs its count
times 1 + the mean inverse document frequency of its words, the latter scaled to 0..1; document frequencies are counted
over all documents in FREQUENCY_SLOTS hashed slots, so the table sent out has a fixed size.

1. A map over whole texts draws BANDS * ROWS consistent weighted samples of each text, and hashes ROWS of them to a band.
   Two texts draw the same sample with a probability of their weighted Jaccard similarity.
2. Texts equal in a band form a bucket. Each bucket compares its members with a leader, not all pairs: members joined to
   the leader need no comparison with one another, so copies of one text cost one comparison each. What is then left
   apart in a bucket (members of all components but the largest) meets the bucket's members in blocks of bounded size: a
   block's similarities are one matrix product over its shingles, and only links that join components come out of it; blocks
   are bounded by texts and by characters, so their memory follows these bounds or the longest text. So
   no link within a bucket is lost, and no pair is a row unless it is one with a leader or a link that counts.
3. A comparison takes the exact weighted Jaccard similarity of the whole texts; SIMILARITY or more is a link.
4. Components of the links by smallest labels with pointer jumping, in tables of the shared folder.

Equal texts are one node throughout (their digest), so copies cost nothing but their row. Nothing but the frequency table
reaches the driver. Joins on a hot leader or bucket are split by adaptive execution.

Nulls and ties: a null text counts as empty; texts without a word are near copies of equal texts only. A group's class is
the smallest doc_id in it (null ids last). Rows that repeat a doc_id are members each. Extra columns are not read by
`group`, and kept by `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomshift.llm.shared import arrow_rows, by_bytes, drop_written, lean, leaving_little, mix64, text_of, tidy, written
from loomshift.llm.words import grams, words

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 14, 4
FREQUENCY_SLOTS = 1 << 18
#: About the most texts of a block that meet, their characters, and the columns of one matrix product.
LEFT, RIGHT, COLUMNS = 1024, 2048, 1024
LEFT_CHARS, RIGHT_CHARS = 750_000, 1_500_000
_LEVELS = 1 << 16


def _gamma_levels() -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2: its distribution function is 1 - (1 + x) exp(-x)."""
    x = np.concatenate([np.linspace(0, 1, 20_001), np.linspace(1, 40, 400_001)[1:]])
    return np.interp((np.arange(_LEVELS) + 0.5) / _LEVELS, 1 - (1 + x) * np.exp(-x), x).astype(np.float32)


_GAMMA = _gamma_levels()
_LOG_GAMMA = np.log(_GAMMA)


def _slot(word_hashes: np.ndarray) -> np.ndarray:
    return (word_hashes >> np.uint64(46)).astype(np.int64)


def shingles(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each text in order of hash, their weights, and where each text's begin (one more than texts)."""
    hashes, bounds = words(texts)
    weight = idf[_slot(hashes)]
    total = np.concatenate([[0.0], np.cumsum(weight, dtype=np.float64)])
    sizes = np.diff(bounds)
    runs = grams(hashes, SHINGLE)
    doc_of = np.repeat(np.arange(len(texts)), sizes)
    whole = doc_of[: len(runs)] == doc_of[len(hashes) - len(runs) :] if len(runs) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    keys, docs, means = runs[at], doc_of[at], (total[at + SHINGLE] - total[at]) / SHINGLE
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    if len(short):
        own = np.array([grams(hashes[bounds[i] : bounds[i + 1]], int(sizes[i]))[0] for i in short], np.uint64)
        keys = np.concatenate([keys, own])
        docs = np.concatenate([docs, short])
        means = np.concatenate([means, (total[bounds[short + 1]] - total[bounds[short]]) / sizes[short]])
    order = np.lexsort((keys, docs))
    keys, docs, means = keys[order], docs[order], means[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    at = np.flatnonzero(first)
    count = np.diff(np.append(at, len(keys)))
    return keys[at], np.round(count * (1 + means[at]), 4).astype(np.float32), np.searchsorted(docs[at], np.arange(len(texts) + 1))


def samples(keys: np.ndarray, weights: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """n consistent weighted samples of each text that has shingles, as hashes: one row a text."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    sizes = np.diff(np.append(starts, len(keys)))
    log_weight = np.log(weights)
    out = np.zeros((len(starts), n), np.uint64)
    for k in range(n):
        z = (keys ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
        z ^= z >> np.uint64(32)
        z *= np.uint64(0xD6E8FEB86659FD93)
        z ^= z >> np.uint64(32)
        r, c = (z & np.uint64(0xFFFF)).astype(np.int32), (z >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.int32)
        beta = (z >> np.uint64(48)).astype(np.float32) / np.float32(_LEVELS)
        gamma = _GAMMA[r]
        t = np.floor(log_weight / gamma + beta)
        rank = _LOG_GAMMA[c] - gamma * (t - beta + 1)
        least = np.flatnonzero(rank == np.repeat(np.minimum.reduceat(rank, starts), sizes))
        least = least[np.searchsorted(least, starts)]
        out[:, k] = mix64(keys[least] + t[least].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def bands_of(drawn: np.ndarray) -> np.ndarray:
    """One hash for each band."""
    out = np.zeros((len(drawn), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(drawn), b + 1, np.uint64)
        for j in range(ROWS):
            h = mix64(h * np.uint64(0xD6E8FEB86659FD93) + drawn[:, b * ROWS + j])
        out[:, b] = h
    return out.view(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two texts' (shingles, weights): the sum of the smaller weights over that of the larger."""
    place = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    hit = a[0][place] == b[0]
    shared = float(np.minimum(a[1][place[hit]], b[1][hit]).sum(dtype=np.float64))
    return shared / (float(a[1].sum(dtype=np.float64)) + float(b[1].sum(dtype=np.float64)) - shared)


def _key():
    return F.unhex(F.substring(F.sha2(text_of(), 256), 1, 32))


def frequencies(docs: DataFrame) -> np.ndarray:
    """The scaled inverse document frequency of each slot, over all documents."""
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(FREQUENCY_SLOTS, np.int64), 0
        for batch in batches:
            texts = batch["text"].tolist()
            n += len(texts)
            for lo, hi in by_bytes([len(t) for t in texts], 1_000_000):
                hashes, bounds = words(texts[lo:hi])
                own = np.unique(_slot(hashes) + np.repeat(np.arange(hi - lo), np.diff(bounds)) * FREQUENCY_SLOTS)
                total += np.bincount(own % FREQUENCY_SLOTS, minlength=FREQUENCY_SLOTS)
        held = np.flatnonzero(total)
        yield pd.DataFrame({"slot": np.append(held, FREQUENCY_SLOTS), "n": np.append(total[held], n)})

    rows = docs.select(text_of().alias("text")).mapInPandas(leaving_little(run), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(FREQUENCY_SLOTS + 1)
    df[rows["slot"]] = rows["n"]
    return (np.log((df[-1] + 1) / (np.minimum(df[:-1], df[-1]) + 1)) / np.log(df[-1] + 2)).astype(np.float32)


def _banded(docs: DataFrame, idf) -> DataFrame:
    """key and bands of each text with words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, keys = batch["text"].tolist(), batch["key"].to_numpy()
            for lo, hi in by_bytes([len(t) for t in texts], 1_000_000):
                found, weights, bounds = shingles(texts[lo:hi], idf.value)
                if len(found):
                    yield pd.DataFrame({"key": keys[lo:hi][np.diff(bounds) > 0], "bands": list(bands_of(samples(found, weights, bounds, BANDS * ROWS)))})

    return docs.select("key", "text").mapInPandas(leaving_little(run), "key binary, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """The pairs (a, b) whose whole texts are similar."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
            distinct = list(dict.fromkeys([*batch["ta"], *batch["tb"]]))
            for lo, hi in by_bytes([len(t) for t in distinct], 1_000_000):
                keys, weights, bounds = shingles(distinct[lo:hi], idf.value)
                known |= {t: (keys[s:e], weights[s:e]) for t, s, e in zip(distinct[lo:hi], bounds[:-1], bounds[1:], strict=True)}
            near = [weighted_jaccard(known[x], known[y]) >= SIMILARITY for x, y in zip(batch["ta"], batch["tb"], strict=True)]
            yield batch.loc[near, ["a", "b"]]

    both = pairs.join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInPandas(leaving_little(run), "a binary, b binary")


def overlaps(features: list[tuple[np.ndarray, np.ndarray]], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The weighted Jaccard similarity of each text of `left` with each of `right` (places in `features`).

    A shingle with several weights counts as levels: the sum of the smaller of two weights is that of the levels both reach.
    """
    doc = np.repeat(np.arange(len(features)), [len(f[0]) for f in features])
    keys, weights = np.concatenate([f[0] for f in features]), np.concatenate([f[1] for f in features]).astype(np.float64)
    order = np.lexsort((weights, keys))
    doc, keys, weights = doc[order], keys[order], weights[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    new = first.copy()
    new[1:] |= weights[1:] != weights[:-1]
    level = np.cumsum(new) - 1  # one for each shingle and weight
    at = np.flatnonzero(new)
    height = np.where(first[at], weights[at], weights[at] - np.append(0.0, weights[at][:-1]))
    base = np.maximum.accumulate(np.where(first, level, 0))
    reach = level - base + 1  # a text reaches its own level and those below
    column = np.repeat(base, reach) + np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
    doc = np.repeat(doc, reach)
    total = np.bincount(doc, height[column], minlength=len(features))
    place_left, place_right = np.full(len(features), -1), np.full(len(features), -1)
    place_left[left], place_right[right] = np.arange(len(left)), np.arange(len(right))
    used = np.zeros(len(at), np.int64)
    used[np.unique(column[place_left[doc] >= 0])] |= 1
    used[np.unique(column[place_right[doc] >= 0])] |= 2
    number = np.cumsum(used == 3) - 1
    go = used[column] == 3
    doc, column = doc[go], column[go]
    order = np.argsort(number[column], kind="stable")
    doc, column = doc[order], column[order]
    where = number[column]
    out = np.zeros((len(left), len(right)))
    for low in range(0, int(where[-1]) + 1 if len(where) else 0, COLUMNS):
        s, e = np.searchsorted(where, (low, low + COLUMNS))
        a, b = np.zeros((len(left), COLUMNS)), np.zeros((len(right), COLUMNS))
        l, r = place_left[doc[s:e]] >= 0, place_right[doc[s:e]] >= 0
        a[place_left[doc[s:e]][l], where[s:e][l] - low] = height[column[s:e]][l]
        b[place_right[doc[s:e]][r], where[s:e][r] - low] = 1
        out += a @ b.T
    return out / (total[left][:, None] + total[right][None, :] - out)


def _settled(state: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """Links between the components that a bucket still holds. state: bucket, key, label, apart (not of the largest component)."""
    state = state.join(texts.select("key", F.length("text").alias("chars")), "key")
    own = F.when(F.col("apart"), F.col("chars"))
    sizes = state.groupBy("bucket").agg(F.count("apart").alias("n"), F.count(own).alias("u"), F.sum("chars").alias("all_chars"), F.sum(own).alias("own_chars"))
    blocks = lambda n, most, chars, most_chars: F.ceil(F.greatest(F.col(n) / most, F.col(chars) / most_chars)).cast("int")
    rows = state.join(sizes, "bucket").withColumn("ub", blocks("u", LEFT, "own_chars", LEFT_CHARS)).withColumn("nb", blocks("n", RIGHT, "all_chars", RIGHT_CHARS))
    dealt = lambda seed, n: F.pmod(F.xxhash64("key", F.lit(seed)), F.col(n)).cast("int")
    lefts = rows.where("apart").select("bucket", dealt(1, "ub").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j"), "key", "label", F.lit(True).alias("left"))
    rights = rows.select("bucket", F.explode(F.sequence(F.lit(0), F.col("ub") - 1)).alias("i"), dealt(2, "nb").alias("j"), "key", "label", F.lit(False).alias("left"))
    both = lefts.union(rights).join(texts, "key")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        listed = group["text"].tolist()
        distinct = list(dict.fromkeys(listed))
        place = {t: i for i, t in enumerate(distinct)}
        features: list[tuple[np.ndarray, np.ndarray]] = []
        for lo, hi in by_bytes([len(t) for t in distinct], 1_000_000):
            keys, weights, bounds = shingles(distinct[lo:hi], idf.value)
            features += [(keys[s:e], weights[s:e]) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
        at = np.array([place[t] for t in listed])
        name: list = [None] * len(distinct)
        label: list = [None] * len(distinct)
        for i, k, x in zip(at.tolist(), group["key"], group["label"], strict=True):
            name[i], label[i] = bytes(k), bytes(x)
        is_left = group["left"].to_numpy(bool)
        left, right = np.unique(at[is_left]), np.unique(at[~is_left])
        out, top = [], {x: x for x in label}

        def root(x: bytes) -> bytes:
            while top[x] != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        if len(left) and len(right):
            near = overlaps(features, left, right) >= SIMILARITY
            for i, j in np.argwhere(near).tolist():
                a, b = left[i], right[j]
                x, y = root(label[a]), root(label[b])
                if x != y:
                    top[x] = y
                    out.append((name[a], name[b]))
        return pd.DataFrame(out, columns=["a", "b"])

    def block(group: pd.DataFrame) -> pd.DataFrame:
        try:
            return run(group)
        finally:
            lean()

    return both.groupBy("bucket", "i", "j").applyInPandas(block, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(key, label) of each node of `links` (a, b); label: the smallest key of its component."""
    edges = written(links.union(links.select("b", "a")).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("key", "b"), "b").groupBy(F.col("a").alias("key")).agg(F.min("label").alias("near"))
        step = labels.join(near, "key").select("key", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("key").alias("next"), F.col("label").alias("further"))
        new = written(step.join(jump, "next").select("key", F.least("next", "further").alias("label"), (F.least("next", "further") != F.col("label")).alias("moved")), "labels")
        settled = new.where("moved").isEmpty()
        drop_written(labels)
        path, labels = new.loomshift_path, new.drop("moved")
        labels.loomshift_path = path
        if settled:
            drop_written(edges)
            return labels


def classes(docs: DataFrame) -> DataFrame:
    """(key, label) of each distinct text that has a near copy of another text. docs: doc_id, text."""
    with tidy() as kept:
        labels = _classes(docs)
        kept.append(labels)
    return labels


def _classes(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    arrow_rows(spark)
    idf = spark.sparkContext.broadcast(frequencies(docs))  # FREQUENCY_SLOTS numbers
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("key", _key())
    bands = _banded(rows, idf).groupBy("key").agg(F.first("bands").alias("bands")).select("key", F.explode("bands").alias("bucket"))
    bands = written(bands, "bands")
    many = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("a")).where("n > 1").drop("n")
    members = written(bands.join(many, "bucket"), "members")
    held = members.select("key").distinct()
    first = rows.groupBy("key").agg(F.min("doc_id").alias("doc_id")).join(held, "key").select(F.col("key").alias("own"), F.col("doc_id").alias("own_id"))
    texts = rows.join(first, (rows["key"] == first["own"]) & rows["doc_id"].eqNullSafe(first["own_id"])).select("key", "text").distinct()
    texts = written(texts, "candidates")
    drop_written(bands)
    pairs = members.where("a <> key").select("a", F.col("key").alias("b")).distinct()
    links = written(_verified(pairs, texts, idf), "links")
    labels = components(links)
    state = members.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key")).where("a <> key").select("bucket", "key", "label")
    parts = state.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.max_by("label", F.struct("n", "label")).alias("major")).where("parts > 1").drop("parts")
    state_table = written(state.join(parts, "bucket").select("bucket", "key", "label", (F.col("label") != F.col("major")).alias("apart")), "open")
    drop_written(members)
    more = written(_settled(state_table, texts, idf), "links")
    drop_written(state_table)
    drop_written(texts)
    if not more.isEmpty():
        drop_written(labels)
        labels = components(links.union(more))
    drop_written(links)
    drop_written(more)
    return labels


def group(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its group of near copies) and class_size for each row of `docs` (doc_id, text)."""
    labels = classes(docs)
    rows = docs.select("doc_id", _key().alias("key")).groupBy("key").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n"))
    rows = rows.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    found = rows.groupBy("label").agg(F.min("id").alias("class_id"), F.sum("n").alias("class_size"))
    placed = rows.select("key", "label").join(found, "label").drop("label")
    return docs.select("doc_id", _key().alias("key")).join(placed, "key").select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: of each group of equal or similar texts, those with its smallest doc_id."""
    ids = docs.select("doc_id", _key().alias("key")).groupBy("key").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n"))
    ids = ids.join(classes(docs), "key", "left")
    best = ids.where("label is not null").groupBy("label").agg(F.min_by("key", F.struct(F.col("id").isNull(), "id", "key")).alias("best"))
    known = ids.where("label is not null or n > 1").join(best, "label", "left").select("key", "id", F.coalesce(F.col("key") == F.col("best"), F.lit(True)).alias("stays"))
    # the rows travel as one column, so that no name of theirs can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("own"), _key().alias("key"))
    found = rows.join(known.select("key", F.struct("id", "stays").alias("known")), "key", "left")
    keep = F.col("known").isNull() | (F.col("known.stays") & F.col("own").eqNullSafe(F.col("known.id")))
    return found.where(keep).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
