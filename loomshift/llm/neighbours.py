"""Approximate nearest neighbours by collision counting (largest inner products).

Equal vectors are one class with its KEEP smallest ids, as no larger id of a class can be among the nearest of any query
(the query's own id is one of them at most). Classes are dealt into blocks of BLOCK vectors, and all are indexed. With one
more coordinate, sqrt(M^2 - |x|^2), the largest inner product is the smallest Euclidean distance.

In a block the index is LINES sorted arrays or a few more, one for each random projection: whole sets of orthogonal lines, whose
collision counts vary less than those of single ones. A query's windows are centred on its own projections; by virtual
rehashing the same arrays serve any window width. At width REACH * r a vector at distance r lies in a line's window with a
probability p that depends on the number of dimensions; the threshold is the number of windows that such a vector lies in
with all but a chance of MISSED, by the binomial distribution (orthogonal lines miss less). Vectors in as many windows or
more are verified: their inner products are taken in double precision on the original vectors. The windows widen until
they are REACH times as wide as the distance of the k-th best vector found, and no further. So a vector nearer than that
is passed over with a chance of MISSED at most, nearer ones with less, while one farther away by a few tenths is hardly
ever verified. Outside of the windows lie fewer entries than inside, so those are counted.

The query set meets the blocks in blocks of QUERIES vectors. Each pair of blocks is a task's group of bounded size (fewer queries where
cores would idle), and
gives its best KEEP entries for each query; these are merged by rank with a limit before the shuffle.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids. Only vectors of one
length are compared. Ties go to the smaller id. Rows that repeat an id and vector count once; an id with two vectors is two rows.
Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomshift.llm.shared import arrow_rows, lean, written

LINES = 256
REACH = 1.8
MISSED = 0.15
WIDEN = 1.1
BLOCK = 16384
QUERIES = 4096
#: Queries of a task that widen their windows together.
TOGETHER = 128


def collision(dims: int) -> float:
    """The probability that a unit vector of a random direction, times the root of `dims`, lies within REACH on a line."""
    if dims == 1:
        return 1.0
    angle = np.linspace(0, np.pi / 2, 20_001)
    density = np.cos(angle) ** (dims - 2)
    inside = angle <= math.asin(min(1.0, REACH / math.sqrt(dims)))
    return float(density[inside].sum() / density.sum())


def threshold(lines: int, p: float) -> int:
    """The most windows of `lines` that a vector lies in with a chance of 1 - MISSED or more, each with probability p."""
    if p >= 1:
        return lines
    chance, at = 0.0, lines
    while at > 0:
        chance += math.exp(math.lgamma(lines + 1) - math.lgamma(at + 1) - math.lgamma(lines - at + 1) + at * math.log(p) + (lines - at) * math.log1p(-p))
        if chance >= 1 - MISSED:
            break
        at -= 1
    return at


def orthogonal(dims: int, rng: np.random.Generator) -> np.ndarray:
    """At least LINES lines as columns: sets of orthogonal ones, each of the length of the root of `dims`."""
    return np.concatenate([np.linalg.qr(rng.standard_normal((dims, dims)))[0] for _ in range(-(-LINES // dims))], axis=1) * math.sqrt(dims)


class Index:
    """The sorted arrays of one block of vectors (rows of x)."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = x
        squares = (x * x).sum(1)
        self.top = float(squares.max())
        dims = x.shape[1] + 1
        self.lines = orthogonal(dims, np.random.default_rng(20240229))
        self.n_lines = self.lines.shape[1]
        self.most_outside = self.n_lines - threshold(self.n_lines, collision(dims))
        at = np.column_stack([x, np.sqrt(np.maximum(self.top - squares, 0))]) @ self.lines
        self.order = np.ascontiguousarray(np.argsort(at, axis=0, kind="stable").T)
        self.values = np.ascontiguousarray(np.take_along_axis(at.T, self.order, 1))
        self.usual = 0.0  # the width that the last search ended with
        self.verified = self.asked = 0

    def _newly(self, i: int, spans: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """How many lines have each row in the spans (begins and ends by query and line) of query i."""
        parts = [o[a:b] for begins, ends in spans for o, a, b in zip(self.order, begins[i].tolist(), ends[i].tolist(), strict=True)]
        return np.bincount(np.concatenate(parts), minlength=len(self.x)).astype(np.int16)

    def search(self, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the rows with the k largest inner products found, and these, best first. All queries widen their windows together."""
        n = len(self.x)
        k = min(k, n)
        centre = queries @ self.lines[:-1]
        far = self.top + (queries * queries).sum(1)
        some = self.x[:: max(1, n // 64)]
        near = np.sort(queries @ some.T, axis=1)[:, -min(2, len(some))]  # not the query itself
        width = np.full(len(queries), self.usual * 0.98) if self.usual else 0.8 * REACH * np.sqrt(np.maximum(far - 2 * near, 1e-18))
        low = high = outside = None
        seen = np.zeros((len(queries), n), bool)
        rows, scores = [np.zeros(0, np.int64)] * len(queries), [np.zeros(0)] * len(queries)
        live = np.arange(len(queries))
        while len(live):
            lows, highs = np.empty((len(live), self.n_lines), np.int64), np.empty((len(live), self.n_lines), np.int64)
            for j, v in enumerate(self.values):
                lows[:, j] = np.searchsorted(v, centre[live, j] - width[live])
                highs[:, j] = np.searchsorted(v, centre[live, j] + width[live], side="right")
            if outside is None:  # what lies outside of the windows
                spans = [(np.zeros_like(lows), lows), (highs, np.full_like(highs, n))]
                outside = np.stack([self._newly(i, spans) for i in range(len(live))])
            else:
                spans = [(lows, low[live]), (high[live], highs)]
                for i, q in enumerate(live.tolist()):
                    outside[q] -= self._newly(i, spans)
            if low is None:
                low, high = lows, highs
            else:
                low[live], high[live] = lows, highs
            going = []
            for q in live.tolist():
                new = np.flatnonzero((outside[q] <= self.most_outside) & ~seen[q])
                seen[q, new] = True
                rows[q], scores[q] = np.concatenate([rows[q], new]), np.concatenate([scores[q], self.x[new] @ queries[q]])
                wanted = math.inf
                if len(rows[q]) >= k:
                    worst = float(np.partition(scores[q], len(rows[q]) - k)[len(rows[q]) - k])
                    wanted = REACH * math.sqrt(max(0.0, far[q] - 2 * worst))
                if width[q] < wanted and outside[q].any():
                    width[q] = min(width[q] * WIDEN, wanted)
                    going.append(q)
            live = np.array(going, np.int64)
        self.usual = float(np.median(width))
        self.verified, self.asked = self.verified + sum(map(len, rows)), self.asked + len(queries)
        out = []
        for r, s in zip(rows, scores, strict=True):
            order = np.lexsort((r, -s))
            keep = s[order] >= s[order[k - 1]]  # ties of the last one stay
            out.append((r[order[keep]], s[order[keep]]))
        return out


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def search(vectors: DataFrame, is_query: Column, k: int = 20, block: int = BLOCK, part: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for each query among `vectors` (vec_id, embedding). block, part: vectors and queries that meet in a task."""
    spark = vectors.sparkSession
    arrow_rows(spark)
    keep = k + 1
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(is_query, F.lit(False)).alias("asks")).where("vec_id is not null").where(usable(F.col("embedding")))
    rows = rows.withColumn("embedding", F.transform("embedding", lambda v: v.cast("double") + 0.0))
    rows = rows.withColumn("class", F.xxhash64("embedding"))
    place = Window.partitionBy("class", "embedding").orderBy("vec_id")
    least = rows.select("class", "embedding", "vec_id").distinct().withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= keep)
    asked = rows.groupBy("class", "embedding").agg(F.max("asks").alias("asks"))
    known = least.groupBy("class", "embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).join(asked, ["class", "embedding"])
    known = written(known.select(F.element_at("ids", 1).alias("class"), F.size("embedding").alias("dims"), "embedding", "ids", "asks"), "classes")
    sizes = known.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q")).first()
    blocks = max(1, -(-sizes.n // block))
    parts = max(1, -(-sizes.q // part), min(-(-sizes.q // 256), -(-2 * spark.sparkContext.defaultParallelism // blocks)))
    hashed = lambda n, seed: F.pmod(F.xxhash64("class", F.lit(seed)), F.lit(n)).cast("int")
    data = known.select("dims", hashed(blocks, 1).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "embedding", "ids")
    queries = known.where("asks").select("dims", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), hashed(parts, 2).alias("part"), "class", "embedding")

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, ...]] = []
        if len(left) and len(right):
            left = left.iloc[np.argsort([ids[0] for ids in left["ids"]], kind="stable")]
            index, ids = Index(np.array(left["embedding"].tolist(), float)), left["ids"].tolist()
            asks, owns = np.array(right["embedding"].tolist(), float), right["class"].to_numpy()
            for lo in range(0, len(asks), TOGETHER):
                for own, (found, scores) in zip(owns[lo : lo + TOGETHER], index.search(asks[lo : lo + TOGETHER], keep), strict=True):
                    got = [np.asarray(ids[r]) for r in found]
                    score = np.repeat(scores, [len(g) for g in got])
                    vec = np.concatenate(got)
                    best = np.lexsort((vec, -score))[:keep]
                    out.append((np.full(len(best), own), vec[best], score[best]))
            del index
            lean()
        if not out:
            return pd.DataFrame({"class": [], "vec_id": [], "score": []})
        return pd.DataFrame({c: np.concatenate([o[i] for o in out]) for i, c in enumerate(("class", "vec_id", "score"))})

    groups = ["dims", "block", "part"]
    best = data.groupBy(*groups).cogroup(queries.groupBy(*groups)).applyInPandas(pair, "class long, vec_id long, score double")
    order = Window.partitionBy("class").orderBy(F.desc("score"), "vec_id")
    top = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    lists = top.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("near"))
    lists = lists.join(known.select(F.col("class"), "embedding"), "class")
    found = rows.where("asks").select(F.col("vec_id").alias("query_id"), "embedding").distinct().join(lists.select("embedding", "near"), "embedding")
    ranked = found.select("query_id", F.posexplode(F.slice(F.filter("near", lambda e: e["vec_id"] != F.col("query_id")), 1, k)).alias("at", "e"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), F.col("e.score").alias("score"))
