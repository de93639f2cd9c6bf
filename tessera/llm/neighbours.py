"""Approximate nearest neighbours by collision counting.

Every vector is projected on M random directions, and each projection is a sorted array. A query opens a window around its own projection
in each array; virtual rehashing widens the windows step by step, and a vector collides once for every window that holds it. Vectors with
enough collisions are verified by their exact inner product. Windows stop growing at the half-width WIDTH times the distance of the query's
K-th best vector so far: the threshold, fitted on SAMPLE vectors of a shard whose true neighbours are known, is what all but MISS of the
vectors within that distance reach there.

Inner products become distances by one more coordinate that brings every vector to the largest norm of its shard. Shards are boxes: bands
of norms, and in each the leaves of a tree of splits along the first directions, at medians of a sample of TREE_VALUES numbers. A query
first visits the box where the largest product is possible. Its K-th product there bounds what it still needs, and it goes on only to boxes
that its windows reach: those where the gaps along the splits leave room for a product that large, which loses nothing. So clustered
vectors meet a few boxes; vectors without any structure meet them all, as no window excludes them. A leaf with more than SHARD vectors is
dealt over several shards, and a shard that many queries visit is copied once for every BLOCK of them. A task holds one shard at a time
and streams the queries past it. Equal vectors are one, with the ids that can be needed.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do those of another length
than the most frequent (the longer, if tied). Rows with a null id take no part. Repeated ids are separate vectors: a query leaves out one
row of its own id and vector, and each of several equal query rows gets its neighbours. Products that overflow count as infinite, those
that are no number as the smallest. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

K = 20
#: Random directions per coordinate (as whole rotations), half-width of the last windows as a share of the K-th distance, first half-width
#: as a share of the last, and growth by a step.
ROTATIONS, WIDTH, START, GROWTH = 2, 1.2, 0.6, 1.3
SAMPLE, MISS = 96, 0.06
#: Shards of so many vectors are too small for a quantile: the threshold is 0 there, and all are verified.
SMALL = 128
#: Vectors in a shard, queries that share a copy of it, numbers in the sample that the tree is fitted on, norm bands beside outliers.
SHARD, BLOCK, TREE_VALUES, BANDS = 16_384, 8_192, 1 << 22, 8


def directions(dim: int, rotations: int = ROTATIONS) -> np.ndarray:
    """Random rotations: fixed by the dimension alone."""
    rng = np.random.default_rng(dim)
    return np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(rotations)])


def norms(x: np.ndarray) -> np.ndarray:
    """Euclidean norms, scaled so that squares neither overflow nor vanish."""
    most = np.abs(x).max(1)
    return most * np.sqrt(((x / most[:, None]) ** 2).sum(1))


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nan_to_num(x @ q, nan=-np.inf, posinf=np.inf, neginf=-np.inf)


class Tree:
    """Splits of directions at medians: node i of a level splits along direction ``level``."""

    def __init__(self, sample: np.ndarray, levels: int):
        self.levels, self.way, self.cuts = levels, directions(sample.shape[1], 1), []
        p, at = units(sample) @ self.way.T, np.zeros(len(sample), np.int64)
        for level in range(levels):
            by = p[:, level % p.shape[1]]
            self.cuts.append(np.array([np.median(by[at == i]) if (at == i).any() else 0.0 for i in range(1 << level)]))
            at = 2 * at + (by > self.cuts[level][at])

    def leaves(self, u: np.ndarray) -> np.ndarray:
        p, at = u @ self.way.T, np.zeros(len(u), np.int64)
        for level, cuts in enumerate(self.cuts):
            at = 2 * at + (p[:, level % p.shape[1]] > cuts[at])
        return at

    def gaps(self, u: np.ndarray) -> np.ndarray:
        """The squared distance of each unit vector to each leaf's box."""
        p = u @ self.way.T
        low, high = np.full((1 << self.levels, p.shape[1]), -np.inf), np.full((1 << self.levels, p.shape[1]), np.inf)
        for leaf in range(1 << self.levels):
            for level in range(self.levels):
                node, j = leaf >> (self.levels - level), level % p.shape[1]
                if leaf >> (self.levels - level - 1) & 1:
                    low[leaf, j] = max(low[leaf, j], self.cuts[level][node])
                else:
                    high[leaf, j] = min(high[leaf, j], self.cuts[level][node])
        used = np.arange(min(self.levels, p.shape[1]))
        d = np.maximum(np.maximum(low[None][:, :, used] - p[:, None, used], p[:, None, used] - high[None][:, :, used]), 0)
        return (d * d).sum(2)


class Index:
    """One shard: distinct vectors, the ids of each, and the sorted projections."""

    def __init__(self, ids: list[np.ndarray], vectors: np.ndarray, k: int = K):
        self.ids, self.x, self.k = ids, vectors, k
        n = norms(vectors)
        self.most = n.max()
        y = units(vectors) * (n / self.most)[:, None]
        self.way = directions(vectors.shape[1] + 1) * (vectors.shape[1] + 1) ** 0.5  # projections of a distance have it as their deviation
        p = (np.column_stack([y, np.sqrt(np.maximum(1 - (n / self.most) ** 2, 0))]) @ self.way.T).astype(np.float32)
        self.order = np.argsort(p, axis=0, kind="stable").T.astype(np.int32).copy()
        self.sorted = np.sort(p, axis=0).T.copy()
        self.fit(y)

    def project(self, u: np.ndarray) -> np.ndarray:
        return (np.column_stack([u, np.zeros(len(u))]) @ self.way.T).astype(np.float32)

    def collide(self, p: np.ndarray, half: np.ndarray) -> Iterator[np.ndarray]:
        """For each query the collisions of every vector with windows of its half-width around its projections. Where windows hold most
        of the arrays, what lies outside is counted."""
        n, m = self.sorted.shape[1], p.shape[1]
        half = half.astype(np.float32)
        lo = np.array([np.searchsorted(s, x - half, "left") for s, x in zip(self.sorted, p.T, strict=True)]).T
        hi = np.array([np.searchsorted(s, x + half, "right") for s, x in zip(self.sorted, p.T, strict=True)]).T
        for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
            if sum(b) - sum(a) <= n * m / 2:
                yield np.bincount(np.concatenate([o[i:j] for o, i, j in zip(self.order, a, b, strict=True)]), minlength=n)
            else:
                yield m - np.bincount(np.concatenate([part for o, i, j in zip(self.order, a, b, strict=True) for part in (o[:i], o[j:])]), minlength=n)

    def distance(self, cosine: float) -> float:
        return float(np.sqrt(max(0.0, 2 - 2 * min(1.0, max(-1.0, cosine))))) + 1e-6

    def fit(self, y: np.ndarray) -> None:
        """least: the collisions that all but MISS of the nearest k vectors have in the last windows."""
        some = np.random.default_rng(len(y)).permutation(len(y))[:SAMPLE]
        u, k = units(self.x[some]), min(self.k + 1, len(y))
        cosine = u @ y.T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        far = np.array([self.distance(c) for c in np.take_along_axis(cosine, near, 1).min(1)])
        got = [c[i] for c, i in zip(self.collide(self.project(u), WIDTH * far), near, strict=True)]
        self.least, self.first = max(1, int(np.quantile(np.concatenate(got), MISS))) if len(y) > SMALL else 0, START * WIDTH * float(np.median(far))

    def nearest(self, own: np.ndarray, queries: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """For each query ids and products of the k best verified vectors, none below its bound (a product already found k times), and
        how many were verified."""
        u, size = units(queries), norms(queries)
        p, found = self.project(u), [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32)) for _ in queries]
        bounds = bounds.copy()
        last = lambda i: WIDTH * (self.distance(bounds[i] / size[i] / self.most) if bounds[i] > -np.inf else 2.1)
        half = np.array([last(i) if bounds[i] > -np.inf else self.first for i in range(len(queries))])
        todo = np.arange(len(queries))
        while len(todo):
            late = []
            for i, c in zip(todo, self.collide(p[todo], half[todo]), strict=True):
                ids, scores, seen = found[i]
                new = np.flatnonzero(c >= self.least if half[i] < WIDTH * 2 else c >= 0)  # windows as wide as that hold everything
                new = np.setdiff1d(new, seen, assume_unique=True) if len(seen) else new
                seen = np.concatenate([seen, new])
                s = products(self.x[new], queries[i])
                if len(new) > 4 * self.k:  # equal products at the edge stay
                    on = s >= np.partition(s, -self.k - 1)[-self.k - 1]
                    new, s = new[on], s[on]
                each = [self.named(v, own[i], queries[i]) for v in new]
                ids, scores = np.concatenate([ids, *each]), np.concatenate([scores, np.repeat(s, [len(x) for x in each])])
                best = np.lexsort((ids, -scores))[: self.k]
                found[i] = ids[best], scores[best], seen
                if len(best) == self.k:
                    bounds[i] = max(bounds[i], scores[best[-1]])
                if len(seen) < len(self.x) and half[i] < last(i) and half[i] < WIDTH * 2:
                    late.append(i)
                    half[i] = min(half[i] * GROWTH, last(i))
            todo = np.array(late, int)
        on = [scores >= b for (_, scores, _), b in zip(found, bounds, strict=True)]
        return [(ids[x], scores[x], len(seen)) for (ids, scores, seen), x in zip(found, on, strict=True)]

    def named(self, v: int, own: int, q: np.ndarray) -> np.ndarray:
        """The ids of a distinct vector, less one of the query's own if it is the query's vector."""
        ids = self.ids[v]
        if (lo := np.searchsorted(ids, own)) < len(ids) and ids[lo] == own and np.array_equal(self.x[v], q):
            ids = np.delete(ids, lo)
        return ids[: self.k]


def searched(k: int):
    """A pass over rows sorted by shard: a shard's vectors (asks = 0), then the queries that visit it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, index = None, [], None
        for frame in frames:
            for key, part in frame.groupby(["shard", "sub", "block"], sort=False):
                if key != at:
                    at, held, index = key, [], None
                vectors = part[part["asks"] == 0]
                if len(vectors):
                    held.append(vectors)
                asking = part[part["asks"] == 1]
                if len(asking) and held:
                    all_ = pd.concat(held)
                    index, held = Index([np.sort(np.asarray(x, np.int64)) for x in all_["ids"]], np.stack(all_["v"].to_numpy()).astype(float), k), []
                if len(asking) and index:
                    own, q = np.array([x[0] for x in asking["ids"]], np.int64), np.stack(asking["v"].to_numpy()).astype(float)
                    found = index.nearest(own, q, asking["bound"].to_numpy())
                    yield pd.DataFrame([(i, *x) for i, x in zip(asking["qid"], found, strict=True)], columns=["qid", "found", "scores", "verified"])

    return run


FOUND = "qid long, found array<long>, scores array<double>, verified long"


def cleaned(df: DataFrame) -> DataFrame:
    return (
        df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
        .where("vec_id is not null and size(v) > 0")
        .where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    )


def fitted(distinct: DataFrame, dim: int, n: int) -> tuple[Tree, float, int, int]:
    """The tree of splits, and where norm bands lie: the median norm, and the lowest and highest band that is no outlier."""
    rows = max(64, TREE_VALUES // dim)
    some = distinct.where(F.pmod(F.xxhash64("v", F.lit("tree")), F.lit(1 << 30)) < int(min(1.0, rows / n) * (1 << 30))).select("v").limit(2 * rows).collect()
    sample = np.array([r["v"] for r in some], float).reshape(-1, dim)
    if not len(sample):
        sample = np.array([r["v"] for r in distinct.select("v").limit(1).collect()], float)
    levels = 0
    while (n >> levels) > SHARD and (len(sample) >> levels) > 64:
        levels += 1
    n_ = norms(sample)
    bands = np.sort(np.round(np.log2(n_ / np.median(n_))))
    low, high = (int(bands[int(q * (len(bands) - 1))]) for q in (0.01, 0.99))
    return Tree(sample, levels), float(np.median(n_)), max(low, high - BANDS + 1), high


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score, n_verified: the k nearest vectors found for each query by inner product. Both frames are (vec_id, embedding).

    n_verified is the number of vectors whose product the query has seen."""
    spark, schema = vectors.sparkSession, "query_id long, rank int, vec_id long, score double, n_verified long"
    vectors, queries = cleaned(vectors), cleaned(queries)
    # Of equal vectors only the k + 1 smallest ids can be needed; the limit applies before the shuffle.
    few = vectors.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    distinct = stored(few.groupBy("v").agg(F.collect_list("vec_id").alias("ids")))
    sizes = vectors.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim = sizes["dim"]
    distinct = distinct.where(F.size("v") == dim)
    tree, median, low, high = fitted(distinct, dim, distinct.count())
    asked = queries.where(F.size("v") == dim).groupBy("vec_id", "v").agg(F.count("*").alias("times"))
    asked = stored(asked.select(F.monotonically_increasing_id().alias("qid"), "vec_id", "v", "times"))

    def place(frames):
        for f in frames:
            x = np.stack(f["v"].to_numpy()).astype(float) if len(f) else np.zeros((0, dim))
            n = norms(x)
            band = np.clip(np.round(np.log2(n) - np.log2(median)), low - 1, high + 1)
            yield f.assign(shard=((band - low + 1) * (1 << tree.levels) + tree.leaves(units(x))).astype("int64"), norm=n)

    placed = stored(distinct.mapInPandas(place, "v array<double>, ids array<long>, shard long, norm double"))
    # A row per box: at most (BANDS + 2) times the leaves of a tree whose sample is bounded.
    boxes = placed.groupBy("shard").agg(F.count("*").alias("n"), F.min("norm").alias("least"), F.max("norm").alias("most")).orderBy("shard").toPandas()
    number, subs = boxes["shard"].to_numpy(), np.maximum(1, -(-boxes["n"].to_numpy() // SHARD))
    least, most, full = boxes["least"].to_numpy(), boxes["most"].to_numpy(), (boxes["n"] > k).to_numpy()
    sub = lambda x: F.pmod(F.xxhash64(x, F.lit("sub")), F.element_at(F.create_map(*[F.lit(int(z)) for pair in zip(number, subs, strict=True) for z in pair]), F.col("shard"))).cast("long") if (subs > 1).any() else F.lit(0).cast("long")

    def room(v: pd.Series) -> np.ndarray:
        """For each query and box the largest product over the query's norm that the box has room for."""
        cosine = 1 - tree.gaps(units(np.stack(v.to_numpy()).astype(float)))[:, number % (1 << tree.levels)] / 2
        with np.errstate(over="ignore"):
            return np.where(cosine > 0, cosine * most, cosine * least)

    def home(frames):
        for f in frames:
            if len(f):
                r = room(f["v"])
                yield pd.DataFrame({"qid": f["qid"], "vec_id": f["vec_id"], "v": f["v"], "shard": number[np.where(full | ~full.any(), r, -np.inf).argmax(1)], "bound": -np.inf})

    def onward(frames):
        for f in frames:
            if len(f):
                r, need = room(f["v"]), f["bound"].to_numpy() / norms(np.stack(f["v"].to_numpy()).astype(float))
                i, j = np.nonzero(r >= (need - 1e-9 * np.abs(np.where(np.isfinite(need), need, 0)))[:, None])
                parts = subs[j]
                i, j = np.repeat(i, parts), np.repeat(j, parts)
                each = np.arange(len(j)) - np.repeat(np.cumsum(parts) - parts, parts)
                g = f.iloc[i]
                new = (number[j] != g["shard"].to_numpy()) | (each != g["sub"].to_numpy())
                yield pd.DataFrame({"qid": g["qid"], "vec_id": g["vec_id"], "v": g["v"], "bound": g["bound"], "shard": number[j], "sub": each})[new]

    dealt = placed.withColumn("sub", sub("v"))

    def search(visits: DataFrame) -> DataFrame:
        """visits: qid, vec_id, v, bound, shard, sub."""
        load = visits.groupBy("shard", "sub").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        copies = dealt.join(load, ["shard", "sub"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        copies = copies.select("shard", "sub", "block", F.lit(0).alias("asks"), F.lit(0).cast("long").alias("qid"), "ids", "v", F.lit(0.0).alias("bound"))
        to = visits.join(F.broadcast(load), ["shard", "sub"]) if len(number) < 100_000 and (subs < 8).all() else visits.join(load, ["shard", "sub"])
        to = to.select("shard", "sub", F.pmod(F.xxhash64("qid"), F.col("blocks")).alias("block"), F.lit(1).alias("asks"), "qid", F.array("vec_id").alias("ids"), "v", "bound")
        rows = copies.unionByName(to).repartition("shard", "sub", "block").sortWithinPartitions("shard", "sub", "block", "asks")
        return stored(rows.mapInPandas(searched(k), FOUND))

    visit = "qid long, vec_id long, v array<double>, shard long, bound double"
    at_home = stored(asked.drop("times").mapInPandas(home, visit).withColumn("sub", sub("qid")))
    first = search(at_home)
    kth = first.select("qid", F.when(F.size("scores") >= k, F.element_at("scores", -1)).otherwise(float("-inf")).alias("bound"))
    rest = at_home.drop("bound").join(kth, "qid").select("qid", "vec_id", "v", "bound", "shard", "sub")
    visits = stored(rest.mapInPandas(onward, "qid long, vec_id long, v array<double>, bound double, shard long, sub long"))
    found = first.unionByName(search(visits))
    verified = found.groupBy("qid").agg(F.sum("verified").alias("n_verified"))
    pairs = found.select("qid", F.explode(F.arrays_zip("found", "scores")).alias("f")).select("qid", F.col("f.found").alias("vec_id"), F.col("f.scores").alias("score"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))
    best = pairs.withColumn("rank", rank).where(F.col("rank") <= k).join(verified, "qid")
    names = asked.select("qid", F.col("vec_id").alias("query_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return best.join(names.drop("col"), "qid").select("query_id", "rank", "vec_id", "score", "n_verified")


def op1_collision_neighbours(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 20 = 0"))


QUERIES = {"op1_collision_neighbours": op1_collision_neighbours}
SQL: dict[str, str] = {}
