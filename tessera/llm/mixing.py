"""Mixing sources to target weights by cube-method balanced sampling.

Each document of a source is due target / source_size copies: the whole part is given to all, and the fraction is an inclusion probability.
The cube method moves these probabilities along the null space of two constraints, the number of documents and the number of tokens,
until they are 0 or 1. The flight runs in blocks of one source's documents, so a hot source has many blocks; what a block leaves open (at
most two documents) meets in blocks of the next level, and only the last level of a source lands.

Defined results: a null or empty text has size 0 and may be taken any number of times at no cost; a null source is a source of its own,
the last one; repeated rows are sampled as separate documents; an empty table gives no rows. Blocks, their order and their random numbers
follow from the rows themselves, so reruns agree.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_words, stored, table

#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)
#: No target is above so many times the source's size.
MOST = 3
#: Documents in a block of the first level, and blocks whose leftovers meet in one of the next.
BLOCK, JOIN = 2000, 512
#: Documents that the landing decides, with at most two more; and what a document too many costs there, in mean sizes.
LANDING, COUNT_COST = 10, 0.02
#: Below this distance from 0 or 1 a probability counts as landed.
NEAR = 1e-9


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS) -> list[float]:
    """What each source, in order, gives: shares of the total by weight, at most MOST times its size, the excess shared again by weight."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    open_, out, left = set(range(len(sizes))), [0.0] * len(sizes), float(sum(sizes))
    while open_:
        per = left / sum(w[i] for i in open_)
        above = {i for i in open_ if per * w[i] > MOST * sizes[i]}
        if not above:
            for i in open_:
                out[i] = per * w[i]
            break
        for i in above:
            out[i] = float(MOST * sizes[i])
        open_ -= above
        left = sum(sizes) - sum(out[i] for i in range(len(sizes)) if i not in open_)
    return out


def landed(pi: np.ndarray, size: np.ndarray, dice: float) -> np.ndarray:
    """An outcome of a few open documents, each taken with its probability pi, drawn from a distribution on outcomes near both sums.

    The distribution is made one outcome at a time: of those possible the nearest gets as much weight as the probabilities left allow. That
    closes at least one document for the outcomes after it, so there are at most one more than documents."""
    n = len(pi)
    ways = ((np.arange(1 << n)[:, None] >> np.arange(n)) & 1).astype(float)
    cost = np.abs((ways - pi) @ size) + COUNT_COST * size.mean() * np.abs((ways - pi).sum(1))
    left, rest, way = pi.astype(float), 1.0, ways[0]
    while rest > NEAR:
        # With weight rest still to give and taken ones left to give: an outcome takes from left, or from rest - left.
        able = ((ways == 0) | (left > NEAR)).all(1) & ((ways == 1) | (rest - left > NEAR)).all(1)
        if not able.any():
            break
        way = ways[np.flatnonzero(able)[cost[able].argmin()]]
        weight = min(np.where(way == 1, left, rest - left).min(), rest)
        if dice < weight:
            break
        dice, left, rest = dice - weight, left - weight * way, rest - weight
    return way


def flight(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator, land: bool) -> np.ndarray:
    """Moves pi until at most two entries are open (none if land), keeping sum(pi) and sum(pi * size). Expected values stay pi.

    Three open documents have a direction that changes neither sum; a step along it closes one of them. The LANDING smallest documents stay
    out of the flight if it lands; they and those it leaves open are landed, which keeps the sums nearly and the expected values."""
    pi, held = [float(x) for x in pi], []
    size = [float(x) for x in size]
    dice = iter(rng.random(2 * len(pi) + 8))

    def step(ks: list[int], u: tuple[float, ...]) -> list[int]:
        up = min((1 - pi[k]) / v if v > 0 else pi[k] / -v for k, v in zip(ks, u, strict=True) if v)
        down = min(pi[k] / v if v > 0 else (1 - pi[k]) / -v for k, v in zip(ks, u, strict=True) if v)
        by = up if next(dice) * (up + down) < down else -down
        for k, v in zip(ks, u, strict=True):
            x = pi[k] + by * v
            pi[k] = 0.0 if x < NEAR else 1.0 if x > 1 - NEAR else x
        return [k for k in ks if 0 < pi[k] < 1]

    inner = [k for k in range(len(pi)) if 0 < pi[k] < 1]
    landing = sorted(inner, key=lambda k: size[k])[:LANDING] if land else []
    late = set(landing)
    for k in (k for k in inner if k not in late):
        held.append(k)
        while len(held) == 3:
            a, b, c = (size[i] for i in held)
            u = (c - b, a - c, b - a)
            held = step(held, u if any(u) else (1.0, -1.0, 0.0))
    if landing := held + landing if land else []:
        for k, x in zip(landing, landed(np.array([pi[k] for k in landing]), np.array([size[k] for k in landing]), next(dice)), strict=True):
            pi[k] = float(x)
    return np.array(pi)


def block_of(level: int, last: bool) -> Callable:
    def fly(key, pdf):
        """One block's flight, in an order and with random numbers that follow from its rows."""
        pdf = pdf.iloc[np.lexsort((pdf["size"], pdf["doc_id"].isna(), pdf["doc_id"].fillna(0), pdf["h"]))]
        rng = np.random.default_rng(zlib.crc32(repr((int(key[0]), int(key[1]), level)).encode()))
        return pdf.assign(pi=flight(pdf["pi"].to_numpy(), pdf["size"].to_numpy(), rng, last), block=pdf["block"] // JOIN)

    return fly


def sampled(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, by: tuple[str, ...] = ("text",)) -> DataFrame:
    """doc_id, source, h (hash of the columns ``by``), size, source_size, target, copies: a row per row of documents.

    One pass over the texts; its narrow result is kept in the shared folder. The driver gets a row per source."""
    sized = stored(documents.select("doc_id", "source", F.xxhash64(*[F.col(f"`{c}`") for c in by]).alias("h"), n_words(F.col("text")).alias("size")))
    per = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    per.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    due = targets([r["size"] for r in per], weights)
    rows = [(r["source"], r["size"], t, k, -(-r["n"] // BLOCK)) for k, (r, t) in enumerate(zip(per, due, strict=True))]
    spark = documents.sparkSession
    plan = spark.createDataFrame(rows, "source string, source_size long, target double, k int, n_blocks long").withColumnRenamed("source", "named")
    levels = 1 + max([0, *(math.ceil(math.log(r[4], JOIN)) for r in rows if r[4] > 1)])

    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    all_ = (
        sized.join(plan, sized["source"].eqNullSafe(plan["named"]))
        .withColumn("whole", F.floor(ratio + NEAR).cast("long"))
        .withColumn("pi", F.greatest(F.lit(0.0), ratio - F.col("whole")))
        .withColumn("block", F.pmod(F.xxhash64("doc_id", "h"), F.col("n_blocks")))
        .select("doc_id", "source", "h", "size", "source_size", "target", "k", "whole", "pi", "block")
    )
    closed = (F.col("pi") < NEAR) | (F.col("pi") > 1 - NEAR)
    done = [all_.where(closed)]
    rest = all_.where(~closed)
    for level in range(levels):
        last = level == levels - 1

        moved = rest.groupBy("k", "block").applyInPandas(block_of(level, last), rest.schema)
        if last:
            done.append(moved)
        else:
            moved = stored(moved)
            done.append(moved.where(closed))
            rest = moved.where(~closed)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "source", "h", "size", "source_size", "target", (F.col("whole") + F.round("pi").cast("long")).alias("copies"))


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix itself: each row of documents as often as it is taken, with all its columns.

    Rows equal in all columns that can be hashed (all but maps) are one unit that gets the copies of all of them."""
    by = tuple(f.name for f in documents.schema if "map<" not in f.dataType.simpleString())
    unit = F.struct(F.col("doc_id"), F.col("source"), F.xxhash64(*[F.col(f"`{c}`") for c in by]).alias("h")).alias("_unit")
    own = [F.col(f"`{c}`") for c in documents.columns]
    rows = documents.select(unit, F.struct(*own).alias("_row")).dropDuplicates(["_unit"])
    copies = sampled(documents, weights, by).groupBy(F.struct("doc_id", "source", "h").alias("_unit")).agg(F.sum("copies").alias("_copies")).where("_copies > 0").withColumnRenamed("_unit", "_taken")
    joined = rows.join(copies, rows["_unit"].eqNullSafe(copies["_taken"]))
    return joined.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_n")).select(*[F.col("_row").getField(c).alias(c) for c in documents.columns])


def op4_cube_mixing(spark, sf_dir):
    return sampled(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


QUERIES = {"op4_cube_mixing": op4_cube_mixing}
SQL: dict[str, str] = {}
