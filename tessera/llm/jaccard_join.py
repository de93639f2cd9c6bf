"""N-gram Jaccard join, size-aware: light sets are found by enumerated fixed-size subsets, heavy ones by scanning inverted lists.

Two documents link when 100 * |A & B| >= THRESHOLD * |A | B| over their sets of SHINGLE-word shingles. Sets that link have an overlap of
at least c = ceil(THRESHOLD % of the smaller size), so in any one order of all shingles they share one of their first n - c + 1 (the
prefix), and two of their first n - c + 2. Light sets send every pair of the latter as a key, so that only sets with two rare shingles in
common meet; heavy sets, and the light ones whose size lets them link to one, send each shingle of the prefix. The boundary is where the
subsets of a set cost more than scanning its lists: with p shingles in the prefix, p * (p + 1) / 2 keys against p keys that each meet
SCAN other sets, as measured on a part of the shingles. The order puts frequent shingles, known from a sample of documents, last; it
touches cost alone.

Equal sets are one node from the start. The nodes under a key that are already in one component need no comparison, so where keys hold
many (a group of near copies), rounds of leader comparisons come first: in each round LEADERS members of a key, drawn alike for all keys,
meet the others, each under two of its keys, and components are joined up. When few pairs of different components are left under all keys, all of them are
compared. Every pair that could link is thus compared or already connected, and pairs inside a group are never all emitted.

Defined results: null texts and texts without words have an empty set, link with nothing and are their own component. Rows without an id
have no component and link nothing; rows that share an id are one document, linked to each other. Repeated rows give one output row
each. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rolling, Words, salted, sliced, stored, table
from .components import components
from .substring_dedup import _lists

SHINGLE, THRESHOLD = 3, 90
HASH = Rolling(303)
#: Documents sampled for frequent shingles, sample counts that make one frequent, and the longest list of them (8 bytes each, broadcast).
SAMPLE, FREQUENT, FREQUENT_MOST = 20_000, 3, 200_000
#: One in so many shingles measures the lists' lengths.
MEASURED = 16
#: Leader rounds go on while more pairs than PAIRS, and than PAIRS_EACH for each key sent, are left, and while a round leaves less than
#: PROGRESS of them, but no longer than ROUNDS. What is left then is compared pair by pair.
PAIRS, PAIRS_EACH, PROGRESS, ROUNDS = 100_000, 0.2, 0.7, 4
#: Leaders of a key in a round; keys with no more pairs than that for each member wait for the end.
LEADERS = 8
#: Members beyond which a key is compared in blocks of BLOCK.
LARGE, BLOCK = 256, 2048


def shingles(texts: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; of the whole word sequence if that is shorter."""
    words = Words(texts, lower=True)
    start = words.windows(k)
    short = np.flatnonzero((words.n > 0) & (words.n < k))
    start, end = np.concatenate([start, words.at[short]]), np.concatenate([start + k, words.at[short + 1]])
    found, text = HASH.spans(HASH.sums(words), start, end), words.text[start]
    by = np.argsort(text, kind="stable")
    at = np.searchsorted(text[by], np.arange(len(words.n) + 1))
    found = found[by]
    return [np.unique(found[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def needed(n, threshold: int):
    """The least overlap with which a set of n shingles links to a larger one."""
    return -(-threshold * n // 100)


def prefix(found: np.ndarray, frequent: np.ndarray, rank: np.ndarray, threshold: int) -> np.ndarray:
    """The first n - c + 2 shingles of a set: rare ones by hash, then frequent ones by rising count."""
    n = len(found)
    m = min(n, n - needed(n, threshold) + 2)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        common = frequent[at] == found
        rare = found[~common]
        if len(rare) < m:
            rare = np.concatenate([rare, found[common][np.argsort(rank[at[common]], kind="stable")]])
        return rare[:m]
    return found[:m]


def _frequent(documents: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in a sample of about SAMPLE documents, sorted, and their ranks by count."""
    n = documents.count()
    part = documents.where(F.pmod(F.xxhash64("doc_id", F.lit("df")), F.lit(1 << 20)) < int(min(1 / 8, SAMPLE / max(1, n)) * (1 << 20)))

    def send(batches):
        for b in sliced(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *[s.view(np.int64) for s in shingles(b.column(0), k)]]))], names=["s"])

    counts = part.select("text").mapInArrow(send, "s long").groupBy("s").count().where(F.col("count") >= FREQUENT)
    rows = counts.orderBy(F.desc("count"), "s").limit(FREQUENT_MOST).collect()
    found = np.array([r["s"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], -order


def bitmap(found: np.ndarray) -> bytes:
    """A set's shingles in a map of 8 to 16 bits for each; longer sets have longer maps, whose sizes are powers of two."""
    bits = max(256, 8 << int(len(found)).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(found & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def may_link(x: list[bytes], y: list[bytes], m: np.ndarray, n: np.ndarray, threshold: int) -> np.ndarray:
    """False only where the bitmaps show that sets of m and n shingles can't link: a bit of one alone is a shingle that the other lacks."""
    out, sizes = np.zeros(len(x), bool), np.array([(len(u), len(v)) for u, v in zip(x, y, strict=True)]).reshape(-1, 2)
    for size in np.unique(sizes, axis=0):
        at = np.flatnonzero((sizes == size).all(1))
        a, b = (folded([z[i] for i in at], size.min()) for z in (x, y))
        both = np.minimum(m[at] - np.bitwise_count(a & ~b).sum(1, dtype=np.int64), n[at] - np.bitwise_count(b & ~a).sum(1, dtype=np.int64))
        out[at] = 100 * both >= threshold * (m[at] + n[at] - both)
    return out


def folded(maps: list[bytes], length: int) -> np.ndarray:
    """Bitmaps of one size as rows of so many bytes: halves of longer ones are laid over each other."""
    a = np.frombuffer(b"".join(maps), np.uint64).reshape(len(maps), -1)
    while a.shape[1] * 8 > length:
        a = a[:, : a.shape[1] // 2] | a[:, a.shape[1] // 2 :]
    return a


def verify(pairs: DataFrame, maps: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """The pairs (a, b) that link. Bitmaps drop most others; the texts of the rest give whole sets."""

    def screen(batches):
        for batch in sliced(batches):
            x, m, y, n = (batch.column(i) for i in range(2, 6))
            ok = may_link(x.to_pylist(), y.to_pylist(), m.to_numpy(), n.to_numpy(), threshold)
            yield batch.select([0, 1]).filter(pa.array(ok))

    x, y = (maps.select(F.col("rep").alias(c), F.col("bits").alias("bits" + c), F.col("n").alias("n" + c)) for c in "ab")
    near = stored(pairs.join(x, "a").join(y, "b").select("a", "b", "bitsa", "na", "bitsb", "nb").mapInArrow(screen, "a long, b long").distinct())
    involved = near.select(F.explode(F.array("a", "b")).alias("_rep")).distinct()

    def whole(batches):
        for batch in sliced(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists_of([s.view(np.int64) for s in shingles(batch.column(1), k)])], names=["rep", "s"])

    # A repeated id may stand for several texts; comparing any two of its sets is right, as its rows are one document.
    kept = texts.join(involved, texts["doc_id"] == involved["_rep"], "left_semi").select("doc_id", "text").dropDuplicates(["doc_id", "text"])
    full = stored(kept.mapInArrow(whole, "rep long, s array<long>"))

    def compare(batches):
        for batch in sliced(batches):
            ok = np.zeros(batch.num_rows, bool)
            for i, (u, v) in enumerate(zip(_lists(batch.column(2)), _lists(batch.column(3)), strict=True)):
                both = len(np.intersect1d(u, v, assume_unique=True))
                ok[i] = 100 * both >= threshold * (len(u) + len(v) - both)
            yield batch.select([0, 1]).filter(pa.array(ok))

    x, y = (full.select(F.col("rep").alias(c), F.col("s").alias("s" + c)) for c in "ab")
    return near.join(x, "a").join(y, "b").select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long")


def links(sets: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """Edges (a, b) that connect every component of nodes. sets: rep, n, tokens (the prefix), bits per node; texts: doc_id, text."""
    p = F.col("n") - F.ceil(F.col("n") * threshold / 100) + 1
    able = sets.where(F.col("n") * 100 >= threshold * (F.col("n") + 1))  # of smaller sets only equal ones link
    listed = able.select("rep", "n", F.posexplode(F.slice("tokens", F.lit(1), p.cast("int"))).alias("pos", "key"))
    lengths = listed.where(F.pmod("key", F.lit(MEASURED)) == 0).groupBy("key").count()
    # A member of a list meets the others, or the leaders.
    met, n = lengths.agg(F.sum(F.col("count") * F.least(F.col("count") - 1, F.lit(LEADERS))), F.sum("count")).first()
    scan = met / n if n else 0.0
    # p * (p + 1) / 2 <= p * (1 + scan), and p is about n * (100 - threshold) / 100 + 1.
    boundary = int(2 * scan * 100 / (100 - threshold)) if threshold < 100 else 0
    pair = lambda x, i: F.transform(F.slice("tokens", i + 2, F.size("tokens")), lambda y: F.xxhash64(F.lit("pair"), x, y))
    pairs_of = able.where(F.col("n") <= boundary).select("rep", "n", F.lit(0).alias("pos"), F.lit(False).alias("list"), F.explode(F.flatten(F.transform("tokens", pair))).alias("key"))
    keyed = listed.where(F.col("n") * 100 >= threshold * boundary).select("rep", "n", "pos", F.lit(True).alias("list"), "key").unionByName(pairs_of)
    sent = keyed.count()
    on = ["list", "key"]
    shared = keyed.groupBy(*on).agg(F.count("*").alias("rows")).where("rows > 1")
    keyed = stored(salted(keyed, shared, on, "rows", sent))
    maps = sets.select("rep", "n", "bits")

    def fits(m: str, i: str, n: str, j: str) -> Column:
        """Whether sets of m and n shingles can link if their first common shingle is at places i and j: what follows must reach the overlap."""
        overlap = F.ceil((F.col(m) + F.col(n)) * threshold / (100 + threshold))
        return (100 * F.least(m, n) >= threshold * F.greatest(m, n)) & (F.col(m) - F.col(i) >= overlap) & (F.col(n) - F.col(j) >= overlap)

    found, before, named = [], None, keyed.withColumn("c", F.col("rep"))
    for turn in range(ROUNDS):
        of_keys = named.groupBy(*on, "c").count().groupBy(*on).agg(F.sum("count").alias("k"), F.sum(F.col("count") * F.col("count")).alias("own"), F.max_by("c", "count").alias("most"), F.max("count").alias("n_most"))
        held = stored(of_keys.where("k * k > own").withColumn("cross", (F.col("k") * F.col("k") - F.col("own")) / 2))
        left = held.agg(F.sum("cross")).first()[0] or 0
        if left <= max(PAIRS, PAIRS_EACH * sent) or (before and left > PROGRESS * before):
            break
        before = left
        large = salted(named, held.where(F.col("cross") > LEADERS * F.col("k")).select(*on, "k", F.col("k").alias("rows")), on, "rows", sent)
        tops = [F.min(F.struct(F.xxhash64("rep", F.lit(turn), F.lit(i)).alias("h"), F.col("rep").alias("a"), F.col("n").alias("na"), F.col("pos").alias("ia"), F.col("c").alias("ca"))) for i in range(LEADERS)]
        of = large.groupBy(*on).agg(F.array_distinct(F.array(*tops)).alias("tops"), F.first("k").alias("rows")).select(*on, "rows", F.inline("tops"))
        # Members of a group have many keys in common, and the same leaders under them: each asks under two alone, its largest and one drawn.
        place = [*on, "pos"]
        drawn = F.max(F.struct(F.xxhash64("rep", *on, F.lit(turn)).alias("h"), *place))
        two = F.array_distinct(F.array(F.max(F.struct("k", *place)).dropFields("k"), drawn.dropFields("h")))
        asking = large.groupBy("rep", "n", "c").agg(two.alias("two")).select("rep", "n", "c", F.inline("two"))
        led = salted(asking, of, on, "rows", sent).where((F.col("c") != F.col("ca")) & fits("n", "pos", "na", "ia"))
        pairs = led.select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b")).distinct()
        found.append(stored(verify(pairs, maps, texts, k, threshold)))
        labels = components(_union(found))
        named = stored(keyed.join(labels, keyed["rep"] == labels["node"], "left").select("rep", "n", "pos", "list", "key", F.coalesce("component", "rep").alias("c")))
    # What is left is compared whole, but for members of a key's largest component, which meet members of others alone. So what is looked at
    # stays within a few times the pairs of different components. A large key's members are dealt in blocks, which the others go to, and
    # give the pairs that pass the bitmaps alone.
    size = held.select(*on, "most", "k", F.col("k").alias("rows"))
    named = salted(named, size, on, "rows", sent).withColumn("minor", F.col("c") != F.col("most")).drop("most")
    large = F.col("k") > LARGE
    x, y = (named.where(~large).select(*on, *[F.col(o).alias(o[0] + z) for o in ("minor", "rep", "n", "pos", "c")]) for z in "ab")
    rest = x.where("ma").join(y, on).where((~F.col("mb") | (F.col("ra") < F.col("rb"))) & (F.col("ca") != F.col("cb")) & fits("na", "pa", "nb", "pb"))
    members = named.where(large).join(maps.select("rep", "bits"), "rep").withColumn("blocks", F.ceil(F.col("k") / BLOCK))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    asking = members.where("minor").withColumns({"asks": F.lit(True), "block": F.explode(every)})
    dealt = asking.unionByName(members.withColumns({"asks": F.lit(False), "block": F.pmod(F.xxhash64("rep"), F.col("blocks"))}))
    near = dealt.groupBy(*on, "block").applyInPandas(lambda pdf: block_pairs(pdf, threshold), "a long, b long")
    pairs = rest.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).unionByName(near)
    return _union([*found, verify(pairs.distinct(), maps, texts, k, threshold)])


def block_pairs(pdf: pd.DataFrame, threshold: int) -> pd.DataFrame:
    """Pairs of an asking row and another that differ in component and can link by size, place and bitmap."""
    x, y = pdf[pdf["asks"]], pdf[~pdf["asks"]]
    b, nb, ib, cb = (y[c].to_numpy()[None, :] for c in ("rep", "n", "pos", "c"))
    xs, ys, out, step = x["bits"].tolist(), y["bits"].tolist(), [np.zeros((0, 2), np.int64)], max(1, (1 << 20) // max(1, len(y)))
    for at in range(0, len(x), step):
        a, na, ia, ca = (x[c].to_numpy()[at : at + step, None] for c in ("rep", "n", "pos", "c"))
        overlap = -(-(na + nb) * threshold // (100 + threshold))
        i, j = np.nonzero((ca != cb) & (100 * np.minimum(na, nb) >= threshold * np.maximum(na, nb)) & (na - ia >= overlap) & (nb - ib >= overlap))
        for k in range(0, len(i), 1 << 14):
            p, q = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
            ok = may_link([xs[at + u] for u in p], [ys[v] for v in q], na[p, 0], nb[0, q], threshold)
            u, v = a[p[ok], 0], b[0, q[ok]]
            out.append(np.stack([np.minimum(u, v), np.maximum(u, v)], 1))
    return pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["a", "b"])


def _lists_of(arrays: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def similar(documents: DataFrame, k: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id per row of documents."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, k))

    def measure(batches):
        values, rank = frequent.value
        for b in sliced(batches, 1):
            size, digest, first, bits = [], [], [], []
            for found in shingles(b.column(1), k):
                size.append(len(found))
                digest.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                first.append(prefix(found, values, rank, threshold).view(np.int64))
                bits.append(bitmap(found))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), _lists_of(first), pa.array(bits, pa.binary())], names=["doc_id", "n", "digest", "tokens", "bits"])

    sets = stored(docs.mapInArrow(measure, "doc_id long, n long, digest binary, tokens array<long>, bits binary"))
    n_rows = sets.count()
    known = sets.where("n > 0 and doc_id is not null")
    reps = stored(known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")))
    # Only these rows carry the long columns on; written once, as every later step reads them.
    first = reps.select(F.col("digest").alias("_digest"), "rep")
    nodes = known.join(first, (known["digest"] == first["_digest"]) & (known["doc_id"] == first["rep"]))
    nodes = stored(nodes.dropDuplicates(["rep", "digest"]).select("rep", "n", "tokens", "bits"))
    # Copies follow their set and take no part in the search; only ids that stand for several sets do, as they tie these together.
    several = stored(sets.where("doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("d"), F.max("digest").alias("e")).where("d < e").select("doc_id"))
    ties = salted(known.select("doc_id", "digest").join(several, "doc_id", "left_semi"), reps, ["digest"], "rows", n_rows).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = stored(components(links(nodes, docs, k, threshold).unionByName(ties)))
    of_set = reps.join(found, reps["rep"] == found["node"], "left").select("digest", "rows", F.coalesce("component", "rep").alias("of_set"))
    of_id = found.join(several, found["node"] == several["doc_id"], "left_semi").select("node", F.col("component").alias("of_id"))
    out = salted(sets.select("doc_id", "n", "digest"), of_set, ["digest"], "rows", n_rows, "left")
    out = out.join(of_id, out["doc_id"] == of_id["node"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("of_id", "of_set", "doc_id")).alias("component_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component)


def keep_one(documents: DataFrame, k: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """Of each component the document with the smallest id, with all its columns; rows without an id stay."""
    gone = similar(documents, k, threshold).where("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    left = documents.join(gone, documents["doc_id"] == gone["_gone"], "left_anti")
    # Rows that share an id are one document: one of them stays.
    return left.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(left.where("doc_id is null"))


def op9_jaccard_join(spark, sf_dir):
    return similar(table(spark, sf_dir, "documents"))


QUERIES = {"op9_jaccard_join": op9_jaccard_join}
SQL = {
    "op9_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, i + 2), ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * o >= 90 * (p.n + q.n - o)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.c = l.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1) LEFT JOIN n USING (doc_id)
"""
}
