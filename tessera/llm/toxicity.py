"""Toxicity by a linear-chain conditional random field over words.

A line is a chain of words with two states, clean and toxic. Word scores sum weights of hashed features (the word, its prefixes and
suffixes); transitions have weights of their own. Forward-backward gives each word's marginal probability of being toxic. A document's
score is a logistic function of the sum of squared marginals, a count of toxic words to which doubtful ones add little, and spans are runs of words above one half.

The labels are of documents, so tokens are labelled first: a word in a toxic document is a toxic token if documents with one of its
features are toxic far more often than others, over the labelled documents outside the held-out fold. Of these a sample of about SAMPLE
rows of each label is learned from, with their whole texts: sketches, features and scores are made and counted in Spark, and the driver,
which trains the field in numpy, gets a sketch a row, the features that mark toxic tokens, and LINES stretches of at most STRETCH words.

Defined results: null and empty texts get the score of no toxic words; without labelled rows every score is 0. Null ids and repeated rows
pass through, one output row per input row. Columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, stored, table

#: Labelled documents learned from, for each label.
SAMPLE = 1500
#: Weights, training stretches and their longest, passes; lengths of prefixes and suffixes.
WEIGHTS, LINES, STRETCH, EPOCHS, AFFIXES = 1 << 18, 6000, 256, 8, (5, 6, 7)
#: A feature marks toxic tokens if toxic documents are such a share of those that have it, both labels weighing the same, and if this is
#: beyond chance: so many nats of evidence, or such a share of what a feature of all toxic documents and no other would have, if less. If
#: none does, the feature with most evidence marks them. The driver takes at most MARKS features.
SHARE, EVIDENCE, PERFECT, MARKS = 0.9, 15.0, 0.4, 50_000
SKETCH = 48
MEMO = 400_000
WORDS = re.compile(r"[^\W\d_]+")
THRESHOLD = 0.7


def features(word: str) -> list[str]:
    return ["w" + word, *["<" + word[:n] for n in AFFIXES if len(word) > n], *[">" + word[-n:] for n in AFFIXES if len(word) > n]]


def hashed(word: str) -> list[int]:
    return [zlib.crc32(f.encode()) % WEIGHTS for f in features(word)]


def chains(text: str) -> list[list[str]]:
    return [ws for line in text.lower().split("\n") if (ws := WORDS.findall(line))]


def forward_backward(e: np.ndarray, n: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains (B, T) of toxic-state scores e (the clean state scores 0) with lengths n: toxic marginals, expected transitions, log Z."""
    b, t = e.shape
    s = np.stack([np.zeros_like(e), e], 2)
    f = np.empty((t, b, 2))
    f[0] = start + s[:, 0]
    for i in range(1, t):
        f[i] = np.logaddexp(f[i - 1][:, :1] + trans[0], f[i - 1][:, 1:] + trans[1]) + s[:, i]
    back, pairs, m = np.zeros((b, 2)), np.zeros((2, 2)), np.zeros((b, t))
    z = np.logaddexp(*f[n - 1, np.arange(b)].T)
    for i in range(t - 1, -1, -1):
        m[:, i] = np.where(i < n, np.exp(np.minimum(f[i][:, 1] + back[:, 1] - z, 0)), 0)
        if i:
            on = s[:, i] + back
            p = np.exp(np.minimum(f[i - 1][:, :, None] + trans + on[:, None, :] - z[:, None, None], 0))
            pairs += p[i < n].sum(0)
            back = np.where((i < n)[:, None], np.logaddexp(trans[:, 0] + on[:, :1], trans[:, 1] + on[:, 1:]), back)
    return m, pairs, z


def marginals(e: np.ndarray, n: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Toxic marginals only, by odds ratios: r = toxic over clean, one number per chain and step in each direction."""
    b, t = e.shape
    w, (a, c), q = np.exp(np.clip(e, -30, 30)).T.copy(), np.exp(trans), np.exp(start[1] - start[0])
    f, back = np.empty((t, b)), np.ones(b)
    f[0] = q * w[0]
    for i in range(1, t):
        f[i] = w[i] * (a[1] + c[1] * f[i - 1]) / (a[0] + c[0] * f[i - 1])
    out = np.empty((t, b))
    for i in range(t - 1, -1, -1):
        x = f[i] * back
        out[i] = x / (1 + x)
        x = w[i] * back
        back = np.where(i < n, (c[0] + c[1] * x) / (a[0] + a[1] * x), 1.0)
    return out.T


class Field:
    def __init__(self):
        self.w, self.trans, self.start, self.cut = np.zeros(WEIGHTS), np.zeros((2, 2)), np.zeros(2), np.array([0.0, 0.0])

    def word(self, word: str) -> float:
        return float(self.w[hashed(word)].sum())

    def train(self, lines: list[list[str]], labels: list[list[bool]], rate: float = 0.3, decay: float = 1e-5) -> None:
        """Stochastic ascent of the likelihood with per-weight rates, over batches of lines of like length."""
        rng, seen, memo = np.random.default_rng(5), np.full(WEIGHTS, 1e-3), {}
        for ws in lines:
            for x in ws:
                if x not in memo:
                    memo[x] = hashed(x)
        order = sorted(range(len(lines)), key=lambda i: len(lines[i]))
        batches = [order[i : i + 128] for i in range(0, len(order), 128)]
        tseen, sseen = np.full((2, 2), 1e-3), np.full(2, 1e-3)
        for _ in range(EPOCHS):
            for k in rng.permutation(len(batches)):
                some = batches[k]
                n = np.array([len(lines[i]) for i in some])
                place = [(r, c) for r, i in enumerate(some) for c in range(len(lines[i]))]
                ids = [memo[x] for i in some for x in lines[i]]
                flat, many = np.concatenate(ids), np.array([len(x) for x in ids])
                owner = np.repeat(np.arange(len(ids)), many)
                rows, cols = np.array(place).T
                e = np.zeros((len(some), n.max()))
                e[rows, cols] = np.bincount(owner, self.w[flat], len(ids))
                y = np.zeros(e.shape, int)
                y[rows, cols] = [v for i in some for v in labels[i]]
                m, pairs, _ = forward_backward(e, n, self.trans, self.start)
                g = np.bincount(flat, (y - m)[rows, cols][owner], WEIGHTS) / len(some)
                hit = np.unique(flat)
                seen[hit] += g[hit] ** 2
                self.w[hit] += rate * g[hit] / np.sqrt(seen[hit]) - decay * self.w[hit]
                own = np.zeros((2, 2))
                ok = np.arange(1, e.shape[1])[None, :] < n[:, None]
                np.add.at(own, (y[:, :-1][ok], y[:, 1:][ok]), 1)
                gt, gs = (own - pairs) / n.sum(), np.array([(m - y)[:, 0].mean(), (y - m)[:, 0].mean()])
                tseen += gt**2
                sseen += gs**2
                self.trans += 0.3 * gt / np.sqrt(tseen)
                self.start += 0.3 * gs / np.sqrt(sseen)

    def tag(self, lines: list[list[str]], memo: dict) -> list[np.ndarray]:
        """Marginals of each line's words. Lines of like length share a batch of bounded area."""
        out: list = [None] * len(lines)
        order, at = sorted(range(len(lines)), key=lambda i: len(lines[i])), 0
        while at < len(order):
            longest, end = len(lines[order[at]]), at
            while end < len(order) and len(lines[order[end]]) <= longest * 1.25 + 8 and (end - at) * len(lines[order[end]]) < 1 << 19:
                end += 1
            some = order[at : (end := max(end, at + 1))]
            n = np.array([len(lines[i]) for i in some])
            e = np.zeros((len(some), n.max()))
            for r, i in enumerate(some):
                e[r, : n[r]] = np.fromiter(map(memo.__getitem__, lines[i]), float, n[r])
            m = marginals(e, n, self.trans, self.start)
            for r, i in enumerate(some):
                out[i] = m[r, : n[r]]
            at = end
        return out

    def score(self, expected: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.cut[0] + self.cut[1] * np.log1p(expected * 8), -40, 40)))

    def expected(self, text: str) -> float:
        lines = chains(text)
        return float(sum((m * m).sum() for m in self.tag(lines, {x: self.word(x) for ws in lines for x in ws})))

    def spans(self, text: str) -> list[tuple[int, int, float]]:
        """Offending runs of words as (start, end, highest marginal), in characters of the lower-cased text."""
        out, at = [], 0
        for line in text.lower().split("\n"):
            found = list(WORDS.finditer(line))
            if found:
                ws = [x.group() for x in found]
                run: list = []
                for x, p in zip([*found, None], [*self.tag([ws], {w: self.word(w) for w in ws})[0], 0.0], strict=True):
                    if p > 0.5:
                        run.append((x, float(p)))
                    elif run:
                        out.append((at + run[0][0].start(), at + run[-1][0].end(), max(p for _, p in run)))
                        run = []
            at += len(line) + 1
        return out


def learn(documents: DataFrame, labels: DataFrame) -> Field | None:
    """A field from at most about SAMPLE labelled documents of each label outside the held-out fold; the sample follows from the ids.

    None if one label is missing."""
    marks = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic"))
    counts = {r["_toxic"]: r["count"] for r in marks.groupBy("_toxic").count().collect()}
    if len(counts) < 2:
        return None
    part = F.when(F.col("_toxic") == 1, F.lit(min(1.0, SAMPLE / counts[1]))).otherwise(F.lit(min(1.0, SAMPLE / counts[0])))
    drawn = marks.where(F.pmod(F.xxhash64("_id", F.lit("toxic")), F.lit(1 << 20)) < part * (1 << 20)).distinct()
    docs = documents.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text")).where("_text is not null")
    kept = docs.join(F.broadcast(drawn), F.col("_doc") == F.col("_id"))  # bounded: about 2 * SAMPLE ids
    return fit(stored(kept.select(F.xxhash64("_text").alias("key"), F.col("_toxic").alias("toxic"), F.col("_text").alias("text")).dropDuplicates(["key", "toxic"])))


def sketch(text: str) -> list[int]:
    """The SKETCH smallest 4-word hashes of a text."""
    words = WORDS.findall(text.lower())
    return sorted({zlib.crc32(" ".join(words[k : k + 4]).encode()) for k in range(max(1, len(words) - 3))})[:SKETCH]


def distinct(sketches: list[list[int]]) -> list[int]:
    """Places of the sketches without later near copies, which would count as evidence of their own: those that share a sixth with one
    kept before."""
    kept, seen = [], {}
    for i, found in enumerate(sketches):
        same = Counter(j for h in found for j in seen.get(h, ()))
        if not same or max(same.values()) * 6 < len(found):
            kept.append(i)
            for h in found:
                seen.setdefault(h, []).append(i)
    return kept


def per_text(rows: DataFrame, of, schema: str) -> DataFrame:
    """key, toxic and what ``of`` makes of each text, a row for each of its results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                found = of(text.as_py(), toxic)
                kinds = [pa.int64(), pa.int32(), *[f.type for f in wanted]]
                cols = [[key] * len(found), [toxic] * len(found), *(zip(*found, strict=True) if found else [[]] * len(wanted))]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["key", "toxic", *[f.name for f in wanted]])

    names = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    kind = lambda t: pa.list_(names[t[6:-1]]) if t.startswith("array") else names[t]
    wanted = [pa.field(n, kind(t)) for n, t in (c.strip().split(" ") for c in schema.split(","))]
    return rows.select("key", F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(run, f"key long, toxic int, {schema}")


def stretches(text: str, toxic: int, marked: set[str]) -> list[tuple]:
    """The lines of a text in stretches of at most STRETCH words: (words, whether each is a toxic token, whether any is)."""
    memo: dict[str, bool] = {}
    for ws in chains(text):
        for x in ws:
            if x not in memo:
                memo[x] = bool(toxic) and any(f in marked for f in features(x))
    parts = [ws[i : i + STRETCH] for ws in chains(text) for i in range(0, len(ws), STRETCH)]
    return [(ws, y, any(y)) for ws in parts for y in [[memo[x] for x in ws]]]


def fit(rows: DataFrame) -> Field | None:
    """A field from (key, toxic, text) rows, a table of bounded length."""
    sketches = sorted((r["toxic"], r["key"], r["sketch"]) for r in per_text(rows, lambda t, _: [(sketch(t),)], "sketch array<long>").collect())
    kept = [sketches[i][:2] for i in distinct([s for *_, s in sketches])]
    n, n_toxic = len(kept), sum(y for y, _ in kept)
    if not 0 < n_toxic < n:
        return None
    part = n_toxic / n
    rows = rows.join(F.broadcast(rows.sparkSession.createDataFrame(kept, "toxic int, key long")), ["toxic", "key"])
    own = lambda t, _: [(f,) for f in sorted({f for x in {x for ws in chains(t) for x in ws} for f in features(x)})]
    k, m = F.sum("toxic"), F.sum(1 - F.col("toxic"))
    seen = per_text(rows, own, "feature string").groupBy("feature").agg(k.alias("k"), m.alias("m")).where(f"k * {1 - part} > {SHARE} * (k * {1 - part} + m * {part})")
    evidence = F.col("k") * F.log(F.col("k") / ((F.col("k") + F.col("m")) * part)) + F.when(F.col("m") > 0, F.col("m") * F.log(F.col("m") / ((F.col("k") + F.col("m")) * (1 - part)))).otherwise(0)
    found = [(r["feature"], r["e"]) for r in seen.withColumn("e", evidence).orderBy(F.desc("e"), "feature").limit(MARKS).collect()]
    least = min(EVIDENCE, PERFECT * n_toxic * float(np.log(1 / part)))
    marked = {f for f, e in found if e > least} or {f for f, e in found if e == found[0][1]}
    if not marked:
        return None
    lines = stored(per_text(rows, lambda t, y: stretches(t, y, marked), "words array<string>, labels array<boolean>, any boolean"))
    some = [lines.where(F.col("any") == x).select("words", "labels").orderBy(F.xxhash64("words", "key"), "words").limit(LINES // 2).collect() for x in (True, False)]
    used = sorted((r["words"], r["labels"]) for half in some for r in half)
    field = Field()
    field.train([ws for ws, _ in used], [y for _, y in used])
    sums = sorted((r["toxic"], r["x"]) for r in per_text(rows, lambda t, _: [(field.expected(t),)], "x double").collect())
    x, z, c = np.log1p(8 * np.array([s for _, s in sums])), np.array([y for y, _ in sums], float), np.array([-2.0, 2.0])
    for _ in range(60):  # Newton steps of a logistic fit, held back by a small prior
        p = 1 / (1 + np.exp(-np.clip(c[0] + c[1] * x, -30, 30)))
        v = p * (1 - p) + 1e-9
        h = np.array([[v.sum() + 1, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 1]])
        c = c + np.clip(np.linalg.solve(h, [(z - p).sum() - c[0], ((z - p) * x).sum() - c[1]]), -1, 1)
    field.cut = c
    return field


def score(documents: DataFrame, field: Field | None, spans: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted (and the spans, if asked for) per row of documents. The field is broadcast; its size is fixed."""
    shared = documents.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, memo = shared.value, {}
        for batch in batches:
            texts, at = batch.column(2).to_pylist(), 0
            expected, found = np.zeros(len(texts)), [[] for _ in texts]
            while field and at < len(texts):
                lines, owner, size = [], [], 0
                while at < len(texts) and size < 1 << 21:
                    for ws in chains(texts[at] or ""):
                        lines.append(ws)
                        owner.append(at)
                    size += len(texts[at] or "")
                    at += 1
                if len(memo) > MEMO:
                    memo = {}
                for ws in lines:
                    for x in ws:
                        if x not in memo:
                            memo[x] = field.word(x)
                for i, m in zip(owner, field.tag(lines, memo), strict=True):
                    expected[i] += (m * m).sum()
            scores = field.score(expected) if field else expected
            cols = [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype(np.int32))]
            if spans:
                for i in np.flatnonzero(expected > 0.5):
                    found[i] = [{"start": a, "end": b, "p": p} for a, b, p in field.spans(texts[i])]
                cols.append(pa.array(found, kind))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "score", "predicted", "spans"][: len(cols)])

    schema = "doc_id long, held_out boolean, score double, predicted int" + ", spans array<struct<start: long, end: long, p: double>>" * spans
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, schema)


def op8_crf_toxicity(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return score(documents, learn(documents, table(spark, sf_dir, "labels")))


QUERIES = {"op8_crf_toxicity": op8_crf_toxicity}
SQL: dict[str, str] = {}
