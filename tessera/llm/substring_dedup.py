"""Substring dedup: Rabin-Karp hashes of every window of WINDOW words, counted in Spark; repeated windows merge into removal intervals.

A word goes if a window over it also starts in a document with a smaller id. Most windows repeat nowhere, so they are not shuffled one by
one. Of the GRAM-word hashes inside a window the smallest is its minimiser, which equal windows share; neighbouring windows mostly have the
same one and form a run, so about a fifth as many minimisers are sent. Where a minimiser occurs in one document only, no window around it
repeats. For the others whole runs are compared by hash, then, where runs with one minimiser differ (at the ends of passages), their single
windows, with two independent hashes of 61 bits in either case. The smallest document of each run and window is kept; what is found in a later one is a hit.
Windows are judged on the input, never on what is left.

Counts are combined before the shuffles, and the joins that lead back from hashes to documents are plain equi-joins of two stored or
scanned sides, which adaptive execution splits where a passage is hot. What is gathered per document is bounded by its own length.

Defined results: a null text has no words, and the digest is that of the empty text. Rows without an id are never earlier or later than
another: nothing is removed from them or because of them. Rows that share an id don't count as earlier than each other. Texts of fewer than
WINDOW words are kept whole. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, Words, mixed, salted, sliced, stored, table

WINDOW, GRAM = 13, 5
#: Two independent hashes of the same spans.
FIRST, SECOND = Rolling(101), Rolling(202)


def minimisers(words: Words, sums: np.ndarray, places: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """For each window that starts at places the smallest hash of a gram inside it. sums: those of FIRST."""
    starts = np.arange(max(0, len(words.index) - gram + 1))
    low, have, wide = FIRST.spans(sums, starts, starts + gram), 1, window - gram + 1
    while have < wide and len(low):
        more = min(have, wide - have)
        low = np.minimum(low[:-more], low[more:])
        have += more
    return low[places]


class Runs:
    """Runs of consecutive windows of a text with one minimiser, over a batch: the minimiser m, the text of each, its first window, and
    the end of its last."""

    def __init__(self, words: Words):
        self.words, self.first_sums, self.places = words, FIRST.sums(words), words.windows(WINDOW)
        low, text = minimisers(words, self.first_sums, self.places), words.text[self.places]
        turn = np.flatnonzero((low[1:] != low[:-1]) | (text[1:] != text[:-1])) + 1
        first = np.concatenate(([0], turn)) if len(low) else turn
        last = np.concatenate((turn, [len(low)])) - 1 if len(low) else turn
        self.m, self.text, self.start, self.end = low[first], text[first], self.places[first], self.places[last] + WINDOW
        self.size = last - first + 1

    def hashes(self) -> np.ndarray:
        """Of all words under each run."""
        self.second_sums = SECOND.sums(self.words)
        return SECOND.spans(self.second_sums, self.start, self.end)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Both hashes of each window at places, once ``hashes`` has been asked for."""
        return tuple(of.spans(sums, self.places, self.places + WINDOW) for of, sums in ((FIRST, self.first_sums), (SECOND, self.second_sums)))


def covered(places: np.ndarray, n: int, window: int = WINDOW) -> np.ndarray:
    """The maximal intervals of words under the windows at places, as a mask over n words."""
    edges = np.zeros(n + 1, np.int64)
    edges[places] += 1
    edges[places + window] -= 1
    return np.cumsum(edges[:n]) > 0


def intervals(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of removed words as (first, end)."""
    turns = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True))


def _lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    values, offsets = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum([0, *[n or 0 for n in column.value_lengths().to_pylist()]])
    return (values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True))


def _keys(text: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Numbers that tell (text of the batch, value) apart by a 64-bit hash."""
    return mixed(value ^ mixed(text.astype(np.uint64) + np.uint64(1)))


def _listed(column: pa.ListArray) -> np.ndarray:
    """The keys of a batch's lists of values."""
    n = np.array([k or 0 for k in column.value_lengths().to_pylist()], np.int64)
    return _keys(np.repeat(np.arange(len(n)), n), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))


def repeated_windows(documents: DataFrame) -> DataFrame:
    """doc_id and hits: per document the hashes of its runs, and of its single windows, that are also in a document with a smaller id."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")

    def send_minimisers(batches):
        for b in sliced(batches, 0):
            runs = Runs(Words(b.column(0)))
            _, at = np.unique(_keys(runs.text, runs.m), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(runs.m[at].view(np.int64))], names=["m"])

    def send_runs(batches):
        for b in sliced(batches, 1):
            runs = Runs(Words(b.column(1)))
            r = runs.hashes()
            _, at = np.unique(_keys(runs.text, r), return_index=True)
            yield _flat({"doc_id": b.column(0).to_numpy()[runs.text[at]], "m": runs.m[at], "r": r[at]})

    shared = stored(docs.select("text").mapInArrow(send_minimisers, "m long").groupBy("m").count().where("count > 1"))
    sent = shared.agg(F.sum("count")).first()[0] or 0
    found = stored(salted(docs.mapInArrow(send_runs, "doc_id long, m long, r long"), shared, ["m"], "count", sent))
    first = stored(found.groupBy("m", "r").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("count")))
    whole = salted(found, first.where("least < most").drop("most"), ["m", "r"], "count", sent).where("doc_id > least").select("doc_id", F.col("r").alias("hit"))

    # Runs end where passages do, so the same window may lie in different runs. Later copies of a run are hits already; its first document
    # alone is still open, and only where another run has the same minimiser.
    several = first.groupBy("m").agg(F.count("*").alias("count")).where("count > 1")
    asked = salted(first.select("m", "r", "least"), several, ["m"], "count", sent).groupBy(F.col("least").alias("doc_id")).agg(F.collect_set("r").alias("rs"))

    def send_windows(batches):
        for b in sliced(batches, 1):
            runs = Runs(Words(b.column(1)))
            on = np.isin(_keys(runs.text, runs.hashes()), _listed(b.column(2)))
            at = np.flatnonzero(np.repeat(on, runs.size))
            (one, two), text = (h[at] for h in runs.windows()), runs.words.text[runs.places[at]]
            _, once = np.unique(_keys(text, one), return_index=True)
            yield _flat({"h1": one[once], "h2": two[once], "doc_id": b.column(0).to_numpy()[text[once]]})

    open_ = stored(docs.join(asked, "doc_id").select("doc_id", "text", "rs").mapInArrow(send_windows, "h1 long, h2 long, doc_id long"))
    early = open_.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("count"))
    early = stored(early.where("least < most").drop("most"))
    single = salted(open_, early, ["h1", "h2"], "count", sent).where("doc_id > least").select("doc_id", F.col("h1").alias("hit"))
    return stored(whole.unionByName(single)).groupBy("doc_id").agg(F.collect_set("hit").alias("hits"))


def _flat(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64)) for x in columns.values()], names=list(columns))


def dedup(documents: DataFrame, text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and removed intervals and the kept text, if asked for) per row of documents."""
    hits = repeated_windows(documents).withColumnRenamed("doc_id", "_id")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def remove(batches):
        for b in sliced(batches, 1):
            words, hit = Words(b.column(1)), _listed(b.column(2))
            mask = np.zeros(len(words.index), bool)
            if len(hit):
                runs = Runs(words)
                on = np.repeat(np.isin(_keys(runs.text, runs.hashes()), hit), runs.size)
                rest = np.flatnonzero(~on)
                on[rest] = np.isin(_keys(words.text[runs.places], runs.windows()[0])[rest], hit)
                mask = covered(runs.places[on], len(mask))
            removed = np.concatenate(([0], np.cumsum(mask)))
            removed = removed[words.at[1:]] - removed[words.at[:-1]]
            digests, spans, kept_texts = [], [], []
            for i, t in enumerate(b.column(1)):
                kept = (t.as_py() or "").encode().split()
                gone = mask[words.at[i] : words.at[i + 1]]
                if removed[i]:
                    kept = [w for w, x in zip(kept, gone.tolist(), strict=True) if not x]
                kept = b" ".join(kept)
                digests.append(hashlib.sha256(kept).hexdigest())
                if text:
                    spans.append([{"first": a, "end": z} for a, z in intervals(gone)])
                    kept_texts.append(kept.decode())
            kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
            cols = [b.column(0), pa.array(words.n), pa.array(removed), pa.array(digests, pa.string()), *([pa.array(spans, kind), pa.array(kept_texts, pa.string())] if text else [])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept_sha256", "removed", "kept"][: len(cols)])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", removed array<struct<first: long, end: long>>, kept string" * text
    return rows.join(hits, rows["doc_id"] == hits["_id"], "left").select("doc_id", "text", "hits").mapInArrow(remove, schema)


def op3_substring_dedup(spark, sf_dir):
    return dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op3_substring_dedup": op3_substring_dedup}
SQL = {
    "op3_substring_dedup": r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT rid, doc_id, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT rid, doc_id, i, string_agg(x, ' ') OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS g, n FROM p),
f AS (SELECT md5(g) AS g, min(doc_id) AS least FROM g WHERE i <= n - 12 GROUP BY 1),
h AS (SELECT DISTINCT rid, i FROM g JOIN f ON md5(g.g) = f.g WHERE i <= n - 12 AND doc_id > least),
r AS (SELECT DISTINCT rid, i + j AS i FROM h, range(13) t(j)),
k AS (SELECT p.rid, count(r.i)::BIGINT AS n_removed, coalesce(string_agg(x, ' ' ORDER BY p.i) FILTER (WHERE r.i IS NULL), '') AS kept FROM p LEFT JOIN r ON p.rid = r.rid AND p.i = r.i GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (rid)
"""
}
