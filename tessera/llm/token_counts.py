"""Token counts by greedy longest match in linear time: a vocabulary trie with failure links and precomputed counts of popped tokens.

At a node that has no child for the next byte, the longest token that starts where the match began is popped, and the failure link leads
to the node of what remains. Counts of popped tokens are stored with the links, so a word costs one step per byte and no piece is built.
Words are encoded with a leading space, which is how the vocabulary marks pieces that begin a word. A word with bytes that no token
covers counts as one token and as unknown.

Each task keeps the counts of words it has met in a memo of bounded size; nothing is shuffled. Defined results: null and empty texts have
no words and no tokens; null ids and repeated rows pass through, one output row per input row; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Words in a task's memo; it is emptied when full.
MEMO = 1_000_000


def vocabulary(path: str) -> dict[bytes, int]:
    """The tokens of a byte-level vocabulary file as bytes, with their ids; special tokens are left out. Printable Latin-1 bytes stand for themselves; the others for code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    with open(path, encoding="utf-8") as f:
        read = json.load(f)
    special = {t["content"] for t in read.get("added_tokens", ())}
    return {bytes(of[c] for c in t): i for t, i in read["model"]["vocab"].items() if t not in special and all(c in of for c in t)}


class Automaton:
    """child[node * 256 + byte], and per node its failure link (-1: none) and the number of tokens popped on the way."""

    def __init__(self, tokens: Iterable[bytes]):
        self.child: dict[int, int] = {}
        ends, n = {0: False}, 1
        for t in tokens:
            v = 0
            for b in t:
                if (w := self.child.get(v * 256 + b)) is None:
                    w = self.child[v * 256 + b] = n
                    ends[n] = False
                    n += 1
                v = w
            ends[v] = bool(t)
        below: dict[int, list[tuple[int, int]]] = {}
        for key, w in self.child.items():
            below.setdefault(key >> 8, []).append((key & 255, w))
        self.fail, self.pops = [-1] * n, [0] * n
        layer = [0]
        while layer:
            following = []
            for v in layer:
                for b, w in below.get(v, ()):
                    following.append(w)
                    if ends[w]:
                        self.fail[w], self.pops[w] = 0, 1
                        continue
                    z, popped = self.fail[v], self.pops[v]
                    while z != -1 and z * 256 + b not in self.child:
                        popped += self.pops[z]
                        z = self.fail[z]
                    if z != -1:
                        self.fail[w], self.pops[w] = self.child[z * 256 + b], popped
            layer = following

    def count(self, word: bytes) -> int:
        """Tokens of the greedy longest match; -1 if the word can't be matched."""
        child, fail, pops, v, n = self.child, self.fail, self.pops, 0, 0
        for b in word:
            while (w := child.get(v * 256 + b)) is None:
                if fail[v] == -1:
                    return -1
                n += pops[v]
                v = fail[v]
            v = w
        while v:
            if fail[v] == -1:
                return -1
            n += pops[v]
            v = fail[v]
        return n


def count_tokens(documents: DataFrame, tokens: Iterable[bytes]) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown per row of documents. The automaton is broadcast; its size follows from the vocabulary alone."""
    shared = documents.sparkSession.sparkContext.broadcast(Automaton(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, memo = shared.value.count, {}
        for batch in batches:
            words, total, unknown = [], [], []
            for text in batch.column(1).to_pylist():
                found = (text or "").encode().split()
                n = odd = 0
                for w in found:
                    if (k := memo.get(w)) is None:
                        if len(memo) >= MEMO:
                            memo.clear()
                        k = memo[w] = count(b" " + w)
                    if k < 0:
                        odd += 1
                        k = 1
                    n += k
                words.append(len(found))
                total.append(n)
                unknown.append(odd)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (words, total, unknown))], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")


def op6_token_counts(spark, sf_dir):
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary(public_tokenizers.path("byte_bpe_50k.json")))


QUERIES = {"op6_token_counts": op6_token_counts}
SQL: dict[str, str] = {}
