"""Packing as vector bin packing: the dot-product heuristic places examples under limits on tokens, segments and loss-bearing tokens.

A bin stands open at a time. Of the waiting examples that fit in every dimension, the one whose demand has the largest dot product with
the bin's remaining capacity goes in; when none fits, the bin closes. Where cutting is allowed, the largest waiting example is first cut
to fill the bin's last tokens, so only what is left at the end of a task could be padded.

Each task packs what it reads: nothing is shuffled, the waiting pool is bounded, and a repeated task gives the same bins. Ids of bins
hold the task's number in their upper bits.

Defined results: a null text counts as empty and still has its closing id; null ids and repeated rows are packed like others; an empty
table gives no rows; columns other than those named are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .token_counts import vocabulary

LENGTH = 1024
#: Most segments and loss-bearing tokens in a sequence of instruction data. Documents have no such limits: all their tokens bear loss.
SEGMENTS, LOSS = 16, 512
#: Waiting examples: bins are made when there are so many, until half are left.
POOL = 1024
#: The id that ends each document.
END = 0


class Packer:
    """Waiting examples and the dot-product heuristic. Demands are (tokens, segments, loss tokens), scaled by the limits."""

    def __init__(self, limits: tuple[int, int, int], cut: bool):
        self.limits, self.cut = np.array(limits, np.int64), cut
        self.need = np.zeros((2 * POOL, 3), np.int64)
        self.what: list = []

    def add(self, what, tokens: int, loss: int) -> None:
        """what: anything with slicing if cutting is allowed; then every token bears loss."""
        if len(self.what) == len(self.need):
            self.need = np.concatenate([self.need, np.zeros_like(self.need)])
        self.need[len(self.what)] = tokens, 1, loss
        self.what.append(what)

    def take(self, i: int):
        what, last = self.what[i], len(self.what) - 1
        self.what[i] = self.what[last]
        self.need[i] = self.need[last]
        self.what.pop()
        return what

    def bin(self) -> list:
        """The next bin's examples in order."""
        rest, out = self.limits.copy(), []
        while self.what:
            need = self.need[: len(self.what)]
            fits = (need <= rest).all(axis=1)
            if fits.any():
                i = int(np.where(fits, (need / self.limits) @ (rest / self.limits), -1.0).argmax())
                rest -= need[i]
                out.append(self.take(i))
                continue
            room = int(min(rest[0], rest[2]))
            if self.cut and room and rest[1]:
                i = int(need[:, 0].argmax())
                out.append(self.what[i][:room])
                self.what[i] = self.what[i][room:]
                self.need[i] -= (room, 0, room)
            elif not out:  # beyond a limit on its own and not to be cut: a bin to itself
                out.append(self.take(0))
            break
        return out


def numbered() -> Iterator[int]:
    """Ids of bins: unique over tasks, the same when a task is repeated."""
    n = TaskContext.get().partitionId() << 40
    while True:
        yield n
        n += 1


class Pieces:
    """Part of a document: its ids from start on."""

    __slots__ = ("doc", "ids", "start", "total")

    def __init__(self, doc, ids, start, total):
        self.doc, self.ids, self.start, self.total = doc, ids, start, total

    def __getitem__(self, s: slice) -> Pieces:
        return Pieces(self.doc, self.ids[s], self.start + (s.start or 0), self.total)

    def __len__(self) -> int:
        return len(self.ids)


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a vocabulary file, which stand in a text as they are written, with their ids."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f).get("added_tokens", ())
    if any(t[flag] for t in found for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that look at their neighbours are not supported")
    return {t["content"]: t["id"] for t in found}


def byte_bpe(tokens: dict[bytes, int], pattern: str, special: dict[str, int] | None = None):
    """A byte-level BPE encoder over a vocabulary whose ids are its merge ranks, as public vocabularies of this kind have.

    The tests hold its ids against those of the tokenizers library on whole tables; it is three times as fast."""
    import tiktoken

    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=tokens, special_tokens=special or {})


DOCUMENT_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(documents: DataFrame, tokens: dict[bytes, int], pattern: str, length: int = LENGTH, segments: int | None = None, special: dict[str, int] | None = None) -> DataFrame:
    """Packs all of documents, a row per piece. Pieces as long as a sequence stand alone; the rest of each document waits in the pool.

    tokens: the vocabulary with its ids, broadcast; its size does not depend on the corpus. special: strings that have an id of their own
    wherever a text holds them, as the library's added tokens do at its default settings."""
    shared = documents.sparkSession.sparkContext.broadcast((tokens, special))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary_, special_ = shared.value
        encode = byte_bpe(vocabulary_, pattern, special_).encode_to_numpy
        packer, ids, rows = Packer((length, segments or length, length), cut=True), numbered(), []

        def put(pieces: list) -> None:
            k, at = next(ids), 0
            for p in pieces:
                rows.append((p.doc, p.start, len(p), zlib.crc32(p.ids.tobytes()), p.total, k, at))
                at += len(p)

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = np.append(encode(text.as_py() or "", allowed_special="all"), np.uint32(END)).astype("<u4")
                whole = Pieces(doc, found, 0, len(found))
                tail = len(found) // length * length
                for at in range(0, tail, length):
                    put([whole[at : at + length]])
                if tail < len(found):
                    packer.add(rest := whole[tail:], len(rest), len(rest))
                while len(packer.what) >= POOL:
                    while len(packer.what) > POOL // 2:
                        put(packer.bin())
                if len(rows) > 50_000:
                    yield flush()
        while packer.what:
            pieces = packer.bin()
            while n := sum(map(len, pieces)):  # the last is not full: powers of two need no padding
                room, first = 1 << (n.bit_length() - 1), []
                while room:
                    p = pieces.pop(0)
                    first.append(p[:room])
                    if len(p) > room:
                        pieces.insert(0, p[room:])
                    room -= len(first[-1])
                put(first)
        yield flush()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, DOCUMENT_SCHEMA)


def pack_examples(examples: DataFrame, tokens: int, segments: int, loss_tokens: int) -> DataFrame:
    """Packs whole examples (id, n_tokens, n_loss_tokens) of instruction data, never cut: id, sequence_id, place, offset.

    Null counts are 0. An example beyond a limit on its own gets a sequence to itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, ids = Packer((tokens, segments, loss_tokens), cut=False), numbered()

        def bins(left: int) -> pa.RecordBatch:
            rows = []
            while len(packer.what) > left:
                k, at = next(ids), 0
                for place, (i, n) in enumerate(packer.bin()):
                    rows.append((i, k, place, at))
                    at += n
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["id", "sequence_id", "place", "offset"])

        for batch in batches:
            for i, n, loss in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                packer.add((i, n), n, loss)
                if len(packer.what) >= POOL:
                    yield bins(POOL // 2)
        yield bins(0)

    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return examples.select(F.col("id").cast("long").alias("id"), count("n_tokens"), count("n_loss_tokens")).mapInArrow(run, "id long, sequence_id long, place long, offset long")


def op5_vector_packing(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary(path), public_tokenizers.PATTERN, special=added_tokens(path))


def conversation_examples(conversations: DataFrame, tokens: dict[bytes, int], pattern: str, special: dict[str, int] | None = None, learned: str = "assistant") -> DataFrame:
    """id, n_tokens, n_loss_tokens per conversation: every turn has its ids and a closing one, those of the learned role bear loss.

    Null texts count as empty, null roles bear no loss; rows without a conversation are one example."""
    shared = conversations.sparkSession.sparkContext.broadcast((tokens, special))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(shared.value[0], pattern, shared.value[1]).encode_to_numpy
        for b in batches:
            n = pa.array([len(encode(t.as_py() or "", allowed_special="all")) + 1 for t in b.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], names=["id", "role", "n"])

    turns = conversations.select(F.col("conv_id").cast("long").alias("id"), "role", "text").mapInArrow(count, "id long, role string, n long")
    return turns.groupBy("id").agg(F.sum("n").alias("n_tokens"), F.sum(F.when(F.col("role") == learned, F.col("n")).otherwise(0)).alias("n_loss_tokens"))


def pack_conversations(spark, sf_dir):
    """Whole conversations under limits on tokens, segments and loss-bearing tokens: id, sequence_id, place, offset."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    examples = conversation_examples(table(spark, sf_dir, "conversations"), vocabulary(path), public_tokenizers.PATTERN, added_tokens(path))
    return pack_examples(examples, LENGTH, SEGMENTS, LOSS)


QUERIES = {"op5_vector_packing": op5_vector_packing, "pack_conversations": pack_conversations}
SQL: dict[str, str] = {}
