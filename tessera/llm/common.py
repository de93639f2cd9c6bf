"""What the operators share: the word pattern, table access, folds, joins on hot keys and window hashes."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Most keys that count as hot in a join, and rows below which none does.
HOT_KEYS, HOT_ROWS = 10_000, 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """The fold that no model may learn from: crc32(doc_id as text) mod 3 = 1. A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share; one of our own only in local mode, where the session names none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or "/tmp/checkpoints/tessera"


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared checkpoint folder, read again: the lineage ends there, and a lost executor costs nothing.

    The table goes when the application ends."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark).rstrip('/')}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    # Spark deletes shuffle files when the driver's garbage collection finds them unused. Those of this write are: let it see them now.
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def salted(many: DataFrame, one: DataFrame, on: list[str], rows: str, total: int, how: str = "inner") -> DataFrame:
    """many, of about total rows, joined with one, which is unique in ``on`` and whose column ``rows`` says how many rows of many a key has.

    Keys with more than max(HOT_ROWS, total / HOT_KEYS) rows are dealt over several tasks: their row of one is copied. There are about
    HOT_KEYS such keys at most, so that list alone is broadcast."""
    bound = max(HOT_ROWS, total // HOT_KEYS)
    parts = F.ceil(F.col(rows) / bound).cast("int")
    hot = one.where(F.col(rows) > bound).select(*on, parts.alias("_parts"))
    others = [c for c in many.columns if c not in on]
    dealt = many.join(F.broadcast(hot), on, "left").withColumn("_salt", F.pmod(F.xxhash64(*others), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    copied = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col(rows) > bound, parts - 1).otherwise(0))))
    return dealt.join(copied.drop(rows), [*on, "_salt"], how).drop("_salt")


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over uint64 arrays."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


PRIME = (1 << 61) - 1
_P, _LOW31, _LOW30 = np.uint64(PRIME), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_30, _31, _61 = np.uint64(30), np.uint64(31), np.uint64(61)


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME."""
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def product(a: np.ndarray, b) -> np.ndarray:
    """a * b modulo PRIME, for uint64 numbers below it: by halves of 31 bits, with 2^61 = 1."""
    a1, a0, b1, b0 = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    mid = a1 * b0 + a0 * b1
    return reduced(np.uint64(2) * a1 * b1 + (mid >> _30) + ((mid & _LOW30) << _31) + a0 * b0)


class Rolling:
    """Rabin-Karp hashes of spans of words modulo the prime 2^61 - 1: a prefix sum of code[word] * base^place, scaled back by base^-start.

    The code of a word is a keyed hash of its bytes, and key and base follow from the seed: two seeds give independent hashes. Different
    sequences of n words agree by a chance of about n / 2^61."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.key = "".join(map(chr, rng.integers(33, 127, 16)))
        self.base = int(rng.integers(2**40, PRIME - 1))
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        for name, x in (("up", self.base), ("down", pow(self.base, -1, PRIME))):
            p = getattr(self, name)
            while len(p) < n:
                p = np.concatenate([p, product(p, np.uint64(pow(x, len(p), PRIME)))])
            setattr(self, name, p)

    def sums(self, words: Words) -> np.ndarray:
        """Prefix sums over all words of a batch."""
        self.powers(len(words.index) + 1)
        names = words.names.to_numpy(zero_copy_only=False)
        codes = pd.util.hash_array(names, hash_key=self.key, categorize=False) % np.uint64(PRIME - 1) + np.uint64(1) if len(names) else np.zeros(0, np.uint64)
        x = product(codes[words.index], self.up[: len(words.index)])
        out = np.zeros(len(x) + 1, np.uint64)
        high = np.cumsum(x >> _31, dtype=np.uint64)
        out[1:] = reduced((high >> _30) + ((high & _LOW30) << _31) + np.cumsum(x & _LOW31, dtype=np.uint64))
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return product(reduced(sums[end] + _P - sums[start]), self.down[start])


class Words:
    """The words of a batch of texts: distinct ones in names, their order in index; text i has the places at[i] to at[i + 1]."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.ascii_trim_whitespace(pc.fill_null(texts, ""))
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
        encoded = lists.flatten().dictionary_encode()
        self.names, self.index = encoded.dictionary, encoded.indices.to_numpy()
        self.n = np.where(pc.binary_length(texts).to_numpy() > 0, pc.list_value_length(lists).to_numpy(), 0).astype(np.int64)
        real = pc.binary_length(self.names).to_numpy(zero_copy_only=False) > 0
        if not real.all():  # an empty text is one empty word to the splitter
            self.index = self.index[real[self.index]]
        self.at = np.concatenate(([0], np.cumsum(self.n)))
        self.text = np.repeat(np.arange(len(self.n)), self.n)

    def windows(self, k: int) -> np.ndarray:
        """Places where k consecutive words of one text start."""
        places = np.arange(max(0, len(self.index) - k + 1))
        return places[places + k <= self.at[self.text[: len(places)] + 1]]


#: Rows and bytes of text in a slice of a batch, so that what a task holds is bounded.
SLICE, SLICE_BYTES = 2000, 2 << 20


def sliced(batches: Iterator[pa.RecordBatch], text: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of at most SLICE rows, and, if the place of a text column is given, about SLICE_BYTES of text."""
    for b in batches:
        at = 0
        ends = None if text is None else np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        while at < b.num_rows:
            n = min(SLICE, b.num_rows - at)
            if ends is not None:
                n = min(n, max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")) - at))
            yield b.slice(at, n)
            at += n
