"""Substring dedup and the Jaccard join against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, jaccard_join, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_dedup(rows):
    first = {}
    split = [(i, WORD.findall(t or "")) for i, t, *_ in rows]
    for i, w in split:
        for k in range(len(w) - 12):
            if i is not None:
                first[tuple(w[k : k + 13])] = min(i, first.get(tuple(w[k : k + 13]), i))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def test_dedup_is_brute_force(docs, rows):
    assert Counter(tuple(r) for r in substring_dedup.dedup(docs).collect()) == brute_dedup(rows)


def test_texts_that_a_hash_modulo_a_power_of_two_confuses(spark):
    """Thue-Morse words collide modulo 2^64 whatever the base."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    word = lambda flip: "".join("ab"[b ^ flip] for b in bits)
    same = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join([word(0), *same])), (2, " ".join([word(1), *same])), (3, " ".join("ab"[b] for b in bits)), (4, " ".join("ab"[1 - b] for b in bits[:900]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in substring_dedup.dedup(df).collect())
    assert got == brute_dedup(rows) and {r[0]: r[2] for r in got}[2] == 0
    for k in (13, 1024):
        assert Counter(map(tuple, jaccard_join.similar(df, k).collect())) == brute_components(rows, k, 90)


def test_products_modulo_the_prime():
    rng = np.random.default_rng(0)
    a, b = (np.concatenate([rng.integers(0, common.PRIME, 500, dtype=np.uint64), np.array([0, 1, common.PRIME - 1], np.uint64)]) for _ in range(2))
    assert common.product(a, b).tolist() == [x * y % common.PRIME for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def test_salted_join_is_a_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    many = spark.createDataFrame([(i % 7 if i < 50 else 7, i) for i in range(500)] + [(None, 1)], "k int, x int")
    one = many.groupBy("k").agg(F.max("x").alias("y"), F.count("*").alias("rows")).where("k <> 3")
    want = many.join(one, "k").select("k", "x", "y")
    assert Counter(map(tuple, common.salted(many, one, ["k"], "rows", 500).collect())) == Counter(map(tuple, want.collect()))
    left = many.join(one, "k", "left").select("k", "x", "y")
    assert Counter(map(tuple, common.salted(many, one, ["k"], "rows", 500, "left").collect())) == Counter(map(tuple, left.collect()))


def test_dedup_text_and_intervals(docs):
    for r in substring_dedup.dedup(docs, text=True).collect():
        assert sum(x["end"] - x["first"] for x in r["removed"]) == r["n_removed"]
        assert hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"]


def test_empty_tables(empty):
    assert substring_dedup.dedup(empty).count() == 0
    assert jaccard_join.similar(empty).count() == 0


def sets_of(text, k):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(rows, k, threshold):
    sets = [(i, sets_of(t, k)) for i, t, *_ in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= threshold * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return Counter((i, len(s), None if i is None else root(i)) for i, s in sets)


@pytest.mark.parametrize(("k", "threshold", "pairs"), [(3, 90, 100_000), (5, 80, 100_000), (3, 60, 0), (3, 90, 0)])
def test_join_is_brute_force(docs, rows, monkeypatch, k, threshold, pairs):
    """pairs = 0 with few leaders makes even small groups go through leader rounds and blocks."""
    if not pairs:
        monkeypatch.setattr(jaccard_join, "PAIRS", 0)
        monkeypatch.setattr(jaccard_join, "PAIRS_EACH", 0)
        monkeypatch.setattr(jaccard_join, "LEADERS", 1)
        monkeypatch.setattr(jaccard_join, "BLOCK", 3)
        monkeypatch.setattr(jaccard_join, "LARGE", 4)
    got = Counter(tuple(r) for r in jaccard_join.similar(docs, k, threshold).collect())
    assert got == brute_components(rows, k, threshold)


def test_keep_one(docs, rows):
    want = {c for (i, _, c) in brute_components(rows, 5, 80) if i is not None}
    got = jaccard_join.keep_one(docs, 5, 80)
    assert got.columns == docs.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want)
    assert ids.count(None) == 2


def test_bitmaps_never_drop_a_link():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 600))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.random() * 0.2], rng.integers(0, 2**63, int(rng.integers(0, 40))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 90 * (len(a) + len(b) - both):
            assert jaccard_join.may_link([jaccard_join.bitmap(a)], [jaccard_join.bitmap(b)], np.array([len(a)]), np.array([len(b)]), 90).all()


def test_members_of_a_group_ask_under_two_keys(spark, monkeypatch):
    """Each near copy met the leaders under every key it had, so a join's rows grew with members times keys times leaders."""
    import random

    r = random.Random(0)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(600):
        words = list(base)
        for _ in range(3):
            words[r.randrange(300)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    seen, salted = [], jaccard_join.salted

    def spy(many, one, on, *more):
        if "tops" not in one.columns and {"a", "ca"} <= set(one.columns):
            seen.append(many.groupBy("rep").count().agg(F.max("count")).first()[0])
        return salted(many, one, on, *more)

    monkeypatch.setattr(jaccard_join, "salted", spy)
    monkeypatch.setattr(jaccard_join, "PAIRS", 1000)
    monkeypatch.setattr(jaccard_join, "PAIRS_EACH", 0)
    got = {x["doc_id"]: x["component_id"] for x in jaccard_join.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert seen and max(seen) <= 2
    sets = [frozenset(zip(*(t.split()[k:] for k in range(3)), strict=False)) for _, t in rows]
    want = list(range(len(rows)))

    def root(i):
        while want[i] != i:
            i = want[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                want[b] = a
    assert got == {i: root(i) for i in range(len(rows))}
