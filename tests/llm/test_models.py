"""Neighbour search, language identification, toxicity, and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import language_id, neighbours, toxicity

out_of_fold = lambda i: zlib.crc32(str(i).encode()) % 3 == 1


# --- neighbours


def brute_nearest(x, ids, q):
    s = x @ x[q]
    order = sorted((i for i in range(len(ids)) if ids[i] != ids[q]), key=lambda i: (-s[i], ids[i]))[:20]
    return [(ids[i], s[i]) for i in order]


def vectors(n, seed=0, scale=True):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16)) + 2 * rng.normal(size=(8, 16))[rng.integers(0, 8, n)]
    return x * rng.uniform(0.2, 3, (n, 1)) if scale else x


def test_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 700)
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    x = vectors(2000)
    x[50:900] = x[50]  # a hot vector
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids, hit = list(range(2000)), 0
    assert set(got) == set(range(0, 2000, 20))
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        assert all(a[2] > b[2] or a[2] == b[2] and a[1] < b[1] for a, b in zip(found, found[1:], strict=False))
        want = brute_nearest(x, ids, q)
        assert all(f[2] == pytest.approx(x[f[1]] @ x[q]) for f in found)
        hit += sum(f[2] >= want[-1][1] - 1e-9 for f in found)
    assert hit / (20 * len(got)) >= 0.9


def test_odd_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (8, []), (None, [1.0, 1.0]), (1, [1.0, 1.0]), (40, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, v int")
    got = [tuple(r)[:4] for r in neighbours.nearest(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 1, 1.0), (0, 3, 20, 0.0), (20, 1, 1, 1.0), (20, 2, 1, 1.0), (20, 3, 0, 0.0)]
    assert neighbours.nearest(df.where("false"), df.where("false")).count() == 0


def test_each_query_row_leaves_out_itself_alone(spark):
    """Repeated query rows, other rows of a query's id, and vectors whose squares overflow."""
    x = vectors(60, seed=3)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [rows[20], rows[20], (40, rows[5][1]), (7, [v * 1e160 for v in rows[7][1]]), (80, [v * -1e160 for v in rows[9][1]]), (8, [v * 1e-170 for v in rows[8][1]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = []
    with np.errstate(over="ignore"):
        for n, (i, v) in enumerate(rows):
            if i % 20 == 0:
                near = sorted((-float(np.array(y) @ np.array(v)), j) for m, (j, y) in enumerate(rows) if m != n)[:20]
                want += [(i, rank, j, -s) for rank, (s, j) in enumerate(near, 1)]
    got = [tuple(r)[:4] for r in neighbours.nearest(df, df.where("vec_id % 20 = 0")).collect()]
    key = lambda r: (r[0], r[1], r[2])
    assert [key(r) for r in sorted(got)] == [key(r) for r in sorted(want)]
    assert all(a[3] == pytest.approx(b[3]) for a, b in zip(sorted(got), sorted(want), strict=True))


def test_clusters_visit_few_boxes(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 150)
    rng = np.random.default_rng(1)
    x = 30 * rng.normal(size=(40, 16))[np.arange(2400) % 40] + rng.normal(size=(2400, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, df.where("vec_id % 20 = 0")).collect()
    hit = sum(r["score"] >= np.sort(np.delete(x @ x[r["query_id"]], r["query_id"]))[-20] - 1e-9 for r in got)
    assert len(got) == 20 * 120 and hit / len(got) >= 0.9
    assert np.mean([r["n_verified"] for r in got]) < 0.25 * 2400


# --- language


def corpus(n=240):
    rng = random.Random(3)
    parts = {"en": ["the", "th", "ing", "and", "er", "wh", "ly"], "fr": ["le", "que", "é", "eau", "ment", "oi", "aux"], "de": ["der", "ung", "sch", "ei", "ä", "ch", "ß"]}
    out = []
    for i in range(n):
        lang = rng.choice(list(parts))
        out.append((i, " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(60)), lang))
    return out


def test_language_accuracy_on_the_held_out_fold(spark):
    data = corpus()
    extra = [(1000, None, "en"), (1001, "", "fr"), (1002, "12 34 !", "de"), (None, data[0][1], None), (1003, data[1][1], None)]
    df = spark.createDataFrame([(*r, 0.5) for r in data + extra], "doc_id long, text string, lang string, score double")
    net = language_id.learn(df)
    got = language_id.identify(df, net).collect()
    assert len(got) == len(data) + 5
    true = {i: lang for i, _, lang in data}
    held = [r for r in got if r["held_out"]]
    assert held and all(out_of_fold(r["doc_id"]) for r in held)
    assert sum(r["lang_pred"] == true.get(r["doc_id"]) for r in held if r["doc_id"] in true) / sum(r["doc_id"] in true for r in held) > 0.95
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in got if r["doc_id"] in (1000, 1001, 1002))
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language_id.learn(df.where("false")) is None
    assert [r["lang_pred"] for r in language_id.identify(df.limit(2), None).collect()] == ["und", "und"]


def test_pooled_sums_are_those_of_all_positions(monkeypatch):
    monkeypatch.setattr(language_id, "HELD", 7)
    net, rng = language_id.Network(["a", "b", "c"], seed=2), random.Random(2)
    found = [bytes(rng.randrange(97, 200) for _ in range(n)) for n in (1, 2, 6, 7, 8, 13, 14, 15, 50, 50, 51)]
    p = net.positions(found)[5]
    assert np.allclose(net.pooled(found), [p[i, : len(w)].sum(0) for i, w in enumerate(found)], atol=1e-4)
    word = "日本語é".encode() * 40
    assert b"".join(language_id.pieces(word)) == word and all(x.decode() and len(x) <= language_id.TRUNCATED for x in language_id.pieces(word))


def test_long_texts_and_empty_tables(spark):
    """One word of 60,000 bytes, many words, and tables without rows, with columns whose names clash."""
    data = corpus(120)
    long = [(900, "der" * 20_000, "de"), (903, "que eau " * 30_000, "fr")]
    df = spark.createDataFrame([(*r, "x", 1, 0.5) for r in data + long], "doc_id long, text string, lang string, _id string, toxic int, score double")
    net = language_id.learn(df)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(df, net).collect()}
    assert got[900] == "de" and got[903] == "fr"
    none = df.where("false")
    assert language_id.learn(none) is None and language_id.identify(none, net).count() == 0
    labels = spark.createDataFrame([(i, int(i % 3 == 0), "t") for i, *_ in data], "doc_id long, toxic int, text string")
    bad = df.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.repeat(F.lit("fine words here "), 4000), F.lit("vilefoo nastyqux"))).otherwise(F.col("text")))
    field = toxicity.learn(bad, labels)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(bad, field).collect()}
    assert np.mean([(scores[i] > 0.5) == (i % 3 == 0) for i, *_ in data]) > 0.95  # the passage lies behind 60,000 characters
    assert toxicity.score(none, field).count() == 0 and toxicity.learn(none, labels) is None


def test_gradient_of_the_network():
    net = language_id.Network(["a", "b"], seed=1)
    for way in net.ways:
        way.p = {k: v.astype(np.float64) for k, v in way.p.items()}
    way, rng = net.ways[0], np.random.default_rng(0)
    x = rng.integers(1, 257, (3, 5))
    above = rng.normal(size=(3, 5, language_id.HIDDEN))
    loss = lambda: float((way.forward(x)[0] * above).sum())
    grads = way.backward(x, way.forward(x)[1], above)
    for name in ("W", "U", "V", "b"):
        flat = way.p[name].reshape(-1)
        for k in rng.integers(0, flat.size, 4):
            old = flat[k]
            flat[k] = old + 1e-3
            up = loss()
            flat[k] = old - 1e-3
            down = loss()
            flat[k] = old
            assert (up - down) / 2e-3 == pytest.approx(grads[name].reshape(-1)[k], rel=2e-2, abs=2e-3)


# --- toxicity


def test_marginals_against_enumeration():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5):
        e, trans, start = rng.normal(size=(1, n)) * 2, rng.normal(size=(2, 2)), rng.normal(size=2)
        weights, toxic = 0.0, np.zeros(n)
        for k in range(2**n):
            y = [(k >> i) & 1 for i in range(n)]
            s = start[y[0]] + sum(e[0, i] for i in range(n) if y[i]) + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False))
            weights += np.exp(s)
            toxic += np.exp(s) * np.array(y)
        m, _, z = toxicity.forward_backward(e, np.array([n]), trans, start)
        assert np.allclose(m[0], toxic / weights) and np.isclose(z[0], np.log(weights))
        assert np.allclose(toxicity.marginals(e, np.array([n]), trans, start)[0], toxic / weights)


def test_toxicity_on_the_held_out_fold(spark):
    rng, bad = random.Random(5), ["vilefoo", "vilebar", "nastyqux"]
    docs, labels = [], []
    for i in range(500):
        w = corpus(1)[0][1].split() * 2
        rng.shuffle(w)
        toxic = rng.random() < 0.3
        for _ in range(rng.randint(2, 6) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        docs.append((i, " ".join(w[:40]) + "\n" + " ".join(w[40:])))
        labels.append((i, int(toxic)))
    odd = [(1000, None), (1001, ""), (None, "vilefoo vilebar"), (1002, "...")]
    d = spark.createDataFrame([(*r, "x") for r in docs + odd], "doc_id long, text string, predicted string")
    lab = spark.createDataFrame([*labels, (1000, 1), (None, 1), (3000, None)], "doc_id long, toxic int")
    field = toxicity.learn(d, lab)
    got = toxicity.score(d, field, spans=True).collect()
    assert len(got) == len(docs) + 4 and all(0 <= r["score"] <= 1 for r in got)
    truth, held = dict(labels), [r for r in got if r["held_out"] and r["doc_id"] in dict(labels)]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    text = dict(docs)
    for r in held:
        if truth[r["doc_id"]]:
            found = {text[r["doc_id"]].lower()[s["start"] : s["end"]] for s in r["spans"]}
            assert any(w in x for x in found for w in bad)
    assert all(r["predicted"] == 0 for r in got if r["doc_id"] in (1000, 1001, 1002))
    assert toxicity.learn(d, lab.where("false")) is None
    assert {r["score"] for r in toxicity.score(d, None).collect()} == {0.0}


# --- pipeline


def test_pipeline_stages(spark, docs, empty):
    import corpus_pipeline as p

    kept = docs
    for k, (_, stage) in enumerate(p.STAGES):
        kept = stage(spark, kept, "")
        if k < 4:
            assert kept.columns == docs.columns
        kept = p.stored(kept)
    assert kept.count() > 0
    nothing = empty
    for _, stage in p.STAGES:
        nothing = p.stored(stage(spark, nothing, ""))
    assert nothing.count() == 0
