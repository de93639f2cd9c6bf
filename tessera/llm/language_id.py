"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a segment (a word, however long) byte by byte in both directions and gives every position probabilities of the
languages; a document's probabilities are the mean over all positions of its whole text. Segments are read on their own, so a segment's
result is the same wherever it stands, and tasks keep results of segments in a memo of bounded size. Training is backpropagation through
time in numpy, on the driver: from the whole texts of about SAMPLE documents of each language outside the held-out fold, whose words are
counted in Spark. The driver gets at most WORDS of them, and draws SEGMENTS for each pass of the training; backpropagation is truncated
after TRUNCATED bytes.

Defined results: null texts and texts without a letter are `und` with score 0; so is every text if no document can be learned from.
Null ids and repeated rows pass through, one output row per input row. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, table

#: Documents of each language in the training sample, distinct words of them that the driver gets at most, and segments drawn from those.
SAMPLE, WORDS, SEGMENTS = 400, 200_000, 24_000
#: Units in each direction, embedding size, bytes through which training goes back, bytes of a segment whose states are held at once.
HIDDEN, EMBED, TRUNCATED, HELD = 24, 16, 64, 4096
#: Segments in the memo, and the longest that it takes.
MEMO, MEMO_BYTES = 400_000, 256
#: ASCII punctuation and digits carry no language; they part segments like white space.
PARTS = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))


def segments(text: str) -> list[bytes]:
    return text.lower().encode().translate(PARTS).split()


def pieces(word: bytes) -> list[bytes]:
    """A word in parts of at most TRUNCATED bytes, none of which ends within a character."""
    out, at = [], 0
    while at < len(word):
        end = min(len(word), at + TRUNCATED)
        while end < len(word) and word[end] & 0xC0 == 0x80:
            end -= 1
        out.append(word[at:end])
        at = end
    return out


def padded(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes + 1 with 0 as padding, in both reading orders."""
    x = np.zeros((len(found), max(map(len, found))), np.int64)
    y = np.zeros_like(x)
    for i, w in enumerate(found):
        x[i, : len(w)] = np.frombuffer(w, np.uint8) + 1
        y[i, : len(w)] = x[i, : len(w)][::-1]
    return x, y


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Direction:
    """One reading direction: embedding, gates z and r, candidate."""

    def __init__(self, rng, h: int = HIDDEN, e: int = EMBED):
        self.p = {"E": rng.normal(0, 0.3, (257, e)), "W": rng.normal(0, e**-0.5, (e, 3 * h)), "U": rng.normal(0, h**-0.5, (h, 2 * h)), "V": rng.normal(0, h**-0.5, (h, h)), "b": np.zeros(3 * h)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        p, h = self.p, self.p["V"].shape[0]
        given = (p["E"] @ p["W"] + p["b"])[x]
        s, states, kept = np.zeros((len(x), h), np.float32), np.zeros((len(x), x.shape[1], h), np.float32), []
        for t in range(x.shape[1]):
            g = sigmoid(given[:, t, : 2 * h] + s @ p["U"])
            z, r = g[:, :h], g[:, h:]
            c = np.tanh(given[:, t, 2 * h :] + (r * s) @ p["V"])
            new = z * s + (1 - z) * c
            kept.append((s, z, r, c))
            s = new
            states[:, t] = s
        return states, kept

    def given(self) -> np.ndarray:
        return self.p["E"] @ self.p["W"] + self.p["b"]

    def step(self, given: np.ndarray, s: np.ndarray) -> np.ndarray:
        h = s.shape[1]
        g = sigmoid(given[:, : 2 * h] + s @ self.p["U"])
        return g[:, :h] * s + (1 - g[:, :h]) * np.tanh(given[:, 2 * h :] + (g[:, h:] * s) @ self.p["V"])

    def backward(self, x: np.ndarray, kept: list, above: np.ndarray) -> dict:
        p, h = self.p, self.p["V"].shape[0]
        d = {k: np.zeros_like(v) for k, v in p.items()}
        into, ds = np.zeros((*x.shape, 3 * h), np.float32), np.zeros((len(x), h), np.float32)
        for t in range(x.shape[1] - 1, -1, -1):
            s, z, r, c = kept[t]
            ds = ds + above[:, t]
            dc = ds * (1 - z) * (1 - c * c)
            drs = dc @ p["V"].T
            dg = np.concatenate([ds * (s - c) * z * (1 - z), drs * s * r * (1 - r)], 1)
            d["V"] += (r * s).T @ dc
            d["U"] += s.T @ dg
            into[:, t] = np.concatenate([dg, dc], 1)
            ds = ds * z + drs * r + dg @ p["U"].T
        flat, given = x.ravel(), into.reshape(-1, 3 * h)
        d["b"] = given.sum(0)
        d["W"] = p["E"][flat].T @ given
        np.add.at(d["E"], flat, given @ p["W"].T)
        return d


class Network:
    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs, self.ways = langs, (Direction(rng), Direction(rng))
        self.out = {"O": rng.normal(0, 0.2, (2 * HIDDEN, len(langs))).astype(np.float32), "o": np.zeros(len(langs), np.float32)}

    def positions(self, found: list[bytes]):
        x, y = padded(found)
        (f, keep_f), (b, keep_b) = self.ways[0].forward(x), self.ways[1].forward(y)
        n = (x > 0).sum(1)
        back = np.clip(n[:, None] - 1 - np.arange(x.shape[1]), 0, None)  # place t was read at step n - 1 - t
        h = np.concatenate([f, np.take_along_axis(b, back[:, :, None], 1)], 2)
        logits = h @ self.out["O"] + self.out["o"]
        e = np.exp(logits - logits.max(2, keepdims=True))
        return x, y, n, back, h, e / e.sum(2, keepdims=True), keep_f, keep_b

    def label(self, text: str) -> list[tuple[bytes, np.ndarray]]:
        """Each segment of a text with the probabilities at its positions."""
        found = segments(text)
        if not found:
            return []
        p = self.positions(found)[5]
        return [(w, p[i, : len(w)]) for i, w in enumerate(found)]

    def pooled(self, found: list[bytes]) -> np.ndarray:
        """Per segment the sum of its positions' probabilities."""
        out = np.zeros((len(found), len(self.langs)), np.float32)
        order, at = sorted(range(len(found)), key=lambda i: len(found[i])), 0
        while at < len(order):
            end = at + 1
            while end < len(order) and end - at < 2048 and (end - at) * len(found[order[end]]) < 1 << 18:
                end += 1
            out[order[at:end]] = self.sums([found[i] for i in order[at:end]])
            at = end
        return out

    def sums(self, found: list[bytes]) -> np.ndarray:
        """The same for segments of like length. The right-to-left states are made first, and kept where a block of HELD bytes ends; each
        block then makes them again while it is read from the left, so that a segment of any length takes bounded memory."""
        x, _ = padded(found)
        n, (b, t), (left, right) = (x > 0).sum(1), x.shape, self.ways
        given_l, given_r, kept = left.given(), right.given(), {}

        def back(i: int, s: np.ndarray) -> np.ndarray:
            return np.where((i < n)[:, None], right.step(given_r[x[:, i]], s), 0)

        s = np.zeros((b, HIDDEN), np.float32)
        for i in range(t - 1, -1, -1):
            if (i + 1) % HELD == 0 or i == t - 1:
                kept[i // HELD] = s
            if i < HELD:
                break
            s = back(i, s)
        out, f = np.zeros((b, len(self.langs)), np.float32), np.zeros((b, HIDDEN), np.float32)
        for block in range(-(-t // HELD)):
            first, s = block * HELD, kept[block]
            states = np.zeros((min(t - first, HELD), b, 2 * HIDDEN), np.float32)
            for i in range(len(states) - 1, -1, -1):
                states[i, :, HIDDEN:] = s = back(first + i, s)
            for i in range(len(states)):
                states[i, :, :HIDDEN] = f = left.step(given_l[x[:, first + i]], f)
            logits = states @ self.out["O"] + self.out["o"]
            e = np.exp(logits - logits.max(2, keepdims=True))
            on = (np.arange(first, first + len(states))[:, None] < n)[:, :, None]
            out += (e / e.sum(2, keepdims=True) * on).sum(0)
        return out

    def train(self, found: list[bytes], langs: np.ndarray, epochs: int = 6, size: int = 256, rate: float = 0.01) -> None:
        """Adam on the cross entropy of every position."""
        rng = np.random.default_rng(11)
        groups = [self.ways[0].p, self.ways[1].p, self.out]
        m = [{k: np.zeros_like(v) for k, v in g.items()} for g in groups]
        v = [{k: np.zeros_like(x) for k, x in g.items()} for g in groups]
        step, total = 0, epochs * -(-len(found) // size)
        for _ in range(epochs):
            order = rng.permutation(len(found))
            for at in range(0, len(order), size):
                some = order[at : at + size]
                x, y, n, back, h, p, keep_f, keep_b = self.positions([found[i] for i in some])
                d = p.copy()
                d[np.arange(len(some))[:, None], np.arange(x.shape[1])[None, :], langs[some][:, None]] -= 1
                d *= (x > 0)[:, :, None] / max(1, n.sum())
                dh = d @ self.out["O"].T
                up_b = np.zeros_like(dh[:, :, HIDDEN:])
                np.add.at(up_b, (np.arange(len(some))[:, None], back), dh[:, :, HIDDEN:] * (x > 0)[:, :, None])
                grads = [self.ways[0].backward(x, keep_f, dh[:, :, :HIDDEN]), self.ways[1].backward(y, keep_b, up_b), {"O": np.einsum("bth,btl->hl", h, d), "o": d.sum((0, 1))}]
                step += 1
                now = rate * (1 - step / (total + 1))
                for g, q, a, b in zip(groups, grads, m, v, strict=True):
                    for k in g:
                        a[k] += 0.1 * (q[k] - a[k])
                        b[k] += 0.01 * (q[k] ** 2 - b[k])
                        g[k] -= (now * (a[k] / (1 - 0.9**step)) / (np.sqrt(b[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


def learn(documents: DataFrame) -> Network | None:
    """A network from about SAMPLE documents of each language outside the held-out fold. The sample follows from ids and texts."""
    docs = documents.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), F.col("text").alias("_text"))
    known = docs.where(~held_out(F.col("_id")) & F.col("_lang").isNotNull() & F.col("_text").isNotNull())
    part = known.groupBy("_lang").agg(F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.count("*")).alias("_part"))
    drawn = known.join(part, "_lang").where(F.pmod(F.xxhash64("_id", "_text", F.lit("lang")), F.lit(1 << 20)) < F.col("_part") * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                seen = Counter(p for w in segments(text.as_py()) for p in pieces(w))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["lang", "w", "n"])

    counts = drawn.select("_lang", "_text").mapInArrow(count, "lang string, w binary, n long").groupBy("lang", "w").agg(F.sum("n").alias("n"))
    # Where there are more words than the driver takes, frequent ones are likelier to be among them.
    chance = -F.log((F.pmod(F.xxhash64("lang", "w"), F.lit(1 << 30)) + 1) / float(1 << 30)) / F.sqrt("n")
    rows = sorted((r["w"], r["lang"], r["n"]) for r in counts.orderBy(chance, "lang", "w").limit(WORDS).collect())
    if not rows:
        return None
    langs = sorted({lang for _, lang, _ in rows})
    place = np.array([langs.index(lang) for _, lang, _ in rows])
    share = np.sqrt([n for *_, n in rows])  # frequent words count, but not all at once
    share /= np.bincount(place, weights=share)[place]
    drawn_ = np.random.default_rng(3).choice(len(rows), SEGMENTS, p=share / share.sum())
    net = Network(langs)
    net.train([bytes(rows[i][0]) for i in drawn_], place[drawn_])
    return net


def identify(documents: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score per row of documents. The network is broadcast; its size is fixed."""
    shared = documents.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, memo = shared.value, {}
        sums = np.zeros((0, len(net.langs) if net else 1), np.float32)
        for batch in batches:
            texts, at = batch.column(2).to_pylist(), 0
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            while net and at < len(texts):
                chunk, size = [], 0
                while at < len(texts) and size < 1 << 21:
                    t = texts[at]
                    if t and any(map(str.isalpha, t)):
                        chunk.append((at, segments(t)))
                        size += len(t)
                    at += 1
                if len(sums) > MEMO:
                    memo, sums = {}, sums[:0]
                fresh = list(dict.fromkeys(w for _, ws in chunk for w in ws if w not in memo))
                if fresh:
                    memo.update(zip(fresh, range(len(sums), len(sums) + len(fresh)), strict=True))
                    sums = np.concatenate([sums, net.pooled(fresh)])
                for i, ws in chunk:
                    if ws:
                        p = sums[np.fromiter(map(memo.__getitem__, ws), np.int64, len(ws))].sum(0, dtype=np.float64)
                        best = int(p.argmax())
                        langs[i], scores[i] = net.langs[best], float(p[best] / p.sum())
                for w in [w for w in fresh if len(w) > MEMO_BYTES]:  # long words hardly come again
                    del memo[w]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op2_gru_language_id(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return identify(documents, learn(documents))


QUERIES = {"op2_gru_language_id": op2_gru_language_id}
SQL: dict[str, str] = {}
