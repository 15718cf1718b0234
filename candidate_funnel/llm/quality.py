"""Quality classifier: random-indexing word vectors, pooled, then a small network.

*Random indexing.* Every word form has a fixed sparse ternary index vector (its
non-zero places and signs come from the word's hash). The vector of a form is
the sum of the index vectors of its neighbours over the sample, so forms that
keep the same company are alike. Forms live in ``FORMS`` hashed rows, which
bounds the table. A text is read as its words, the shapes of its words
(capitals, digits, punctuation) and its line breaks.

*Pooling.* A document is the mean of its forms' vectors, with the length of the
mean (repetitive texts are long), the share of distinct words and of line
breaks, and the number of words.

*Network.* Two layers in numpy, trained by Adam on at most ``sample`` labelled
rows; the temperature that best calibrates its probabilities is fitted on a
fifth of the sample which the weights have not seen.

The sample bounds what the driver holds: ``PARTS`` tables of form vectors and
one vector per sampled row. Scoring moves no row between tasks.

Defined results: null and empty texts are a zero vector and get a score too;
without labels every score is 0.5; rows are scored on their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candidate_funnel.llm.common import Memo, labelled_sample, mix64, per_text, sigmoid

FORMS = 1 << 14
WIDTH = 48
NON_ZERO = 4
REACH = 2
PARTS = 8
SAMPLE = 8000
HIDDEN = 32
BREAK = b"\x00"


def shape(word: bytes) -> bytes:
    """The kinds of characters of a word, runs joined; its last punctuation as it is."""
    out = bytearray()
    for c in word[:24]:
        if 97 <= c <= 122 or c >= 128:
            kind = 120  # x
        elif 65 <= c <= 90:
            kind = 88  # X
        elif 48 <= c <= 57:
            kind = 57  # 9
        else:
            kind = c
        if not out or out[-1] != kind or kind not in (120, 88, 57):
            out.append(kind)
    return b"\x01" + bytes(out)


def form_rows(word: bytes) -> tuple[int, int]:
    """Hashed rows of a word and of its shape."""
    if word == BREAK:
        return 1, 1
    return (
        2 + xxhash.xxh3_64_intdigest(word) % (FORMS - 2),
        2 + xxhash.xxh3_64_intdigest(shape(word)) % (FORMS - 2),
    )


def index_vectors() -> np.ndarray:
    """The fixed sparse ternary vectors; row 0, which pads, is zero."""
    table = np.zeros((FORMS, WIDTH), dtype=np.float32)
    for k in range(NON_ZERO):
        h = mix64(np.arange(FORMS, dtype=np.uint64) * np.uint64(NON_ZERO) + np.uint64(k + 1))
        place = (h % np.uint64(WIDTH)).astype(int)
        sign = np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
        np.add.at(table, (np.arange(FORMS), place), sign.astype(np.float32))
    table[0] = 0
    return table


_MEMO = Memo(form_rows)


def read(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, 2) rows of forms of all texts, token counts, distinct words."""
    pairs, sizes, distinct = [], [], []
    for t in texts:
        words = t.replace(b"\n", b" \x00 ").split()
        sizes.append(len(words))
        distinct.append(len(set(words)))
        pairs += [_MEMO[w] for w in words]
    rows = np.array(pairs, dtype=np.int32).reshape(-1, 2)
    return rows, np.array(sizes), np.array(distinct)


def company(texts: list[bytes], index: np.ndarray) -> np.ndarray:
    """Sums of the neighbours' index vectors by form, over some texts."""
    total = np.zeros((FORMS, WIDTH), dtype=np.float32)
    rows, sizes, _ = read(texts)
    start = 0
    for size in sizes.tolist():
        r = rows[start : start + size]
        start += size
        for a in range(0, size, 1 << 15):
            lo, hi = max(0, a - REACH), min(size, a + (1 << 15) + REACH)
            v = index[r[lo:hi, 0]] + index[r[lo:hi, 1]]
            near = np.zeros_like(v)
            for k in range(1, REACH + 1):
                near[k:] += v[:-k]
                near[:-k] += v[k:]
            own = slice(a - lo, a - lo + min(1 << 15, size - a))
            for column in (0, 1):
                ids = r[lo:hi, column][own]
                order = np.argsort(ids, kind="stable")
                ids = ids[order]
                first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
                total[ids[first]] += np.add.reduceat(near[own][order], first, axis=0)
    return total


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """One row of features per text."""
    rows, sizes, distinct = read(texts)
    out = np.zeros((len(texts), 2 * WIDTH + 6), dtype=np.float32)
    start = 0
    for i, size in enumerate(sizes.tolist()):
        if size:
            r = rows[start : start + size]
            start += size
            for column in (0, 1):
                counts = np.bincount(r[:, column]) if size > 4 * FORMS else None
                if counts is not None:
                    mean = counts.astype(np.float32) @ vectors[: len(counts)] / size
                else:
                    mean = vectors[r[:, column]].mean(axis=0)
                out[i, column * WIDTH : (column + 1) * WIDTH] = mean
                out[i, 2 * WIDTH + column] = np.linalg.norm(mean)
            out[i, -4] = distinct[i] / size
            out[i, -3] = (r[:, 0] == 1).mean()
            out[i, -2] = np.log1p(size)
            out[i, -1] = distinct[i] / np.sqrt(size)
    return out


class Network:
    """Two layers; the logit is divided by ``temperature``."""

    def __init__(self, mean, scale, w1, b1, w2, b2, temperature):
        self.mean, self.scale = mean, scale
        self.w1, self.b1, self.w2, self.b2, self.temperature = w1, b1, w2, b2, temperature

    def logit(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(x) / self.temperature)


def train(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, rounds: int = 60) -> Network:
    """Adam on four fifths of the rows, temperature on the rest."""
    rng = np.random.default_rng(7)
    order = rng.permutation(len(x))
    x, y = x[order].astype(float), y[order].astype(float)
    held = np.arange(len(x)) % 5 == 0
    if len(x) < 50 or len(set(y[held])) < 2:
        held = np.zeros(len(x), dtype=bool)
    mean, scale = x[~held].mean(axis=0), x[~held].std(axis=0) + 1e-3
    z = np.clip((x - mean) / scale, -8, 8)
    w1 = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden))
    params = [w1, np.zeros(hidden), rng.normal(0, 0.1, hidden), np.zeros(())]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    zt, yt, step = z[~held], y[~held], 0
    for r in range(rounds):
        order = rng.permutation(len(zt))
        for a in range(0, len(order), 128):
            b, t = zt[order[a : a + 128]], yt[order[a : a + 128]]
            h = np.tanh(b @ params[0] + params[1])
            e = (sigmoid(h @ params[2] + params[3]) - t) / len(b)
            d = np.outer(e, params[2]) * (1 - h * h)
            grads = [b.T @ d + 1e-4 * params[0], d.sum(0), h.T @ e + 1e-4 * params[2], e.sum()]
            step += 1
            rate = 0.004 * (1 - r / rounds) + 1e-5
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] = params[i] - rate * (first[i] / (1 - 0.9**step)) / (
                    np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8
                )
    net = Network(mean, scale, *params, 1.0)
    if held.any():
        logit, t = net.logit(x[held]), y[held]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = [-np.mean(np.log(np.where(t > 0.5, sigmoid(logit / g), sigmoid(-logit / g)) + 1e-12)) for g in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, most: int = SAMPLE) -> tuple | None:
    """(vectors, network) from at most ``most`` labelled rows; None without labels."""
    sample = labelled_sample(docs, labels, "quality", allowed, most).select("_text", "label")
    sample = sample.repartition(PARTS)
    index = index_vectors()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FORMS, WIDTH), dtype=np.float32)
        for batch in batches:
            total += company([t.encode() for t in batch.column(0).to_pylist() if t], index)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    vectors = np.zeros((FORMS, WIDTH), dtype=np.float32)
    for row in sample.select("_text").mapInArrow(sums, "sums binary").collect():
        vectors += np.frombuffer(row["sums"], dtype=np.float32).reshape(FORMS, WIDTH)
    vectors = index * 0.5 + vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-6)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(texts: list[bytes]) -> list[pa.Array]:
        return [pa.array(pooled(texts, shared.value).tolist(), pa.list_(pa.float32()))]

    rows = per_text(sample, "_text", features, "x array<float>", ["label"]).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["label"], r["x"]))
    net = train(np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows]))
    return shared, net


def score(docs: DataFrame, model: tuple | None, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and the probability of label 1."""

    def work(texts: list[bytes]) -> list[pa.Array]:
        if model is None:
            return [pa.array([0.5] * len(texts), pa.float64())]
        shared, net = model
        # Rounded, as the last bits of a product depend on the batch around a row.
        return [pa.array(np.round(net.probability(pooled(texts, shared.value)), 9), pa.float64())]

    return per_text(docs, "text", work, "score double", keep)


def classify(docs: DataFrame, labels: DataFrame, held: Column, allowed: Column, at: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    scored = score(docs.select("doc_id", "text", held.alias("held_out")), fit(docs, labels, allowed), ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= at).cast("int"))
