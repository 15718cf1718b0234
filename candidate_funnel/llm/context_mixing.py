"""Language-model scoring by online logistic mixing of hashed contexts.

A text (A-Z in lower case, one end symbol) is coded bit by bit. Bytes are split
into bits by Huffman trees of the corpus, one for each byte before, so what often
follows that byte takes few bits.

*Predictors.* For each context in ``CONTEXTS`` (the bytes before, or the letters
of the word so far and the space before them) a table of ``1 << TABLE_BITS``
hashed slots holds how often the bit at a tree node was 0 or 1 there. All training
texts are counted; the statistics are frozen for scoring. A slot's prediction is
the logit of its frequency, near zero where little was seen.

*Mixer.* Predictions are summed under weights chosen by a gate (whether the
longest context of bytes is known), and squashed.

*Refinement.* A map from the mixer's output to what followed it in this text is
averaged in. Weights and map start alike for every text and adapt online after 32,
64, 128, ... bytes and then after every ``SEGMENT``: what is used to code a segment
comes from earlier ones. Bits of many texts are coded together, segment by segment.

*Unigram base.* Beside it, every text is scored by training counts of its
words. The frequent words' counts (``HOT_WORDS``, a bounded table) are looked up
in the task; the rest are joined with the distributed vocabulary, which grows
with the corpus.

Defined results: null is the empty text, one end symbol long; scores do not
depend on other rows of a batch; equal texts have equal scores; with nothing to
learn from, all bits cost one and the base has N = V = 0.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candidate_funnel.llm.common import mix64, parts_of, per_text
from candidate_funnel.session import cut

# Bytes before that a context covers; 0 is the word so far.
CONTEXTS = (3, 5, 0)
TABLE_BITS = (22, 22, 23)
# Rows of a table that are merged and sent as one.
SLICE = 1 << 16
END = 255
BACK = max(CONTEXTS)
SEGMENT = 512
SCALE = 16
# Levels of a tree whose nodes lie together, and the places they are dealt over.
DEEP = 4
GAP = 1 << 18
# What every bit has been seen before anything is.
PRIOR = 0.1
# Starting weights by gate, unknown and known longest context, for each predictor.
WEIGHTS = ((0.6, 0.05, 0.4), (0.3, 0.6, 0.3))
RATE = 0.6
MAP = 24
MAP_PRIOR = 30.0
HOT_WORDS = 100_000
# Bytes of texts that are coded together.
TOGETHER = 96 << 10
# Bytes of texts that are counted together.
COUNT_BYTES = 512 << 10


def huffman(counts: list[int]) -> list[list[tuple[int, int]]]:
    """For 256 counts each byte's path of (node, bit); nodes are 1 to 255, the root is 1."""
    heap = [(c + 1, i, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    children = {}
    tag = 256
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        children[tag] = (a[2], b[2])
        heapq.heappush(heap, (a[0] + b[0], tag, tag))
        tag += 1
    paths: list = [None] * 256
    stack = [(heap[0][2], [])]
    number = {}
    while stack:
        at, path = stack.pop()
        if at < 256:
            paths[at] = path
            continue
        number[at] = len(number) + 1
        for bit, child in enumerate(children[at]):
            stack.append((child, [*path, (number[at], bit)]))
    return paths


def trees(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For counts of (byte before, byte), 256 by 256: first entry and length of each
    pair's path, and the flat paths' places and bits.

    A place is added to the hash of a context. The nodes of a subtree of ``DEEP``
    levels have places in a row, so that a byte's bits are read close together.
    """
    length, places, bits = [], [], []
    group = mix64(np.arange(256 * 256, dtype=np.uint64)) % np.uint64(GAP - (1 << DEEP))
    group = group.astype(np.int64).tolist()
    for before, row in enumerate(counts.tolist()):
        for path in huffman(row):
            length.append(len(path))
            for depth, (node, bit) in enumerate(path):
                if depth % DEEP == 0:
                    start, at = group[before * 256 + node], 1
                places.append(start + at)
                bits.append(bit)
                at = 2 * at + bit
    n = np.array(length, dtype=np.int64)
    return np.cumsum(n) - n, n, np.array(places, dtype=np.int64), np.array(bits, dtype=np.int8)


_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """Powers 0 to n - 1 modulo 2^64."""
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


_UP, _DOWN = powers(_ODD, 2 * TOGETHER), powers(_INVERSE, 2 * TOGETHER)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13, END]] = True
SLOTS = [(1 << b) + GAP for b in TABLE_BITS]
OFFSET = [sum(SLOTS[:k]) for k in range(len(SLOTS))]


def scatter(x: np.ndarray, bits: int) -> np.ndarray:
    """Hashes of some bits, in place of ``x``."""
    x *= np.uint64(_ODD)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x >>= np.uint64(64 - bits)
    return x.view(np.int64)


class Bytes:
    """Symbols of some texts, as pairs with the byte before, and their contexts' hashes."""

    def __init__(self, texts: list[bytes]):
        pad = bytes([END]) * BACK
        whole = np.frombuffer(b"".join(pad + t.lower() + pad[:1] for t in texts), dtype=np.uint8)
        self.sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        ends = np.cumsum(self.sizes + BACK)
        keep = np.ones(len(whole), dtype=bool)
        for e in (ends - self.sizes - BACK).tolist():
            keep[e : e + BACK] = False
        wide = whole.astype(np.uint64)
        run = np.zeros(len(whole), dtype=np.uint64)
        for j in range(1, BACK + 1):
            run[j:] |= wide[:-j] << np.uint64(8 * (j - 1))
        run = run[keep]
        self.hashes = []
        for back, bits in zip(CONTEXTS, TABLE_BITS, strict=True):
            own = run & np.uint64((1 << 8 * back) - 1) if back else self.words(whole, wide)[keep]
            self.hashes.append(scatter(own, bits))
        self.symbols = whole[keep].astype(np.int64)
        self.pairs = (run & np.uint64(255)).view(np.int64) << 8 | self.symbols
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)

    @staticmethod
    def words(whole: np.ndarray, wide: np.ndarray) -> np.ndarray:
        """Hash of the bytes from the last space on, by prefix sums modulo 2^64."""
        n = len(whole)
        up, down = (p[:n] if n <= len(p) else powers(p[1], n) for p in (_UP, _DOWN))
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((wide + np.uint64(1)) * up, out=total[1:])
        begin = np.zeros(n, dtype=np.int64)
        begin[1:] = np.where(_SPACE[whole[:-1]], np.arange(n - 1), 0)
        np.maximum.accumulate(begin, out=begin)
        return (total[:n] - total[begin]) * down[begin]


def spread(code: tuple, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits of pairs: which pair, which place, which bit."""
    first, length, places, bits = code
    n = length[pairs]
    which = np.repeat(np.arange(len(pairs)), n)
    at = np.arange(len(which)) + (first[pairs] - np.cumsum(n) + n).take(which)
    return which, places.take(at), bits.take(at)


def counted(code: tuple):
    """Task function: sparse sums of (table, slice, places, counts) over its texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(2 * n, dtype=np.int32) for n in SLOTS]

        def add(held: list[list[np.ndarray]]) -> None:
            for k in range(len(CONTEXTS)):
                # Each (context, byte) that occurs becomes bits once, with its count.
                key = np.concatenate([keys[k] for keys in held])
                key.sort()
                new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                times = np.diff(np.r_[new, len(key)]).astype(np.int32)
                key = key[new]
                which, place, bit = spread(code, key & 0xFFFF)
                place += (key >> 16).take(which)
                place *= 2
                place += bit
                np.add.at(total[k], place, times.take(which))

        held, size = [], 0
        for texts in parts_of(batches, TOGETHER):
            b = Bytes(texts)
            held.append([h << 16 | b.pairs for h in b.hashes])
            size += len(b.pairs)
            if size > COUNT_BYTES:
                add(held)
                held, size = [], 0
        if held:
            add(held)
        for k in range(len(CONTEXTS)):
            rows = []
            for s in range(0, len(total[k]), SLICE):
                part = total[k][s : s + SLICE]
                place = np.flatnonzero(part)
                if len(place):
                    rows.append((s // SLICE, place.astype(np.uint16).tobytes(), part[place].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k] * len(rows), pa.int32()),
                        pa.array([r[0] for r in rows], pa.int32()),
                        pa.array([r[1] for r in rows], pa.binary()),
                        pa.array([r[2] for r in rows], pa.binary()),
                    ],
                    names=["table", "slice", "places", "counts"],
                )

    return work


def fixed(value: np.ndarray) -> np.ndarray:
    """Logits in steps of 1 / ``SCALE``, a byte each; the mixer's sum has the same limits."""
    return np.clip(np.round(value * SCALE), -127, 127).astype(np.int8)


def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the parts of each (table, slice), sorted, into logits."""
    held, total = None, None

    def done():
        pair = total.reshape(-1, 2).astype(np.float64)
        value = fixed(np.log((pair[:, 1] + PRIOR) / (pair[:, 0] + PRIOR)))
        return pa.RecordBatch.from_arrays(
            [pa.array([held[0]], pa.int32()), pa.array([held[1]], pa.int32()), pa.array([value.tobytes()], pa.binary())],
            names=["table", "slice", "values"],
        )

    for batch in batches:
        for table, part, places, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held != (table, part):
                if held is not None:
                    yield done()
                held, total = (table, part), np.zeros(SLICE, dtype=np.int64)
            total[np.frombuffer(places, dtype=np.uint16)] += np.frombuffer(counts, dtype=np.int32)
    if held is not None:
        yield done()


def tables(texts: DataFrame, code: tuple) -> np.ndarray:
    """Logits of all tables one after the other, from all rows of ``texts`` (one column).

    The result's size is fixed by ``TABLE_BITS``; it is all the driver sees.
    """
    parts = texts.mapInArrow(counted(code), "table int, slice int, places binary, counts binary")
    merged = (
        parts.repartition("table", "slice")
        .sortWithinPartitions("table", "slice")
        .mapInArrow(logits, "table int, slice int, values binary")
    )
    out = np.zeros(sum(SLOTS), dtype=np.int8)
    half = SLICE // 2
    for r in merged.toLocalIterator():
        start = OFFSET[r["table"]] + r["slice"] * half
        out[start : start + half] = np.frombuffer(r["values"], dtype=np.int8)
    return out


def segments(size: int) -> Iterator[tuple[int, int]]:
    """(start, length): 32 bytes, then as many as came before, ``SEGMENT`` at most."""
    start = 0
    while start < size:
        yield start, min(max(start, 32), SEGMENT)
        start += min(max(start, 32), SEGMENT)


def bits_of(texts: list[bytes], code: tuple, logit: np.ndarray) -> np.ndarray:
    """Code length of each text in bits, by the mixer and the map."""
    b = Bytes(texts)
    n, k_all = len(texts), len(CONTEXTS)
    out = np.zeros(n)
    first, length, places, bits = code
    for k in range(k_all):
        b.hashes[k] += OFFSET[k]
    gates = 2
    weights = np.empty((k_all, n * gates), dtype=np.float32)
    for k in range(k_all):
        weights[k] = np.tile([WEIGHTS[0][k], WEIGHTS[1][k]], n)
    middle = 1 / (1 + np.exp(-(np.arange(MAP) - MAP / 2 + 0.5) / 1.5))
    seen = np.full(n * MAP, MAP_PRIOR)
    ones = np.tile(middle * MAP_PRIOR, n)
    for r, most in segments(int(b.sizes.max())):
        texts_on = np.flatnonzero(b.sizes > r)
        span = np.minimum(b.sizes[texts_on] - r, most)
        first_bytes = np.cumsum(span) - span
        owner = np.repeat(texts_on, span)
        at = np.arange(len(owner)) + np.repeat(b.starts[texts_on] + r - first_bytes, span)
        # What holds for a byte is repeated for each of its bits.
        pair = b.pairs.take(at)
        times = length.take(pair)
        ends = np.cumsum(times)
        which = np.repeat(np.arange(len(at)), times)
        path = np.arange(ends[-1])
        path += (first.take(pair) - ends + times).take(which)
        place, taken = places.take(path), bits.take(path)
        bit = taken.astype(np.float32)
        s = []
        for k in range(k_all):
            path = b.hashes[k].take(at).take(which)
            path += place
            s.append(logit.take(path).astype(np.float32))
        known = s[1] != 0
        gate = (owner * gates).take(which)
        gate += known
        z = weights[0].take(gate)
        z *= s[0]
        for k in range(1, k_all):
            z += weights[k].take(gate) * s[k]
        z *= 1 / SCALE
        np.clip(z, -7.9, 7.9, out=z)
        p = np.exp(-z)
        p += 1
        np.reciprocal(p, out=p)
        cell = (owner * MAP).take(which)
        z *= 1.5
        z += MAP / 2
        cell += z.astype(np.int64)
        refined = (ones / seen).astype(np.float32).take(cell)
        refined *= 0.4
        refined += 0.6 * p
        # The chance of what came: refined for a 1, the rest for a 0.
        right = np.abs(1 - bit - refined)
        np.log2(right, out=right)
        starts = (ends - times)[first_bytes]
        out[texts_on] -= np.add.reduceat(right, starts, dtype=np.float64)
        # What this segment teaches is for the next one.
        error = bit - p
        if_known = known.astype(np.float32)
        known_error = error * if_known
        every = np.diff(starts, append=len(bit))
        of_known = np.add.reduceat(if_known, starts).astype(np.float64)
        rates = [RATE / SCALE / np.sqrt(np.maximum(m, 1) * (m + 400.0)) for m in (every - of_known, of_known)]
        for k in range(k_all):
            whole = np.add.reduceat(error * s[k], starts)
            part = np.add.reduceat(known_error * s[k], starts)
            weights[k][texts_on * gates] += ((whole - part) * rates[0]).astype(np.float32)
            weights[k][texts_on * gates + 1] += (part * rates[1]).astype(np.float32)
        cell *= 2
        cell += taken
        met = np.bincount(cell, minlength=2 * n * MAP).reshape(-1, 2)
        seen += met.sum(axis=1)
        ones += met[:, 1]
    return out


def grouped(texts: list[bytes]) -> list[list[int]]:
    """Rows coded together: ordered by length, ``TOGETHER`` bytes or one text each."""
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    out, held, size = [], [], 0
    for i in order:
        if held and size + len(texts[i]) > TOGETHER:
            out.append(held)
            held, size = [], 0
        held.append(i)
        size += len(texts[i]) + 1
    return [*out, held] if held else out


STOP = " end"  # no word holds a space
BYTE = " byte "


def vocabulary(texts: DataFrame) -> DataFrame:
    """(token, n) of all words of a column of texts, of ``STOP`` once per text, and
    of ``BYTE`` with the number of each pair of bytes, the end symbol being one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        codes = np.zeros(256 * 256, dtype=np.int64)
        stops = 0

        def rows(pairs):
            return pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in pairs], pa.string()), pa.array([n for _, n in pairs], pa.int64())],
                names=["token", "n"],
            )

        for texts in parts_of(batches, COUNT_BYTES):
            texts = [t.lower() for t in texts]
            end = bytes([END])
            whole = np.frombuffer(end + end.join(texts) + end, dtype=np.uint8).astype(np.int64)
            codes += np.bincount(whole[:-1] << 8 | whole[1:], minlength=256 * 256)
            stops += len(texts)
            for t in texts:
                words.update(t.split())
                if len(words) > 200_000:  # what a task holds; sums are made after
                    yield rows([(w.decode("utf-8", "surrogatepass"), n) for w, n in words.items()])
                    words.clear()
        pairs = [(w.decode("utf-8", "surrogatepass"), n) for w, n in words.items()]
        pairs += [(f"{BYTE}{i}", int(codes[i])) for i in np.flatnonzero(codes)]
        yield rows([*pairs, (STOP, stops)] if stops else pairs)

    return texts.mapInArrow(work, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def score(
    docs: DataFrame, training: Column, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte).

    Learns from the rows where ``training`` holds; scores, in log10, every row.
    """
    spark = docs.sparkSession
    learn = docs.where(training).select(F.col(text).cast("string").alias("_text"))
    words = cut(vocabulary(learn))
    total = words.where(~F.col("token").startswith(BYTE)).agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count("*")
    )
    n_all, v_all = total.first()
    counts = np.zeros(256 * 256, dtype=np.int64)
    for r in words.where(F.col("token").startswith(BYTE)).collect():  # 65,536 rows at most
        counts[int(r["token"][len(BYTE) :])] = r["n"]
    words = words.where(~F.col("token").startswith(BYTE))
    hot = words.orderBy(F.desc("n"), "token").limit(HOT_WORDS)
    known = {r["token"].encode("utf-8", "surrogatepass"): r["n"] for r in hot.collect()}
    stop_known = known.pop(STOP.encode(), 0) or (words.where(F.col("token") == STOP).first() or {"n": 0})["n"]
    least = min(known.values(), default=0)
    code = trees(counts.reshape(256, 256))
    shared = spark.sparkContext.broadcast((known, code, tables(learn, code)))
    stop_log = float(np.log10(stop_known + 1))

    def work(texts: list[bytes]) -> list[pa.Array]:
        known, code, logit = shared.value
        score = np.zeros(len(texts))
        for group in grouped(texts):
            score[group] = bits_of([texts[i] for i in group], code, logit) * -np.log10(2)
        n_tokens, n_known, logs, cold = [], [], [], []
        for t in texts:
            tokens = t.lower().split()
            found = [known.get(w) for w in tokens]
            # What is not among the frequent words is looked up in the vocabulary.
            cold.append([w.decode("utf-8", "surrogatepass") for w, c in zip(tokens, found, strict=True) if c is None])
            c = np.array([c for c in found if c is not None], dtype=np.float64)
            n_tokens.append(len(tokens) + 1)
            n_known.append(len(c) + (stop_known > 0))
            logs.append(float(np.log10(c + 1).sum()) + stop_log)
        rate = score / -np.log10(2) / np.array([len(t) + 1 for t in texts])
        return [
            pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(logs, pa.float64()),
            pa.array(score, pa.float64()), pa.array(rate, pa.float64()), pa.array(cold, pa.list_(pa.string())),
        ]

    rows = docs.select(
        F.col(id_column), F.coalesce(~training, F.lit(False)).alias("held_out"), F.col(text).alias("_t")
    )
    fields = "n_tokens bigint, n_hot bigint, logs double, score double, bits_per_byte double, cold array<string>"
    scored = per_text(rows, "_t", work, fields, [id_column, "held_out"])
    # Written before rows are numbered, so the numbers hold if a task runs again.
    scored = cut(scored.withColumn("_row", F.monotonically_increasing_id()))
    rare = scored.select("_row", F.explode("cold").alias("token"))
    rest = words.where(F.col("n") <= least) if len(known) >= HOT_WORDS - 1 else words.limit(0)
    looked = (
        rare.join(rest, "token")
        .groupBy("_row")
        .agg(F.sum(F.log10(F.col("n") + 1)).alias("_logs"), F.count("*").alias("_known"))
    )
    share = float(np.log10(n_all + v_all + 1))
    return scored.drop("cold").join(looked, "_row", "left").select(
        id_column,
        "held_out",
        "n_tokens",
        (F.col("n_hot") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(share)).alias("base_score"),
        "score",
        "bits_per_byte",
    )
