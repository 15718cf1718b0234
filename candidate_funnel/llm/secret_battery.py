"""Secret scans: fixed patterns, and a battery of randomness tests.

Two kinds of evidence meet. *Patterns* (an assignment to a telling name, an
access key, a long hexadecimal run) are always reported. *Tokens*, runs of key
characters that no pattern covers, are reported if they look drawn by a random
generator:

1. A run is cut at ``=``; a piece that mixes ``+/`` with ``-_`` gives the longest
   runs of base 64 and those of its URL form, and of overlapping ones the more
   surprising is reported, its ratio divided by their number. An encoding is
   inferred from the characters that occur: hexadecimal, base 32, base 64 or its
   URL form. Its alphabet is what uniformity is tested against.
2. The battery: chi-squared uniformity over the alphabet, the number of runs
   above and below the alphabet's middle, and lag-one serial correlation. Their
   p-values are combined by Fisher's rule; a token the battery rejects as not
   random is no secret, its p-value below is one.
3. Under natural text a token's likelihood ratio of *uniform over the alphabet*
   to *each byte as likely as after the one before it in the corpus* exceeds x
   with a probability of at most 1/x, so 1/ratio is a valid p-value. It takes the
   token's length into account by itself: short tokens cannot reach small values.
4. Benjamini-Hochberg over all tokens of the whole corpus that were tested,
   rejected ones too, weighted by length (the weights have mean one), bounds the
   expected share of false reports by ``q``. The step-up runs on a histogram of
   weighted p-values, of fixed size.

Defined results: null is the empty text; a text without finds has empty
``spans``; rows are independent, so repeated rows and null ids are kept.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candidate_funnel.llm.common import Plain, parts_of, per_text
from candidate_funnel.session import cut

# The patterns, their order, and the least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16

# Runs that may be keys: at least this long, of at least two kinds of characters.
LEAST_TOKEN = 20
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % LEAST_TOKEN)
# No encoding mixes the signs of these two.
WHOLE = tuple(re.compile(r"[A-Za-z0-9%s]{%d,}" % (signs, LEAST_TOKEN)) for signs in ("+/", "_-"))

# Encodings by name, the smallest that holds a token's characters is taken.
ENCODINGS = (
    ("hex_lower", "0123456789abcdef"),
    ("hex_upper", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower_digits", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)

# Bytes that are counted together, and what a byte's own frequency weighs against
# the pairs counted after the byte before it: enough that after a rare byte a
# key's own pairs do not make the key natural.
COUNT_BYTES = 4 << 20
PAIR_PRIOR = 256.0

# Weighted -log10 p is counted in this many bins of a tenth.
BINS = 1000


def patterns(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every pattern in ``text``, in code points, in order."""
    found = [
        (m.start(), 0, m.end())
        for m in ASSIGN.finditer(text)
        if m.end(2) - m.start(2) >= LEAST_ASSIGN
    ]
    if "AKIA" in text:
        found += [
            (m.start(), 1, m.end())
            for m in ACCESS.finditer(text)
            if m.end() - m.start() >= LEAST_ACCESS
        ]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def infer(token: str) -> tuple[str, str] | None:
    """Name and alphabet of the smallest encoding that can hold ``token``."""
    held = set(token)
    for name, alphabet in ENCODINGS:
        if held <= set(alphabet):
            return name, alphabet
    return None


def chi_tail(x: float, degrees: float) -> float:
    """Upper tail of chi-squared, by the cube-root normal approximation."""
    spread = 2 / (9 * degrees)
    z = ((max(x, 0) / degrees) ** (1 / 3) - (1 - spread)) / math.sqrt(spread)
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(token: str, alphabet: str) -> float:
    """Combined p-value of the three tests, small where ``token`` is not random."""
    rank = {c: i for i, c in enumerate(alphabet)}
    x = np.array([rank[c] for c in token], dtype=float)
    n, size = len(x), len(alphabet)
    counts = np.bincount(x.astype(int), minlength=size)
    chi = float(((counts - n / size) ** 2).sum() * size / n)
    p_chi = chi_tail(chi, size - 1)
    above = x >= size / 2
    high = int(above.sum())
    low = n - high
    if high == 0 or low == 0:
        return 0.0
    runs = 1 + int((above[1:] != above[:-1]).sum())
    mean = 2 * high * low / n + 1
    variance = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
    p_runs = math.erfc(abs(runs - mean) / math.sqrt(2 * variance))
    centred = x - (size - 1) / 2
    serial = float((centred[1:] * centred[:-1]).sum()) / (float((centred**2).sum()) or 1.0)
    p_serial = math.erfc(abs(serial) * math.sqrt(n / 2))
    fisher = -2 * sum(math.log(max(p, 1e-300)) for p in (p_chi, p_runs, p_serial))
    return chi_tail(fisher, 6)


# Row of ``natural`` for a token's first byte.
FIRST = 256


def surprise(token: str, alphabet: str, log_natural: np.ndarray) -> float:
    """log10 of the likelihood ratio of a uniform generator to natural text."""
    codes = np.frombuffer(token.encode(), dtype=np.uint8).astype(int)
    natural_ = log_natural[FIRST, codes[0]] + log_natural[codes[:-1], codes[1:]].sum()
    return float(-len(codes) * math.log10(len(alphabet)) - natural_)


def mixed(token: str) -> bool:
    """Letters and digits both occur, or both cases inside the token."""
    digits = any(c.isdigit() for c in token)
    letters = any(c.isalpha() for c in token)
    inside = token[1:]
    both = any(c.islower() for c in inside) and any(c.isupper() for c in inside)
    return letters and (digits or both)


def tokens(
    text: str, covered: Sequence[tuple[int, int, int]], log_natural: np.ndarray, alpha: float
) -> tuple[list[tuple[int, int, str, float, float]], list[int]]:
    """Tokens that no pattern touches and that the battery takes for random:
    start, end, encoding, the battery's p-value and the log10 likelihood ratio.
    Then the lengths of all tokens that were tested."""
    out, tested = [], []
    for m in TOKEN.finditer(text):
        pieces = [m.span()]
        if infer(m.group()) is None:
            pieces = [p.span() for rx in WHOLE for p in rx.finditer(text, *m.span())]
        found = []
        for start, end in pieces:
            bare = text[start:end]
            if not mixed(bare) or any(a < end and start < b for a, _, b in covered):
                continue
            name, alphabet = infer(bare)
            p = battery(bare, alphabet)
            tested.append(end - start)
            if p >= alpha:
                value = surprise(bare, alphabet, log_natural) - math.log10(len(pieces))
                found.append((start, end, name, p, value))
        # Runs of both forms may overlap; the more surprising one stays.
        held = []
        for f in sorted(found, key=lambda f: (-f[4], f[0])):
            if all(f[1] <= h[0] or h[1] <= f[0] for h in held):
                held.append(f)
        out += sorted(held)
    return out, tested


def natural(docs: DataFrame, text: str = "text") -> np.ndarray:
    """log10 probability of each byte after each byte, from all texts; the row
    ``FIRST`` has the bytes' own. At most 65,536 counts leave a task or meet here.

    Pairs seldom seen lean on the frequency of their second byte.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, dtype=np.int64)
        for texts in parts_of(batches, COUNT_BYTES):
            codes = np.frombuffer(b"\n".join(texts), dtype=np.uint8).astype(np.int64)
            total += np.bincount(codes[:-1] << 8 | codes[1:], minlength=1 << 16)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met], pa.int64())], names=["pair", "n"])

    each = docs.select(F.col(text).cast("string")).mapInArrow(count, "pair int, n bigint")
    counts = np.zeros(1 << 16)
    for r in each.groupBy("pair").agg(F.sum("n").alias("n")).collect():
        counts[r["pair"]] = r["n"]
    counts = counts.reshape(256, 256)
    own = (counts.sum(axis=0) + 1) / (counts.sum() + 256)
    after = (counts + PAIR_PRIOR * own) / (counts.sum(axis=1, keepdims=True) + PAIR_PRIOR)
    return np.log10(np.vstack([after, own]))


def threshold(found: DataFrame, all_: int, mean: float, q: float) -> float:
    """Least ``surprise + log10(weight)`` to report.

    ``found`` has one row per token that may be reported, with ``surprise`` and
    ``length``, of ``all_`` tokens tested, ``mean`` long. The step-up compares bin
    by bin: a bin is reported if, with all tokens at least as surprising,
    p <= q * reported / all.
    """
    weighted = F.col("surprise") + F.log10(F.col("length") / F.lit(mean))
    bin_ = F.least(F.greatest(F.floor(weighted * 10), F.lit(-1)), F.lit(BINS - 1))
    rows = found.groupBy(bin_.cast("int").alias("bin")).agg(F.count("*").alias("n")).collect()
    counts = {r["bin"]: r["n"] for r in rows}  # at most BINS + 1 rows
    reported, least = 0, math.inf
    for b in sorted((b for b in counts if b >= 0), reverse=True):
        reported += counts[b]
        if 10 ** (-b / 10) <= q * reported / all_:
            least = b / 10
    return least


def scan(
    docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",),
    q: float = 0.01, alpha: float = 0.001,
) -> DataFrame:
    """Columns ``keep`` and ``finds``: all secrets of each text, in order.

    ``finds`` is an array of (start, kind, end, encoding, p_random, surprise);
    positions are code points, the end exclusive. Kinds are numbered as in
    ``KINDS``; pattern finds have neither encoding nor values.
    """
    shared = docs.sparkSession.sparkContext.broadcast(natural(docs, text))  # 0.5 MB
    find = pa.struct(
        [("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()),
         ("encoding", pa.string()), ("p_random", pa.float64()), ("surprise", pa.float64())]
    )

    def work(texts: list[bytes]) -> list[pa.Array]:
        out, tested = [], []
        for raw in texts:
            t = raw.decode("utf-8", "surrogatepass")
            base = patterns(t)
            rows = [(s, k, e, None, None, None) for s, k, e in base]
            random_, lengths = tokens(t, base, shared.value, alpha)
            rows += [(s, 3, e, n, p, v) for s, e, n, p, v in random_]
            tested.append(lengths)
            rows.sort(key=lambda r: (r[0], r[1]))
            out.append([dict(zip(("start", "kind", "end", "encoding", "p_random", "surprise"), r, strict=True)) for r in rows])
        n = pa.array([len(x) for x in tested], pa.int64())
        return [pa.array(out, pa.list_(find)), n, pa.array([sum(x) for x in tested], pa.int64())]

    fields = (
        "finds array<struct<start:bigint,kind:int,end:bigint,"
        "encoding:string,p_random:double,surprise:double>>, _n_tested bigint, _tested_length bigint"
    )
    every = cut(per_text(docs, text, work, fields, keep))
    found = every.select(F.explode("finds").alias("f")).where("f.kind = 3")
    found = found.select("f.surprise", (F.col("f.end") - F.col("f.start")).alias("length"))
    all_, length = every.agg(F.sum("_n_tested"), F.sum("_tested_length")).first()
    mean = length / all_ if all_ else 1.0
    least = threshold(found, all_, mean, q) if all_ else math.inf

    def shown(f):
        weight = F.log10((f["end"] - f["start"]) / F.lit(mean))
        return (f["kind"] < 3) | (F.floor((f["surprise"] + weight) * 10) / 10 >= F.lit(least))

    return every.select(*keep, F.filter("finds", shown).alias("finds"))


def listed(finds, start, kind, end):
    """``kind:start:end`` of finds, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            finds,
            lambda f: F.concat_ws(
                ":", F.get(names, f[kind]), f[start].cast("string"), f[end].cast("string")
            ),
        ),
        ",",
    )


def digest(scanned: DataFrame) -> DataFrame:
    """Counts by pattern, the digest of the pattern spans, and all spans as text."""

    def of(kind):
        return F.size(F.filter("finds", lambda f: f["kind"] == kind)).cast("long")

    base = F.filter("finds", lambda f: f["kind"] < 3)
    return scanned.select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(listed(base, "start", "kind", "end").cast("binary"), 256).alias("base_sha256"),
        listed(F.col("finds"), "start", "kind", "end").alias("spans"),
        of(3).alias("n_random"),
    )


def redact(docs: DataFrame, q: float = 0.01, text: str = "text") -> DataFrame:
    """``docs`` with every find of its texts replaced by ``[kind]``.

    All columns and rows stay; ``n_chars``, where there is one, is the new length.
    """
    plain = Plain(docs)
    held = plain.name(text)
    found = scan(plain.frame, held, plain.names, q)
    start = F.lit(1).cast("long")
    step = F.aggregate(
        "finds",
        F.struct(F.lit("").alias("out"), start.alias("at")),
        lambda acc, f: F.when(
            f["start"] + 1 < acc["at"],
            F.struct(acc["out"].alias("out"), F.greatest(acc["at"], f["end"] + 1).alias("at")),
        ).otherwise(
            F.struct(
                F.concat(
                    acc["out"],
                    F.substring(held, acc["at"].cast("int"), (f["start"] + 1 - acc["at"]).cast("int")),
                    F.lit("["),
                    F.get(F.array(*[F.lit(k) for k in KINDS]), f["kind"]),
                    F.lit("]"),
                ).alias("out"),
                (f["end"] + 1).alias("at"),
            )
        ),
        lambda acc: F.concat(acc["out"], F.substring(held, acc["at"].cast("int"), F.length(held))),
    )
    new = F.when(F.size("finds") > 0, step).otherwise(F.col(held))
    hit = F.size("finds") > 0
    changed = {text: new}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(hit, F.length(new)).otherwise(F.col(plain.name("n_chars")))
    return plain.back(found, changed)
