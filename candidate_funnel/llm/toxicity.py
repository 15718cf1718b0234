"""Toxicity: a lexicon met through Levenshtein automata, judged by its context.

*Lexicon.* Words, and stems (first letters, marked ``*``), that occur in many
different surroundings of documents labelled toxic and hardly elsewhere. It is
learned from at most ``SAMPLE`` labelled rows, which alone bound its size: every
entry that passes the tests of support and ratio stays. Words of any length are
entries; those of up to three letters have no stems. Counting surroundings instead of documents keeps copies of one
document from making its words look toxic.

*Automata.* The lexicon is a trie. A Levenshtein automaton of one error runs
along it, both at once: a state is a set of (trie node, errors) pairs, made
when first needed and kept. A word that matches nothing dies after a few
letters. Entries of ``FUZZY`` letters or more match with one error; stems match
exactly. Misspellings that occur in clean sample documents are words of their
own and are left out.

*Context.* ``SPAN`` words on either side of a hit decide whether it is quoted
(between quotation marks or after a word of reporting) or used. Used, quoted
and misspelled hits are summed apart, by weight, and a logistic model fitted on
the same sample turns the sums into a probability.

Defined results: null and empty texts have no hit and the score of none; if the
labels lack one of the classes, or no word passes the tests, nothing is learned
and every score is 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candidate_funnel.llm.common import Memo, Plain, labelled_sample, per_text, sigmoid

SAMPLE = 10_000
STEMS = range(4, 8)
FUZZY = 5
SPAN = 6
LEAST = 5  # surroundings an entry needs
FEATURES = 6

EDGE = re.compile(r"^[\W_]+|[\W_]+$")
QUOTES = set("\"'“”„«»‘’`")
# Words that announce another's speech.
REPORTING = {
    "said", "says", "wrote", "called", "quoted", "quote", "word", "term", "slur", "insult",
    "dit", "mot", "écrit", "sagte", "wort", "schrieb", "dijo", "palabra", "escribió",
}


def bare(token: str) -> str:
    """A token in lower case without punctuation at its ends."""
    return EDGE.sub("", token.lower())


def entries(word: str) -> list[str]:
    """The word and its stems."""
    return [word, *[word[:k] + "*" for k in STEMS if k < len(word)]]


class Node:
    __slots__ = ("children", "word", "stem", "deep")

    def __init__(self):
        self.children: dict[str, Node] = {}
        self.word = self.stem = -1
        self.deep = False  # whether an entry that may be misspelled lies below


class Matcher:
    """The lexicon's trie with the automaton's states, made as words need them."""

    def __init__(self, lexicon: list[tuple[str, float]], exceptions: set[str] = frozenset()):
        self.lexicon, self.exceptions = lexicon, exceptions
        self.nodes = [Node()]
        for i, (entry, _) in enumerate(lexicon):
            stem = entry.endswith("*")
            path = [0]
            for c in entry.rstrip("*"):
                children = self.nodes[path[-1]].children
                if c not in children:
                    children[c] = len(self.nodes)
                    self.nodes.append(Node())
                path.append(children[c])
            setattr(self.nodes[path[-1]], "stem" if stem else "word", i)
            if not stem and len(entry) >= FUZZY:
                for p in path:
                    self.nodes[p].deep = True
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.ends: list[tuple[int, int]] = []
        self.stems: list[int] = []
        self.start = self._state(self._skips({(0, 0)}))

    def _skips(self, pairs: set) -> frozenset:
        """Add what is reached by leaving out a letter of an entry."""
        out = set(pairs)
        for node, e in pairs:
            if e == 0:
                for child in self.nodes[node].children.values():
                    if self.nodes[child].deep:
                        out.add((child, 1))
        return frozenset((n, e) for n, e in out if e == 0 or (n, 0) not in out)

    def _state(self, pairs: frozenset) -> int:
        if pairs not in self.states:
            self.states[pairs] = len(self.sets)
            self.sets.append(pairs)
            self.moves.append({})
            exact = [self.nodes[n].word for n, e in pairs if e == 0 and self.nodes[n].word >= 0]
            fuzzy = [
                self.nodes[n].word
                for n, e in pairs
                if e == 1 and self.nodes[n].word >= 0
                and len(self.lexicon[self.nodes[n].word][0]) >= FUZZY
            ]
            best = max(fuzzy, key=lambda i: (self.lexicon[i][1], -i)) if fuzzy else -1
            self.ends.append((exact[0] if exact else -1, best))
            self.stems.append(max((self.nodes[n].stem for n, e in pairs if e == 0), default=-1))
        return self.states[pairs]

    def _move(self, state: int, c: str) -> int:
        out = set()
        for node, e in self.sets[state]:
            here = self.nodes[node]
            if c in here.children:
                child = here.children[c]
                if e == 0 or self.nodes[child].deep:
                    out.add((child, e))
            if e == 0 and here.deep:
                out.add((node, 1))  # a letter too many
                for other, child in here.children.items():
                    if other != c and self.nodes[child].deep:
                        out.add((child, 1))
        to = self._state(self._skips(out)) if out else -1
        self.moves[state][c] = to
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """(entry, errors) of the best match: the whole word, a stem, a misspelling."""
        state, stem = self.start, -1
        for c in word:
            to = self.moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state < 0:
                break
            stem = max(stem, self.stems[state])
        if state >= 0 and self.ends[state][0] >= 0:
            return self.ends[state][0], 0
        if stem >= 0:
            return stem, 0
        if state >= 0 and self.ends[state][1] >= 0 and word not in self.exceptions:
            return self.ends[state][1], 1
        return None


class Reader:
    """Hits of whole texts; what is known of a token is kept for the next one."""

    def __init__(self, matcher: Matcher):
        self.matcher = matcher
        self.memo = Memo(lambda token: self.matcher.match(bare(token)))

    def hits(self, text: str) -> list[tuple[int, int, int, bool]]:
        """(word number, entry, errors, quoted) of every hit."""
        tokens = text.split()
        memo = self.memo
        out = []
        for i, found in enumerate([memo[t] for t in tokens]):
            if found is not None:
                out.append((i, *found, quoted(tokens, i)))
        return out

    def features(self, text: str) -> list[float]:
        """Used, quoted and misspelled weight, the largest, used per word, any use."""
        used = quote = wrong = most = 0.0
        hits = self.hits(text)
        for _, entry, errors, inside in hits:
            weight = self.matcher.lexicon[entry][1]
            if errors:
                wrong += weight * (0.3 if inside else 1.0)
            elif inside:
                quote += weight
            else:
                used += weight
            if not inside and not errors:
                most = max(most, weight)
        n = max(1, text.count(" ") + 1)
        return [np.log1p(used), np.log1p(quote), np.log1p(wrong), most, min(1.0, used / n), float(used > 0)]


def quoted(tokens: list[str], i: int) -> bool:
    """Whether quotation marks enclose word ``i`` within its window, or a word of
    reporting comes shortly before an opening mark or the word itself."""
    before, after = tokens[max(0, i - SPAN) : i], tokens[i + 1 : i + 1 + SPAN]
    own = tokens[i]
    opened = own[:1] in QUOTES or any(t[:1] in QUOTES for t in before)
    closed = own.rstrip(".,;:!?")[-1:] in QUOTES or any(
        t.rstrip(".,;:!?")[-1:] in QUOTES for t in after
    )
    if opened and closed:
        return True
    return any(bare(t) in REPORTING for t in before[-3:])


def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entry, place, clean): for toxic rows a hash of each entry's neighbours,
    for clean rows a null place and the number of texts with the entry."""
    clean: Counter = Counter()
    for batch in batches:
        entry, place = [], []
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = [bare(t) for t in (text or "").split()]
            if label:
                seen = set()
                for i, w in enumerate(words):
                    if w:
                        near = f"{words[i - 1] if i else ''} {words[i + 1] if i + 1 < len(words) else ''}"
                        key = xxhash.xxh3_64_intdigest(near) >> 1
                        seen.update((e, key) for e in entries(w))
                entry += [e for e, _ in seen]
                place += [k for _, k in seen]
            else:
                clean.update({e for w in set(words) if w for e in entries(w)})
        yield pa.RecordBatch.from_arrays(
            [pa.array(entry, pa.string()), pa.array(place, pa.int64()), pa.array([0] * len(entry), pa.int64())],
            names=["entry", "place", "clean"],
        )
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(clean), pa.string()), pa.array([None] * len(clean), pa.int64()), pa.array(list(clean.values()), pa.int64())],
        names=["entry", "place", "clean"],
    )


def without_redundant(held: dict[str, int]) -> set[str]:
    """Entries without the stems that say no more than one longer entry.

    Such a longer entry has 0.8 times the stem's surroundings or more.
    """
    longer: dict[str, list[tuple[int, str]]] = {}
    for entry, n in held.items():
        letters = entry.rstrip("*")
        for k in STEMS:
            if k <= len(letters):
                # The two best are enough: one of them is not the stem itself.
                longer[letters[:k]] = sorted([*longer.get(letters[:k], []), (n, entry)], reverse=True)[:2]
    return {
        e
        for e, n in held.items()
        if not e.endswith("*") or all(o == e or m < 0.8 * n for m, o in longer[e[:-1]])
    }


class Model:
    def __init__(self, matcher: Matcher, weights: np.ndarray):
        self.matcher, self.weights = matcher, weights
        self.reader = None

    def __getstate__(self):
        return self.matcher.lexicon, self.matcher.exceptions, self.weights

    def __setstate__(self, state):
        lexicon, exceptions, self.weights = state
        self.matcher = Matcher(lexicon, exceptions)
        self.reader = None

    def score(self, text: str) -> float:
        if self.reader is None:
            self.reader = Reader(self.matcher)
        x = np.array([*self.reader.features(text), 1.0])
        return float(sigmoid(x @ self.weights))


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the constant."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    ridge = np.diag([0.05] * (x.shape[1] - 1) + [1e-6]) * 10
    for _ in range(50):
        p = sigmoid(x @ w)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (p - y) + ridge @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, most: int = SAMPLE) -> Model | None:
    """Lexicon, exceptions and weights from at most ``most`` labelled rows."""
    sample = labelled_sample(docs, labels, "toxic", allowed, most).select("_text", "label")
    sample = sample.cache()
    n = dict(sample.groupBy("label").count().collect())
    if not n.get(1) or not n.get(0):
        sample.unpersist()
        return None
    counted = (
        sample.mapInArrow(surroundings, "entry string, place bigint, clean bigint")
        .groupBy("entry")
        .agg(F.count_distinct("place").alias("toxic"), F.sum("clean").alias("clean"))
        .cache()
    )
    ratio = (F.col("toxic") / n[1]) / ((F.col("clean") + 0.5) / n[0])
    # An entry has LEAST surroundings or more in the sample, which bounds their number.
    rows = (
        counted.where((F.col("toxic") >= LEAST) & (ratio >= 20))
        .select("entry", "toxic", F.log(ratio).alias("weight"))
        .collect()
    )
    kept = without_redundant({r["entry"]: r["toxic"] for r in rows})
    lexicon = sorted((r["entry"], round(float(r["weight"]), 6)) for r in rows if r["entry"] in kept)
    if not lexicon:
        counted.unpersist()
        sample.unpersist()
        return None
    matcher = Matcher(lexicon)

    def misspelled(batches):
        for batch in batches:
            own = [w for w in batch.column(0).to_pylist() if (m := matcher.match(w)) and m[1]]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string())], names=["word"])

    # Words within one error of an entry: bounded by the entries' letters.
    wrong = counted.where("clean > 0 and entry not like '%*'").select("entry")
    exceptions = {r["word"] for r in wrong.mapInArrow(misspelled, "word string").collect()}
    matcher = Matcher(lexicon, exceptions)
    shared = docs.sparkSession.sparkContext.broadcast(Model(matcher, np.zeros(FEATURES + 1)))

    def features(texts: list[bytes]) -> list[pa.Array]:
        reader = Reader(shared.value.matcher)
        return [pa.array([reader.features(t.decode("utf-8", "surrogatepass")) for t in texts], pa.list_(pa.float64()))]

    made = per_text(sample, "_text", features, "x array<double>", ["label"]).collect()
    counted.unpersist()
    sample.unpersist()
    made.sort(key=lambda r: (r["label"], r["x"]))
    x, y = np.array([r["x"] for r in made]), np.array([r["label"] for r in made])
    return Model(matcher, logistic(x, (y > 0).astype(float)))


def score(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` and the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: list[bytes]) -> list[pa.Array]:
        model = shared.value
        if model is None:
            return [pa.array([0.0] * len(texts), pa.float64())]
        return [pa.array([model.score(t.decode("utf-8", "surrogatepass")) for t in texts], pa.float64())]

    return per_text(docs, text, work, "score double", keep)


def accepted(docs: DataFrame, labels: DataFrame, at: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the model, fitted on all labels, does not reject."""
    plain = Plain(docs)
    model = fit(docs, labels, F.lit(True))
    scored = score(plain.frame, model, plain.names, plain.name("text"))
    return plain.back(scored.where(F.col("score") < at))


def classify(docs: DataFrame, labels: DataFrame, held: Column, allowed: Column, at: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    model = fit(docs, labels, allowed)
    scored = score(docs.select("doc_id", "text", held.alias("held_out")), model, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= at).cast("int"))
