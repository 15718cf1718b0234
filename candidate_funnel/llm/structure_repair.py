"""Cheapest repairs of conversations, streamed row by row.

A repaired conversation is empty or an optional system turn followed by pairs of
a user and an assistant turn. Rows are judged first:

* blank: no character but white space; must be deleted;
* duplicate: role and text stood earlier in the conversation; must be deleted;
* truncated: the last character that is no white space ends no sentence.

Edits and costs: Keep 0, Rerole to user or assistant 3, Delete 4, Insert an empty
user or assistant turn 3; a truncated row that is not deleted adds 3. Of the
cheapest edits those with the least audit (their initials, in order) hold.

One shuffle by conversation serves everything; what follows sorts inside
partitions, which spills:

1. duplicates by a window over (conversation, role, text);
2. the *plan*: rows from last to first. The state of the dynamic program is the
   least cost from a row to the end for each of four positions in the pattern;
   it is carried across Arrow batches. Every row leaves with one byte, the best
   edit for each position in two bits. These back pointers are rows of the
   stream, so Spark's sorter spills them with the rows;
3. the *walk*: rows from first to last. Following the bytes gives the edits, the
   counts and the digest of the repaired text, carried across batches too.

No task holds a conversation: memory does not depend on its length. A single
conversation is one stream in one task, as its order is what is computed.

Defined results: a null conversation is a conversation; null roles and texts are
one space; null turns come first; rows of one turn go by role, then text. An
empty role has no initial and can only be changed or deleted. Repeated rows are
duplicates. A row marked as gone only names its conversation. An empty table has
no conversations. Other columns of the rows are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the costs.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

ROLES = ("user", "assistant")
LEGAL_PAIRS = ("su", "ua", "au")

# Positions in the pattern: nothing yet, after the system turn, after a user
# turn, after an assistant turn. At the first and last it may end.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
# The position after a user or an assistant turn, whichever may come next.
NEXT = (USER, USER, ASSISTANT, USER)
AFTER_KEPT = {
    "s": (SYSTEM, None, None, None),
    "u": (USER, USER, None, USER),
    "a": (None, None, ASSISTANT, None),
}
# Codes in order of their letters, so that the least letter is the least code.
D, I, K, R = range(4)
LETTERS = "DIKR"
FAR = 1 << 60

FINE, BLANK, DUPLICATE, CUT_SHORT = range(4)


def ahead(cost: list[int]) -> list[int]:
    """Least cost for each position if turns may be inserted first.

    A third insertion would come back to a position already passed.
    """
    return [
        min(cost[p], INSERT + cost[NEXT[p]], 2 * INSERT + cost[NEXT[NEXT[p]]]) for p in range(4)
    ]


AT_END = ahead([0 if p in ENDS else FAR for p in range(4)])


def before(cost: list[int], initial: str, fault: int) -> tuple[list[int], int]:
    """Costs from a row on, given those after it, and its back pointers."""
    kept = AFTER_KEPT.get(initial, (None,) * 4)
    extra = TRUNCATED if fault == CUT_SHORT else 0
    ways = []
    for p in range(4):
        own = [DELETE + cost[p], FAR, FAR, FAR]
        if fault not in (BLANK, DUPLICATE):
            if kept[p] is not None:
                own[K] = extra + cost[kept[p]]
            own[R] = extra + REROLE + cost[NEXT[p]]
        ways.append(own)
    best = ahead([min(own) for own in ways])
    byte = 0
    for p in range(4):
        ways[p][I] = INSERT + best[NEXT[p]]
        byte |= ways[p].index(best[p]) << (2 * p)
    return best, byte


def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds ``_edit``, the back pointers, to rows that come last first."""
    at, cost = (), AT_END
    for batch in batches:
        edits = np.zeros(len(batch), dtype=np.int32)
        columns = (batch[c].tolist() for c in ("_conv", "_gone", "_role", "_fault"))
        for k, (conv, gone, role, fault) in enumerate(zip(*columns, strict=True)):
            if at != (conv,):
                at, cost = (conv,), AT_END
            if not gone:
                cost, edits[k] = before(cost, role[:1], fault)
        yield batch.assign(_edit=edits)


@dataclass
class Walk:
    """A conversation as far as it has been read."""

    conv: str | None
    position: int = START
    cost: int = 0
    audit: list[str] = field(default_factory=list)
    counts: list[int] = field(default_factory=lambda: [0, 0, 0, 0])
    illegal: int = 0
    turns: list[int] = field(default_factory=lambda: [0, 0, 0])
    last: str | None = None
    digest: object = field(default_factory=hashlib.sha256)
    written: int = 0

    def emit(self, role: str, text: str, edit: int) -> tuple:
        """A turn of the repaired conversation."""
        self.digest.update((("\n" if self.written else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.written += 1
        return (self.conv, self.written, role, text, LETTERS[edit])

    def insert(self) -> tuple:
        role = ROLES[self.position == USER]
        self.position, self.cost = NEXT[self.position], self.cost + INSERT
        self.audit.append("I")
        return self.emit(role, "", I)

    def row(self, turn: str | None, role: str, text: str, fault: int, edits: int) -> list[tuple]:
        """Follow the back pointers over one row; returns the turns it leaves."""
        self.counts[fault] += 1
        if self.last is not None and self.last + role[:1] not in LEGAL_PAIRS:
            self.illegal += 1
        self.last = role[:1]
        if turn is not None:
            number = int(turn)
            low, high, distinct = self.turns
            if not distinct:
                self.turns = [number, number, 1]
            elif number != high:
                self.turns = [low, number, distinct + 1]
        out = []
        while (edit := (edits >> (2 * self.position)) & 3) == I:
            out.append(self.insert())
        self.audit.append(LETTERS[edit])
        if edit == D:
            self.cost += DELETE
            return out
        self.cost += TRUNCATED if fault == CUT_SHORT else 0
        if edit == R:
            self.cost += REROLE
            role = ROLES[self.position == USER]
            self.position = NEXT[self.position]
        else:
            self.position = AFTER_KEPT[role[:1]][self.position]
        out.append(self.emit(role, text, edit))
        return out

    def finish(self) -> list[tuple]:
        out = []
        while self.position not in ENDS:
            out.append(self.insert())
        return out

    def report(self) -> tuple:
        low, high, distinct = self.turns
        gaps = high - low + 1 - distinct if distinct else 0
        return (
            self.conv, gaps, *self.counts[1:], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest(),
        )


REPORT = "_conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "_conv string, position long, role string, text string, edit string"


def walk(turns: bool):
    """The second pass: repaired turns, or a report per conversation."""
    names = [f.split()[0] for f in (TURNS if turns else REPORT).split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = None
        for batch in batches:
            out = []
            columns = (batch[c].tolist() for c in ("_conv", "_gone", "_turn", "_role", "_text", "_fault", "_edit"))
            for conv, gone, *row in zip(*columns, strict=True):
                if at is None or at.conv != conv:
                    if at is not None:
                        rest = at.finish()
                        out += rest if turns else [at.report()]
                    at = Walk(conv)
                if not gone:
                    made = at.row(*row)
                    if turns:
                        out += made
            yield pd.DataFrame(out, columns=names)
        if at is not None:
            rest = at.finish()
            yield pd.DataFrame(rest if turns else [at.report()], columns=names)

    return run


def judged(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    gone: Column | None = None,
) -> DataFrame:
    """(_conv, _turn, _role, _text, _gone, _nth, _fault), partitioned by conversation.

    Numbers travel as text: pandas would turn those with gaps into floats.
    """
    plain = rows.select(
        F.col(conv).cast("string").alias("_conv"),
        F.col(turn).cast("string").alias("_turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("_role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("_text"),
        F.coalesce(F.lit(False) if gone is None else gone, F.lit(False)).alias("_gone"),
        F.col(turn).cast("bigint").alias("_at"),
    ).repartition("_conv")
    # Grouping by more than the conversation needs no second shuffle.
    same = Window.partitionBy("_conv", "_gone", "_role", F.xxhash64("_text"), "_text").orderBy(F.asc_nulls_first("_at"))
    tail = F.rtrim(F.col("_text"), F.lit(" \t\n\x0b\x0c\r"))
    fault = (
        F.when(tail == "", BLANK)
        .when(F.col("_nth") > 1, DUPLICATE)
        .when(~F.right(tail, F.lit(1)).isin(".", "!", "?"), CUT_SHORT)
        .otherwise(FINE)
    )
    return plain.withColumn("_nth", F.row_number().over(same)).withColumn("_fault", fault.cast("int"))


def planned(rows: DataFrame, **columns) -> DataFrame:
    """``judged`` rows with back pointers, first to last inside partitions."""
    held = judged(rows, **columns)
    order = [F.asc_nulls_first("_at"), F.asc("_role"), F.asc("_text"), F.asc("_nth")]
    back = [F.desc_nulls_last("_at"), F.desc("_role"), F.desc("_text"), F.desc("_nth")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.drop("_at").schema.fields)
    # ``_at`` is nullable; as text it survives pandas.
    last_first = held.sortWithinPartitions("_conv", *back).drop("_at")
    pointed = last_first.mapInPandas(plan, f"{schema}, _edit int")
    return pointed.withColumn("_at", F.col("_turn").cast("bigint")).sortWithinPartitions("_conv", *order)


def report(rows: DataFrame, conv: str = "conv_id", **columns) -> DataFrame:
    """One row per conversation: faults found, cost, audit, digest of the repaired text."""
    found = planned(rows, conv=conv, **columns).mapInPandas(walk(turns=False), REPORT)
    kept = [c for c in found.columns if c != "_conv"]
    return found.select(F.col("_conv").cast(rows.schema[conv].dataType).alias(conv), *kept)


def repaired(rows: DataFrame, conv: str = "conv_id", **columns) -> DataFrame:
    """(conv, position, role, text, edit): the turns of the repaired conversations."""
    made = planned(rows, conv=conv, **columns).mapInPandas(walk(turns=True), TURNS)
    return made.select(F.col("_conv").cast(rows.schema[conv].dataType).alias(conv), "position", "role", "text", "edit")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, and ``gone`` where a row was dropped.

    The fault of a row follows from the crc32 of its ``conv_id:turn``.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    marked = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("_kind"))
    text = (
        F.when(F.col("_kind").isin(0, 1), "")
        .when(F.col("_kind") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
    )
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1)))
    return marked.select(
        "conv_id",
        "turn",
        F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        (F.col("_kind") == 0).alias("gone"),
        times.alias("_time"),
    ).drop("_time")
