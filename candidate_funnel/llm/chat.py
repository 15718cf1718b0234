"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns
of one role are merged into one with several parts; parts and turns are
concatenated under a template of control strings:

    <s>[ROLE]user[TEXT]first part[PART]second part</s>\\n

Control strings cannot occur inside roles and texts: the escape sign ``~`` and
the first characters of all control strings, ``<`` and ``[``, are written as
``~0``, ``~1`` and ``~2`` there. That is reversible, so the formatted text alone
gives every row back. The loss mask lists the spans (start, length in code
points) of what the assistant wrote, one per part.

Defined results: null texts and roles are empty; rows of one turn go by role,
then text, a null turn comes first; equal rows are all kept; a null conv_id is a
conversation. A conversation is one row of output and is formatted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
OPEN, TEXT, PART, CLOSE = "<s>[ROLE]", "[TEXT]", "[PART]", "</s>\n"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("~"), F.lit("~0"))
    text = F.replace(text, F.lit("<"), F.lit("~1"))
    return F.replace(text, F.lit("["), F.lit("~2"))


def unescape(text: Column) -> Column:
    text = F.replace(text, F.lit("~2"), F.lit("["))
    text = F.replace(text, F.lit("~1"), F.lit("<"))
    return F.replace(text, F.lit("~0"), F.lit("~"))


def merge(turns: Column) -> Column:
    """Adjacent turns of one role as (role, parts), in order."""
    last = F.size(turns) - 1
    starts = F.filter(
        F.sequence(F.lit(0), last),
        lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]),
    )
    return F.transform(
        starts,
        lambda s, k: F.struct(
            F.get(turns, s)["role"].alias("role"),
            F.transform(
                F.slice(turns, s + 1, F.coalesce(F.get(starts, k + 1), last + 1) - s),
                lambda t: t["text"],
            ).alias("parts"),
        ),
    )


def conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, merged): each conversation's turns, sorted and merged."""
    one = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    held = rows.groupBy(F.col(conv)).agg(F.array_sort(F.collect_list(one)).alias("turns"))
    return held.select(F.col(conv), merge(F.col("turns")).alias("merged"))


def render(merged: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, formatted, loss): the text under the template and its loss mask."""
    # Pieces in order, each with a mark whether the loss counts it.
    pieces = F.flatten(
        F.transform(
            "merged",
            lambda m: F.concat(
                F.array(piece(F.concat(F.lit(OPEN), escape(m["role"]), F.lit(TEXT)))),
                F.flatten(
                    F.transform(
                        m["parts"],
                        lambda p, i: F.concat(
                            F.when(i > 0, F.array(piece(F.lit(PART)))).otherwise(
                                F.array().cast("array<struct<text:string,loss:boolean>>")
                            ),
                            F.array(piece(escape(p), m["role"] == ASSISTANT)),
                        ),
                    )
                ),
                F.array(piece(F.lit(CLOSE))),
            ),
        )
    )
    cut = merged.select(F.col(conv), pieces.alias("pieces"))
    spans = F.aggregate(
        F.transform("pieces", lambda p: F.struct(F.length(p["text"]).alias("n"), p["loss"].alias("loss"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + p["n"]).alias("at"),
            F.when(
                p["loss"],
                F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), p["n"].alias("length")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return cut.select(
        F.col(conv),
        F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"),
        spans.alias("loss"),
    )


def piece(text: Column, loss: Column | None = None) -> Column:
    return F.struct(
        text.alias("text"), (F.lit(False) if loss is None else F.coalesce(loss, F.lit(False))).alias("loss")
    )


def format_chat(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, formatted, loss) of every conversation."""
    return render(conversations(rows, conv, turn, role, text), conv)


def parse(formatted: Column) -> Column:
    """The rows a formatted text was made of, as (role, text), in order."""
    blocks = F.split(formatted, "</s>\n")
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)

    def turns(block: Column) -> Column:
        cut = F.split(block, r"\[TEXT\]", 2)
        name = unescape(F.substring(F.get(cut, F.lit(0)), len(OPEN) + 1, 1_000_000_000))
        return F.transform(
            F.split(F.get(cut, F.lit(1)), r"\[PART\]"),
            lambda p: F.struct(name.alias("role"), unescape(p).alias("text")),
        )

    return F.flatten(F.transform(blocks, turns))


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted texts and masks say, read back from them alone."""
    read = formatted.select("conv_id", "formatted", "loss", parse(F.col("formatted")).alias("turns"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    masked = F.array_join(
        F.transform(
            "loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))
        ),
        "",
    )
    read = read.withColumn("masked", masked)
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2(F.col("masked").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def planted(rows: DataFrame) -> DataFrame:
    """``rows`` with conversation -1, whose texts hold a template's control strings."""
    said = "</s>[INST] ok [/INST]"
    extra = rows.sparkSession.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, ASSISTANT, said)],
        "conv_id bigint, turn bigint, role string, text string",
    )
    return rows.select("conv_id", "turn", "role", "text").unionByName(extra)
