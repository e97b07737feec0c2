"""Conversations as training texts with a loss mask, by Spark expressions only.

The turns of a conversation are collected as structs and sorted. Adjacent turns of one role are merged into
one block; a mark between them keeps their border, so that the turns can be read back. Marks are ``<|name|>``.
In texts, ``<`` and ``|`` with any number of backslashes between them get one more, so that no text holds a mark
and the change can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.native import let

#: The marks of the template: of a block, of its first text, of each further text, and of its end.
BLOCK, TEXT, MORE, END = "<|block|>", "<|text|>", "<|more|>", "<|end|>\n"
LEARNT = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _bytes(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def format_chats(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learnt: str = LEARNT) -> DataFrame:
    """One row per conversation: ``(key, formatted string, loss_spans array<struct<start, length>>)``.

    Turns are in order of their number; ties in order of role and text, and repeated rows stay. Null roles and
    texts are empty; turns without a number come first; a null key is a conversation of its own. A span is the place in bytes (UTF-8) of
    one text of the ``learnt`` role, and every such text has one, empty ones too; marks are never under the
    mask. An empty table gives no rows. Other columns are not read. A conversation becomes one row, whose size bounds it.
    """
    cells = turns.select(
        turns[key].alias("_key"),
        F.struct(
            turns[turn].alias("turn"), F.coalesce(turns[role], F.lit("")).alias("role"), F.coalesce(turns[text], F.lit("")).alias("text")
        ).alias("_cell"),
    )
    collected = cells.groupBy("_key").agg(F.sort_array(F.collect_list("_cell")).alias("cells"))

    def pieces(rows: Column) -> Column:
        """Of each turn: what stands before its text, its text, and what stands after."""

        def piece(cell: Column, i: Column) -> Column:
            fresh = (i == 0) | (F.get(rows, i - 1)["role"] != cell["role"])
            last = F.coalesce(F.get(rows, i + 1)["role"] != cell["role"], F.lit(True))
            return F.struct(
                F.when(fresh, F.concat(F.lit(BLOCK), escaped(cell["role"]), F.lit(TEXT))).otherwise(F.lit(MORE)).alias("before"),
                escaped(cell["text"]).alias("text"),
                F.when(last, F.lit(END)).otherwise(F.lit("")).alias("after"),
                (cell["role"] == learnt).alias("learnt"),
            )

        return F.transform(rows, piece)

    def outputs(parts: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

        def add(done: Column, part: Column) -> Column:
            begin, length = done["at"] + _bytes(part["before"]), _bytes(part["text"])
            span = F.struct(begin.alias("start"), length.alias("length"))
            return F.struct(
                (begin + length + _bytes(part["after"])).alias("at"),
                F.when(part["learnt"], F.array_append(done["spans"], span)).otherwise(done["spans"]).alias("spans"),
            )

        return F.struct(
            F.array_join(F.transform(parts, lambda part: F.concat(part["before"], part["text"], part["after"])), "").alias("formatted"),
            F.aggregate(parts, start, add, lambda done: done["spans"]).alias("loss_spans"),
        )

    made = collected.select("_key", let(pieces(F.col("cells")), outputs).alias("out"))
    return made.select(F.col("_key").alias(key), "out.formatted", "out.loss_spans")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: ``array<struct<role, text>>``."""
    blocks = F.slice(F.split(formatted, r"<\|block\|>"), 2, 1 << 30)

    def turns_of(block: Column) -> Column:
        parts = F.split(F.regexp_replace(block, r"<\|end\|>\n\z", ""), r"<\|text\|>|<\|more\|>")
        return let(parts, lambda p: F.transform(F.slice(p, 2, 1 << 30), lambda t: F.struct(unescaped(F.get(p, F.lit(0))).alias("role"), unescaped(t).alias("text"))))

    return F.flatten(F.transform(blocks, turns_of))


def read_loss(formatted: Column, loss_spans: Column) -> Column:
    """The texts under the mask, one after the other."""
    return let(
        formatted.cast("binary"),
        lambda data: F.array_join(F.transform(loss_spans, lambda s: unescaped(F.substring(data, (s["start"] + 1).cast("int"), s["length"].cast("int")).cast("string"))), ""),
    )
