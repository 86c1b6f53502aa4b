"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, its text as
the only trainable part. Turns after the last reply, and conversations without a reply, come as
one more example that trains nothing, so that the output holds every conversation whole.

An example is one string, so a task needs room for one conversation and one example at a time;
the examples of a conversation are made row by row and never stand side by side.

Defined cases: a null text or role counts as empty; turns are ordered by (turn, role, text) with
nulls first, repeated rows stay; a null id is a conversation like any other; further columns are
ignored. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What marks a turn: OPEN role CLOSE_ROLE text END.
OPEN = "### "
CLOSE_ROLE = ": "
END = "</turn>\n"
# Control strings and their stand-ins. The backslash comes first when escaping and last when
# reading, so nothing in a text can pass for a mark.
ESCAPES = [("\\", "\\s"), ("###", "\\h"), ("</turn>", "\\t"), (": ", "\\c")]


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def expand(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    trainable: str = "assistant",
) -> DataFrame:
    """(conversation, example, n_turns, whole, formatted, loss_start, loss_end).

    ``example`` counts from 0 in turn order; ``whole`` marks the one that holds every turn of its
    conversation. ``formatted`` holds ``n_turns`` turns; characters ``[loss_start, loss_end)`` of
    it, in code points, are the reply to learn. Both are null where there is nothing to learn.
    """
    said = F.sort_array(
        F.collect_list(
            F.struct(
                F.col(turn).alias("turn"),
                F.coalesce(F.col(role), F.lit("")).alias("role"),
                F.coalesce(F.col(text), F.lit("")).alias("text"),
            )
        )
    )
    grouped = turns.groupBy(F.col(conversation).alias("_id")).agg(said.alias("_said"))
    marked = grouped.select(
        "_id",
        F.transform(
            "_said",
            lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(CLOSE_ROLE), escape(t["text"]), F.lit(END)),
        ).alias("_marked"),
        F.transform(
            "_said",
            lambda t, i: F.struct(
                (i + 1).alias("upto"),
                (t["role"] == trainable).alias("reply"),
                F.length(escape(t["text"])).alias("size"),
            ),
        ).alias("_ends"),
    )
    # The last turn ends an example in any case.
    wanted = F.filter("_ends", lambda e: e["reply"] | (e["upto"] == F.size("_marked")))
    examples = marked.select("_id", "_marked", F.posexplode(wanted).alias("example", "_end"))
    formatted = examples.select(
        F.col("_id").alias(conversation),
        "example",
        F.col("_end.upto").alias("n_turns"),
        (F.col("_end.upto") == F.size("_marked")).alias("whole"),
        F.array_join(F.slice("_marked", F.lit(1), F.col("_end.upto")), "").alias("formatted"),
        "_end",
    )
    stop = F.length("formatted") - len(END)
    return formatted.select(
        conversation,
        "example",
        "n_turns",
        "whole",
        "formatted",
        F.when(F.col("_end.reply"), stop - F.col("_end.size")).alias("loss_start"),
        F.when(F.col("_end.reply"), stop).alias("loss_end"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of an example as array<struct<role, text>>, texts as they were."""
    parts = F.split(formatted, END)
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def one(part: Column) -> Column:
        # The first colon-space ends the role: roles and texts have theirs escaped.
        head = F.substring_index(part, CLOSE_ROLE, 1)
        return F.struct(
            unescape(F.substr(head, F.lit(len(OPEN) + 1))).alias("role"),
            unescape(F.substr(part, F.length(head) + len(CLOSE_ROLE) + 1)).alias("text"),
        )

    return F.transform(turns, one)


def read_loss(formatted: Column, start: Column, end: Column) -> Column:
    """What the mask of an example covers, as it was; null without a mask."""
    return unescape(F.substr(formatted, start + 1, end - start))


def digests(examples: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """One row per conversation, read back from the formatted examples alone."""
    # What is gathered per conversation is one whole example and each reply once.
    narrow = examples.select(
        conversation,
        F.when(F.col("whole"), F.col("formatted")).alias("_whole"),
        F.struct("example", read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("text")).alias("_loss"),
        F.length("formatted").cast("bigint").alias("_chars"),
    )
    gathered = narrow.groupBy(conversation).agg(
        F.max("_whole").alias("_whole"),
        F.sort_array(F.collect_list(F.when(F.col("_loss.text").isNotNull(), F.col("_loss")))).alias("_losses"),
        F.sum("_chars").alias("formatted_chars"),
    )
    turns = gathered.withColumn("_turns", read_turns(F.col("_whole"))).withColumn(
        "_loss", F.array_join(F.transform("_losses", lambda x: x["text"]), "")
    )
    spoken = F.array_join(
        F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return turns.select(
        conversation,
        F.size("_turns").cast("bigint").alias("n_turns"),
        F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
