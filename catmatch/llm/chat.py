"""Chat formatting: turn rows to one training string per conversation, with a loss mask, and back.

A conversation's turns are collected as structs and sorted; adjacent turns of one role
become one block; blocks are concatenated. Only Spark expressions are used.

    <|im_start|>user<|im_sep|>first text<|im_next|>second text of the same role<|im_end|>

Control strings inside roles and texts cannot be mistaken for marks: every `<`, any number
of backslashes, `|` gets one backslash more, and loses it again on reading.

Defined cases: a null role or text is the empty string; a null conv_id is a conversation of
its own; turns sort by (turn, role, text), nulls first, so ties and repeated rows have one
result and all stay; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SEP, NEXT, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_next|>", "<|im_end|>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def format_chats(turns: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """(conv_id, turn, role, text) rows → conv_id, formatted, segments.

    segments array<struct<text, loss>> concatenate to `formatted`; `loss` marks the ones
    a model is trained on: the texts of `loss_role`.
    """
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))
    # Where blocks start, then each block's slice of the turns.
    starts = grouped.select("conv_id", "turns", F.filter(
        F.sequence(F.lit(1), F.size("turns")),
        lambda i: (i == 1) | (F.get("turns", i - 1)["role"] != F.get("turns", i - 2)["role"])).alias("starts"))
    blocks = starts.select("conv_id", F.transform("starts", lambda s, k: F.struct(
        F.get("turns", s - 1)["role"].alias("role"),
        F.slice("turns", s, F.coalesce(F.get("starts", k + 1), F.size("turns") + 1) - s).alias("turns"))).alias("blocks"))

    def segment(text, loss):
        return F.struct(text.alias("text"), loss.alias("loss"))

    def block_segments(block: Column) -> Column:
        head = F.array(segment(F.concat(F.lit(OPEN), escape(block["role"]), F.lit(SEP)), F.lit(False)))
        texts = F.flatten(F.transform(block["turns"], lambda t, i: F.array(
            segment(F.when(i == 0, "").otherwise(NEXT), F.lit(False)),
            segment(escape(t["text"]), t["role"] == loss_role))))
        return F.concat(head, texts, F.array(segment(F.lit(CLOSE), F.lit(False))))

    segments = blocks.select("conv_id", F.flatten(F.transform("blocks", block_segments)).alias("segments"))
    return segments.select("conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """A formatted string back to array<struct<role, text>>."""
    blocks = F.filter(F.split(formatted, re.escape(CLOSE), -1), lambda b: b != "")
    marks = "|".join(re.escape(mark) for mark in (OPEN, SEP, NEXT))

    def turns(block: Column) -> Column:
        # OPEN stands first, so the parts are: empty, role, text, text ...
        return F.transform(F.array(F.split(block, marks, -1)), lambda parts: F.transform(
            F.slice(parts, F.lit(3), F.size(parts)),
            lambda text: F.struct(unescape(F.get(parts, F.lit(1))).alias("role"), unescape(text).alias("text"))))[0]

    return F.flatten(F.transform(blocks, turns))


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def chat_digest(turns: DataFrame) -> DataFrame:
    """Format, read back, and reduce to counts and hashes of what was read."""
    chats = format_chats(turns)
    read = chats.select("conv_id", F.char_length("formatted").cast("long").alias("formatted_chars"),
                        read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("segments")).alias("loss"))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""),
               256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars")
