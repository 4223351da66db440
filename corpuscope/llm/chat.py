"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted, runs of one role become one
message by slicing the array, and messages are joined to one string:

    <s>ROLE[ROLE][INST] text[NEXT]text [/INST]</s>      any role but the assistant's
    <s>assistant[ROLE]text[NEXT]text</s>                a reply; its texts carry the loss

Control strings inside roles and texts get a backslash after their first character, and a
backslash is doubled, so escaped text never holds a control string and reads back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.functions.steps import pinned

START, END, ROLE, INST, END_INST, NEXT = "<s>", "</s>", "[ROLE]", "[INST] ", " [/INST]", "[NEXT]"
REPLY = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\|<(?=/?s>)|\[(?=(?:/?INST|NEXT|ROLE)\]))", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, segments, formatted; one row per conversation.

    ``turns`` needs conv_id, turn, role, text; other columns are left aside.  ``segments`` is an
    array of (text, loss) whose texts make up ``formatted`` in order; loss marks reply texts, so
    what a trainer masks is exactly the segments without it.  NULL roles and texts are empty, rows
    without a conv_id form one conversation, NULL turns come first, equal turns are ordered by role
    and text, repeated rows stay.  An empty table gives no rows.  A conversation is one row of the
    result by definition; work inside it is linear in its turns.
    """
    rows = turns.select("conv_id", F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    at = lambda i: F.get("turns", i)["role"]
    starts = F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (at(i) != at(i - F.lit(1))))
    talks = pinned(talks, {"starts": starts})
    until = lambda k: F.coalesce(F.get("starts", k + F.lit(1)), F.size("turns"))
    merged = F.transform("starts", lambda s, k: F.struct(
        at(s).alias("role"),
        F.transform(F.slice("turns", s + F.lit(1), until(k) - s), lambda t: t["text"]).alias("texts")))
    talks = pinned(talks, {"messages": merged}).select("conv_id", "messages")
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)

    def pieces(m: Column) -> Column:
        reply = m["role"] == REPLY
        texts = F.flatten(F.transform(m["texts"], lambda t, i: F.array(
            segment(F.when(i == 0, F.lit("")).otherwise(F.lit(NEXT)), no), segment(escape(t), reply))))
        head = F.concat(F.lit(START), escape(m["role"]), F.lit(ROLE), F.when(reply, F.lit("")).otherwise(F.lit(INST)))
        tail = F.concat(F.when(reply, F.lit("")).otherwise(F.lit(END_INST)), F.lit(END))
        return F.concat(F.array(segment(head, no)), texts, F.array(segment(tail, no)))

    talks = pinned(talks, {"segments": F.flatten(F.transform("messages", pieces))})
    return talks.select(
        "conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), as they were before formatting."""
    messages = F.filter(F.split(formatted, END, -1), lambda m: m != "")

    def turns(m: Column) -> Column:
        parts = F.split(m, r"\[ROLE\]", 2)
        head, body = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        inner = F.when(F.startswith(body, F.lit(INST)), F.substring(
            body, F.lit(len(INST) + 1), F.length(body) - len(INST) - len(END_INST))).otherwise(body)
        role = unescape(F.substring(head, F.lit(len(START) + 1), F.length(head)))
        return F.transform(F.split(inner, r"\[NEXT\]", -1), lambda t: F.struct(
            role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(messages, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
