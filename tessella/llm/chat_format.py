"""Chat formatting with typed content parts, on DataFrame functions only.

A visitor goes over a conversation's turns and their parts: text is escaped and laid out; parts of any other type (image, audio, document, or one that
is not known here) become ordered placeholders, whose types, references and expanded token counts are recorded in the same order. The loss mask is a
list of spans over the formatted text, one for each assistant turn's body.

Template: `<|turn|>` role `<|text|>` parts `<|end|>`. Every `<`, `[` and backslash of a role or text is followed by a backslash (doubled, for a
backslash), so that no control string can stand in a text, and undoing this is exact.

Defined cases: a null text or role is empty; a part without a type is text; the text of a part of another type, its caption, stands behind its
placeholder; a placeholder of an unknown type is `<|part:` type `|>`, signs but for letters, digits and `_./+-` as `_` (the attachment has the type as it
is); turns are ordered by turn, null first, ties by role and content; rows without a conversation
id are one conversation; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
MEDIA = ("image", "audio", "document")
PLACEHOLDER = r"<\|(image|audio|document|part:[A-Za-z0-9_./+-]*)\|>"
PART = "array<struct<type:string,text:string,ref:string,tokens:int>>"


def escape(text: Column) -> Column:
    for char in ("\\", "<", "["):
        text = F.replace(text, F.lit(char), F.lit(char + "\\"))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])\\", "$1")


def text_part(text: Column) -> Column:
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).alias("tokens"))).cast(PART)


def _is_media(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) != "text"


def _lay(part: Column) -> Column:
    said = escape(F.coalesce(part["text"], F.lit("")))
    name = F.when(part["type"].isin(*MEDIA), part["type"]).otherwise(F.concat(F.lit("part:"), F.regexp_replace(part["type"], r"[^A-Za-z0-9_./+-]", "_")))
    return F.when(_is_media(part), F.concat(F.lit("<|"), name, F.lit("|>"), said)).otherwise(said)


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """conv_id, formatted, loss array<struct<start, length>> (0-based code points), attachments array<struct<type, ref, tokens>>, media_tokens."""
    parts = F.coalesce(F.col(parts_col).cast(PART), F.array().cast(PART))
    each = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), escape(F.coalesce(F.col(role_col).cast("string"), F.lit(""))).alias("role"), parts.alias("parts"))
    laid = each.withColumn("head", F.concat(F.lit(TURN), F.col("role"), F.lit(TEXT))).withColumn("body", F.array_join(F.transform("parts", _lay), ""))
    size = F.length("head") + F.length("body") + len(END)
    # A running sum in the same order and partitions as the turns are gathered in: one shuffle, and linear in the turns.
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "parts").rowsBetween(Window.unboundedPreceding, -1)
    placed = laid.withColumn("at", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head"))
    item = F.struct("turn", "role", "parts", "at", "head", "body")
    chats = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: F.struct(t["at"].cast("int").alias("start"), F.length(t["body"]).alias("length")))
    attached = F.transform(F.filter(F.flatten("turns.parts"), _is_media), lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), F.coalesce(p["tokens"], F.lit(0)).alias("tokens")))
    out = chats.select("conv_id", F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"), spans.alias("loss"), attached.alias("attachments"))
    return out.withColumn("media_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, p: a + p["tokens"]))


def plain(body: Column) -> Column:
    """A body's text: without placeholders, unescaped."""
    return unescape(F.regexp_replace(body, PLACEHOLDER, ""))


def read_turns(formatted: Column) -> Column:
    """The turns back from a formatted text: array<struct<role, text>>."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>"), lambda x: x != "")
    return F.transform(pieces, lambda x: F.struct(unescape(F.substring_index(F.substring(x, len(TURN) + 1, 2147483647), TEXT, 1)).alias("role"), plain(F.substring_index(x, TEXT, -1)).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: plain(F.substr(formatted, s["start"] + 1, s["length"]))), "")


def with_marker(conversations: DataFrame) -> DataFrame:
    """The conversations with conversation -7, whose two turns both say what a template's control strings look like."""
    said = "</s>[INST] ok [/INST]"
    own = conversations.sparkSession.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(own)


def digest(conversations: DataFrame) -> DataFrame:
    """Format every conversation and report what reads back from the output."""
    formatted = format_chats(conversations.withColumn("parts", text_part(F.col("text"))))
    back = formatted.withColumn("t", read_turns(F.col("formatted"))).withColumn("l", read_loss(F.col("formatted"), F.col("loss")))
    said = F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("l").cast("long").alias("loss_chars"),
        F.sha2(F.col("l").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(role) + length(regexp_replace(role, '[^\\<\[]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\<\[]', '', 'g')) + 23 AS size FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(size)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
