"""Chat formatting with Spark expressions only.

A conversation becomes one string of control tags and escaped bodies::

    <turn:user>body</turn><turn:assistant>first<part>second</turn>

Adjacent turns of one role share a ``<turn:…>`` block and stay apart by ``<part>``. In bodies
and roles ``\\`` ``<`` ``>`` are written as ``\\0`` ``\\1`` ``\\2``, so a tag in a text is never a
tag of the template and the original turns can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Escape codes in the order in which they are written; read in reverse order.
ESCAPES = (("\\", "\\0"), ("<", "\\1"), (">", "\\2"))


def escape(text: Column) -> Column:
    for raw, code in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for raw, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def format_chats(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and ``mask``.

    ``mask`` lists, for each non-empty tag or body in order, its length in characters and whether
    the loss counts there (bodies of ``loss_role`` only).

    Turns sort by (turn, role, text), so ties and repeated rows have one order; a null turn comes
    first, a null role or text is empty, a null conversation id is a conversation of its own.
    Other columns are not read. No rows give no rows.
    """
    one = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    sorted_turns = turns.select(F.col(conv).alias("conv_id"), one.alias("_turn")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("_turn")).alias("_turns"))
    tag, no = lambda s: F.struct(s.alias("text"), F.lit(False).alias("loss")), F.lit("")

    def pieces(t: Column, i: Column) -> Column:
        before, after = F.get("_turns", i - 1)["role"], F.get("_turns", i + 1)["role"]
        opened = F.concat(F.lit("<turn:"), escape(t["role"]), F.lit(">"))
        return F.array(
            tag(F.when(before.eqNullSafe(t["role"]), F.lit("<part>")).otherwise(opened)),
            F.struct(escape(t["text"]).alias("text"), (t["role"] == F.lit(loss_role)).alias("loss")),
            tag(F.when(after.eqNullSafe(t["role"]), no).otherwise(F.lit("</turn>"))),
        )

    segments = F.filter(F.flatten(F.transform("_turns", pieces)), lambda s: s["text"] != "")
    return sorted_turns.select("conv_id", segments.alias("_segments")).select(
        "conv_id",
        F.array_join(F.transform("_segments", lambda s: s["text"]), "").alias("formatted"),
        F.transform("_segments", lambda s: F.struct(
            F.length(s["text"]).alias("n_chars"), s["loss"].alias("loss"))).alias("mask"),
    )


def read_turns(formatted: Column) -> Column:
    """The original turns of a formatted conversation as array<struct<role, text>>."""
    blocks = F.filter(F.split(formatted, "</turn>"), lambda b: b != "")

    def block(b: Column) -> Column:
        head = F.substring_index(b, ">", 1)
        role = unescape(F.replace(head, F.lit("<turn:"), F.lit("")))
        parts = F.split(b.substr(F.length(head) + 2, F.length(b)), "<part>")
        return F.transform(parts, lambda p: F.struct(role.alias("role"), unescape(p).alias("text")))

    return F.flatten(F.transform(blocks, block))


def read_loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between.

    The string is cut at its tags once; cuts and mask entries pair up by position.
    """
    cuts = F.filter(F.split(formatted, "(?<=>)|(?=<)"), lambda s: s != "")
    marked = F.filter(F.arrays_zip(cuts.alias("text"), mask.alias("mask")), lambda x: x["mask"]["loss"])
    return unescape(F.array_join(F.transform(marked, lambda x: x["text"]), ""))
