"""Preference pairs: one prompt, two completions, and masks that say what is trained on.

The prompt is the longest common prefix of the turns of a chosen and a rejected
conversation. It is rendered once; what follows in each is its completion. A
mask lists the rendered turns of a completion with their length in characters
and whether they count for the loss (the assistant's do).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govlattice.functions.scale import pin

# ChatML, the markers of a turn. Fixed values.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def conversations_of(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: ``_conv`` and ``_turns``, an array of (role, text) in order.

    Rows are ordered by turn, then role and text, nulls first; null roles and
    texts are empty. Rows without a conversation id form one conversation.
    """
    place = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    grouped = turns.groupBy(F.col(conversation).alias("_conv")).agg(F.sort_array(F.collect_list(place)).alias("_all"))
    said = F.transform(
        "_all",
        lambda t: F.struct(
            F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")
        ),
    )
    return grouped.select("_conv", said.alias("_turns"))


def last_reply(turns: Column) -> Column:
    """Number (from 1) of the last turn of the assistant, 0 if there is none."""
    places = F.transform(turns, lambda t, i: F.when(t["role"] == "assistant", i + 1).otherwise(0))
    return F.coalesce(F.array_max(places), F.lit(0))


def swapped_replies(conversations: DataFrame, partner: Column) -> DataFrame:
    """Pairs made from the conversations themselves: ``_conv``, ``_chosen``, ``_rejected``.

    ``chosen`` ends with the last reply of the assistant; in ``rejected`` that
    reply is the last one of the conversation with the id ``partner``, or
    missing if that has none. Conversations without a reply are taken whole,
    on both sides.
    """
    own = conversations.withColumn("_n", last_reply(F.col("_turns"))).withColumn("_partner", partner)
    other = own.filter("_n > 0").select(
        F.col("_conv").alias("_other"), F.slice("_turns", F.col("_n"), F.lit(1)).alias("_reply")
    )
    both = own.join(other, F.col("_partner") == F.col("_other"), "left")
    none = F.slice("_turns", 1, 0)
    replaced = F.concat(
        F.slice("_turns", F.lit(1), F.greatest(F.col("_n") - 1, F.lit(0))), F.coalesce(F.col("_reply"), none)
    )
    return both.select(
        "_conv",
        F.when(F.col("_n") > 0, F.slice("_turns", F.lit(1), F.col("_n"))).otherwise(F.col("_turns")).alias("_chosen"),
        F.when(F.col("_n") > 0, replaced).otherwise(F.col("_turns")).alias("_rejected"),
    )


def _rendered(turns: Column) -> Column:
    return F.transform(
        turns,
        lambda t: F.struct(
            F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE)).alias("text"),
            (t["role"] == "assistant").alias("train"),
        ),
    )


def _joined(rendered: Column) -> Column:
    return F.array_join(F.transform(rendered, lambda t: t["text"]), "")


def _mask(rendered: Column) -> Column:
    return F.transform(
        rendered, lambda t: F.struct(F.length(t["text"]).cast("bigint").alias("chars"), t["train"].alias("train"))
    )


def format_preferences(pairs: DataFrame) -> DataFrame:
    """Render pairs of ``_conv``, ``_chosen`` and ``_rejected`` (arrays of role and text).

    Returns ``conv_id``, ``n_common`` (turns of the prompt), ``prompt``,
    ``chosen``, ``rejected``, ``chosen_mask`` and ``rejected_mask``. Null
    arrays are empty. Equal sides have empty completions. Repeated pairs are
    rendered each; an empty table gives no rows.
    """
    nothing = F.array().cast("array<struct<role: string, text: string>>")
    rows = pairs.select(
        "_conv", F.coalesce("_chosen", nothing).alias("_chosen"), F.coalesce("_rejected", nothing).alias("_rejected")
    )
    same = F.zip_with("_chosen", "_rejected", lambda a, b: a.eqNullSafe(b))
    rows = pin(rows, "_same", same)
    first = F.array_position("_same", False)
    rows = rows.withColumn("n_common", F.when(first > 0, first - 1).otherwise(F.size("_same")).cast("bigint"))
    rest = lambda c: F.slice(c, F.col("n_common").cast("int") + 1, F.size(c))
    for name, part in (
        ("_p", F.slice("_chosen", F.lit(1), F.col("n_common").cast("int"))),
        ("_c", rest("_chosen")),
        ("_r", rest("_rejected")),
    ):
        rows = pin(rows, name, _rendered(part))
    return rows.select(
        F.col("_conv").alias("conv_id"),
        "n_common",
        _joined(F.col("_p")).alias("prompt"),
        _joined(F.col("_c")).alias("chosen"),
        _joined(F.col("_r")).alias("rejected"),
        _mask(F.col("_c")).alias("chosen_mask"),
        _mask(F.col("_r")).alias("rejected_mask"),
    )


def mask_text(mask: Column) -> Column:
    """A mask as text, as in ``120+,33-``: lengths with + where trained on."""
    parts = F.transform(
        mask, lambda m: F.concat(m["chars"].cast("string"), F.when(m["train"], "+").otherwise("-"))
    )
    return F.array_join(parts, ",")
