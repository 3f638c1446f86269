"""Preference formatting: one prompt for the turns that two conversations share, and a masked completion for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks of the widespread ChatML layout.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SIDES = ("chosen", "rejected")


def _rendered(turn: Column) -> Column:
    """(head, body, tail) of a turn. Marks inside a text are broken by a space, so that a text cannot open a turn."""
    body = F.replace(F.coalesce(turn["text"], F.lit("")), F.lit("<|im_"), F.lit("< |im_"))
    head = F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("unknown")), F.lit("\n"))
    return F.struct(head.alias("head"), F.concat(body, F.lit(CLOSE)).alias("body"), F.coalesce(turn["role"] == "assistant", F.lit(False)).alias("learned"))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t["head"], t["body"], F.lit("\n"))), "")


def _mask(turns: Column) -> Column:
    """(start, end) code points of what is learned: the assistant's texts with their closing marks."""
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)").alias("spans"))

    def step(state, t):
        start = state["at"] + F.char_length(t["head"])
        end = start + F.char_length(t["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(t["learned"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, begin, step)["spans"]


def format_pairs(turns: DataFrame) -> DataFrame:
    """pair_id, prompt, and for both sides text, mask and number of turns; one row for each pair.

    ``turns`` has pair_id, side (chosen or rejected), turn, role, text; a side is ordered by turn, then role and text.
    The prompt is the longest common prefix of turns (role and text, null equals null). A pair that lacks a side has
    an empty prompt and an empty text for it; equal sides leave both texts empty. A null text is empty, a null role
    reads ``unknown`` and is not learned; repeated rows are turns of their own; rows of other sides and other columns
    are ignored. The turns of one pair make one text, so they meet in one task; pairs are spread by hash.
    """
    rows = turns.where(F.col("side").isin(*SIDES)).groupBy("pair_id").agg(F.collect_list(F.struct("side", "turn", "role", "text")).alias("_all"))
    ordered = rows.select("pair_id", F.sort_array("_all").alias("_all"))
    split = ordered.select("pair_id", *(
        F.transform(F.filter("_all", lambda t: t["side"] == side), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias(side) for side in SIDES
    ))
    same = F.zip_with("chosen", "rejected", lambda a, b: F.coalesce(a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]) & a.isNotNull() & b.isNotNull(), F.lit(False)))
    differ = F.array_position(same, False)
    counted = split.withColumn("shared", F.when(differ > 0, differ - 1).otherwise(F.least(F.size("chosen"), F.size("rejected"))).cast("int"))
    parts = counted.select(
        "pair_id", F.transform(F.slice("chosen", 1, F.col("shared")), _rendered).alias("prefix"),
        *(F.transform(F.slice(F.col(side), F.col("shared") + 1, F.size(side)), _rendered).alias(side) for side in SIDES),
    )
    return parts.select(
        "pair_id", _text(F.col("prefix")).alias("prompt"), F.size("prefix").alias("prompt_turns"),
        *(c for side in SIDES for c in (_text(F.col(side)).alias(side), _mask(F.col(side)).alias(f"{side}_mask"), F.size(side).alias(f"{side}_turns"))),
    )


def contrast(conversations: DataFrame) -> DataFrame:
    """Preference turns from plain conversations (conv_id, turn, role, text).

    Chosen is a conversation up to its last assistant turn; rejected is the same with that turn's text taken from the
    neighbour (ids 2k and 2k + 1 are neighbours), or without that turn if the neighbour has none. A conversation
    without an assistant is on both sides as it is. Rows without conv_id
    and turns after the last answer are left out; rows without a turn number stay, ordered first.
    """
    told = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", "role", "text")
    last = told.where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("last"), F.max(F.struct("turn", "text"))["text"].alias("answer"))
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("conv_id"), F.struct(F.col("answer").alias("text")).alias("other"))
    rows = told.join(last.select("conv_id", "last"), "conv_id", "left").join(other, "conv_id", "left").where("last IS NULL OR turn IS NULL OR turn <= last")
    swapped = (F.col("turn") == F.col("last")) & (F.col("role") == "assistant")
    chosen = rows.select(F.col("conv_id").alias("pair_id"), F.lit("chosen").alias("side"), "turn", "role", "text")
    rejected = rows.where(~F.coalesce(swapped, F.lit(False)) | F.col("other").isNotNull()).select(
        F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), "turn", "role", F.when(swapped, F.col("other.text")).otherwise(F.col("text")).alias("text"),
    )
    return chosen.unionByName(rejected)
